import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

FOLDER = "/root/testdata/sf0.001"
HARD = [
    (1, None, "en", "src0"),
    (2, "", None, "src1"),
    (3, "  \t\n ", "en", None),
    (4, "one two  three four five", "en", "src0"),
    (4, "one two  three four five", "en", "src0"),
    (5, "one two three\nfour five", "en", "src1"),
    (None, "one two three four five", "en", "src1"),
    (None, "only here ü € 𝄞 ▁ with  two spaces ", "fr", "src9"),
    (6, "x" * 3000, "en", "src2"),
    (7, "y " + "x" * 3000, "en", "src2"),
    (8, "a long text of words. " * 3000 + "the end", "de", "other"),
]


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, lang, s, len(t or ""), "extra", 0.5) for i, t, lang, s in HARD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `score.x` string, digest double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
