"""Nearest vectors and quoted messages against plain versions; the pipeline on the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from varve.llm.exact import exact_groups
from varve.llm.kdtree import Best, top_k, trees, usable
from varve.llm.mixing import mix
from varve.llm.pieces import decode, encode, read_model
from varve.llm.queries import MODEL
from varve.llm.quotes import link_quotes
from varve.llm.simhash import near_groups
from varve.llm.suffixes import without_repeats

FOLDER = "/root/testdata/sf0.001"


def plain_top(rows, k, step):
    good = {(i, tuple(math.floor(float(np.float32(x)) * 256) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in good:
        if q % step == 0:
            scores = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)})
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 256, 256), (20, 3, 2)])
def test_nearest(spark, sizes):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").limit(120)
    odd = [(1000, [0.0] * 64), (1001, None), (None, [1.0] * 64), (1002, [1.0, None]), (1003, [float("nan")] * 64), (1004, [1.0, 2.0]),
           (1050, [1.0, 2.0]), (1051, [1.0, 2.0]), (1051, [1.0, 2.0]), (1100, []), (1101, []), (1006, [float("inf")] * 64)]
    odd += [(2000 + i, [0.5] * 64) for i in range(30)]
    table = given.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    rows = [(r[0], r[1]) for r in table.collect()]
    got = top_k(table, F.col("vec_id") % 50 == 0, 5, "embedding", *sizes)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 5, 50)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ids_with_many_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(50, [9.0 + i, 1.0]) for i in range(40)] + [(7, [8.0, i / 4]) for i in range(40)] + [(7, [8.0, 0.0])] * 3
    rows += [(51 + i, [float(x) for x in rng.integers(0, 9, 2)]) for i in range(40)]
    rows += [(8, [7.5, i / 4]) for i in range(30)] + [(200, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {(i, tuple(math.floor(x * 256) for x in v)) for i, v in rows}
    expected = []
    for query in (50, 100, 200):
        own = [v for i, v in good if i == query]
        scores = sorted({(-sum(a * b for a, b in zip(v, w)), i) for v in own for i, w in good if i != query})
        expected += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5]) if own]
    for sizes in ((8192, 256, 256), (20, 16, 2)):
        got = top_k(table, F.col("vec_id") % 50 == 0, 5, "embedding", *sizes)
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    built = trees(usable(table), 20, 16).collect()
    assert sum(50 in np.frombuffer(r["ids"], np.int64) for r in built) > 1
    best = Best(2)
    best.offer(np.array([9, 9, 9, 9, 5, 4]), np.array([1, 1, 1, 2, 3, 4]), 1)
    assert sorted(best.heap) == [(5, -3), (9, -2)]
    best = Best(2)
    best.offer(np.array([9, 9, 9, 9, 5, 4]), np.array([2, 2, 2, 2, 3, 4]), 1)
    assert sorted(best.heap) == [(5, -3), (9, -2)]


def test_many_vector_lengths_are_searched_without_a_broadcast(spark, monkeypatch):
    import varve.shared

    monkeypatch.setattr(varve.shared, "fits_broadcast", lambda *args: False)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 1 + i % 40)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = []
    for q, v in rows[::50]:
        scores = [(-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
        expected += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:5])]
    got = top_k(table, F.col("vec_id") % 50 == 0, 5, "embedding", 4, 2, 3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


MAIL = [
    (1, 0, "First  line\nsecond line"),
    (1, 1, "> first line\n> Second line\nI agree"),
    (1, 2, ">> First line\n>> second line\n> i agree\nSo do I"),
    (1, 3, "> so do i\n>> never said\n> nothing\nok"),
    (1, 4, "> second line\nback to the start"),
    (1, 5, "> I agree later\nnot linked"),
    (2, 0, None),
    (2, 1, ""),
    (2, 2, "> first line"),
    (None, 0, "> x"),
    (3, None, "> I agree"),
    (3, 1, "I agree"),
    (3, 1, "I agree"),
]


def test_quotes(spark):
    mail = spark.createDataFrame(MAIL, "conv_id long, turn long, text string").withColumn("level", F.lit("kept"))
    rows = link_quotes(mail).collect()
    assert len(rows) == len(MAIL) and {r["level"] for r in rows} == {"kept"}
    got = {(r["conv_id"], r["turn"]): (r["body"], r["n_quoted"], r["n_linked"], r["parent_turn"], r["root_turn"], r["depth"]) for r in rows}
    assert got[1, 0] == ("First  line\nsecond line", 0, 0, None, 0, 0)
    assert got[1, 1] == ("I agree", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("So do I", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("ok", 3, 1, 2, 0, 3)
    assert got[1, 4] == ("back to the start", 1, 1, 0, 0, 1)
    assert got[1, 5] == ("not linked", 1, 0, None, 5, 0)
    assert got[2, 0][0] == "" and got[None, 0] == ("", 1, 0, None, 0, 0) and got[3, None][3] is None
    assert link_quotes(mail.limit(0)).count() == 0


def test_given_conversations_are_linked_to_their_turns(spark):
    for r in contract.queries()["op2_quote_links"](spark, FOLDER).collect():
        assert r["depth"] <= r["turn"] and (r["turn"] == 0) == (r["parent_turn"] is None)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, FOLDER).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if "mixing" not in name:
            assert 0 < docs.count() <= before
    last = docs.orderBy("doc_id", "ids_sha256").select("doc_id", "ids_sha256").collect()
    again = corpus_pipeline.run(spark, FOLDER).orderBy("doc_id", "ids_sha256").select("doc_id", "ids_sha256").collect()
    assert last == again and docs.filter("not round_trip").isEmpty()


NAMES = ["rate", "copy", "Score", "predicted", "held_out", "label", "text_key", "fingerprint", "row", "key", "ids", "n_tokens",
         "round_trip", "keep_id", "group_size", "body", "depth", "root_turn", "steps", "named", "mix", "raw", "units", "a`b", "x.y"]


def test_columns_with_any_name_pass_every_stage(spark):
    marked = F.struct(F.col("doc_id").alias("id"), F.create_map(F.lit("k"), F.lit(None).cast("long")).alias("m"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("*", *(marked.alias(name) for name in NAMES))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == names
        assert all(r["row"]["id"] == r["x.y"]["id"] == r["doc_id"] for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count() > 0


def test_added_columns_take_the_place_of_given_ones(spark):
    given = spark.createDataFrame(MAIL, "conv_id long, turn long, text string")
    plain, clashing = link_quotes(given), link_quotes(given.selectExpr("*", *(f"'x' as `{n.replace('`', '``')}`" for n in NAMES)))
    assert set(clashing.columns) == set(plain.columns) | set(NAMES) and clashing.columns.count("depth") == 1
    assert sorted(map(repr, clashing.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    extra = docs.selectExpr("*", *(f"'x' as `{n.replace('`', '``')}`" for n in NAMES))
    mixed = mix(extra, {"src0": 1.0}, 1.0)
    assert mixed.columns.count("rate") == 1 and mixed.schema["rate"].dataType.typeName() == "double"
    model = read_model(spark, MODEL)
    encoded = encode(extra, model)
    assert encoded.schema["n_tokens"].dataType.typeName() == "long" and encoded.filter("not round_trip").isEmpty()
    assert sorted(r["text"] for r in decode(encoded, model).collect()) == sorted(r["text"] for r in docs.collect())
    for run in (exact_groups, near_groups, without_repeats):
        assert run(extra).count() == 20
