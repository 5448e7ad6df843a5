"""From raw documents to token ids, in stages that each work on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varve.llm.exact import drop_exact
from varve.llm.mixing import remix
from varve.llm.pieces import encode, read_model
from varve.llm.quality import keep_good
from varve.llm.queries import MIXTURE, MODEL
from varve.llm.simhash import drop_near
from varve.llm.tables import documents, labels
from varve.shared import materialize


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules rate as good."""
    return keep_good(docs, labels(spark, sf_dir))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of four-word shingles differ in four bits at most."""
    return drop_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources reach their weights, in a global random order."""
    return remix(docs, MIXTURE, rest=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids."""
    return encode(docs.select("doc_id", "lang", "source", "text"), read_model(spark, MODEL))


STAGES = [
    ("quality classifier", good_texts),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", distinct_fingerprints),
    ("mixing to target weights", mixture),
    ("sentencepiece encoding", token_ids),
]

# The fitted rules of the first stage, the fingerprints and the search for pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
