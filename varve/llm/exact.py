"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import as_row, least_row, whole
from varve.shared import materialize

SALTS = 16


def one_space(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space; single spaces are left as they are."""
    return F.regexp_replace(whole(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def distinct_texts(docs: DataFrame, digest=F.xxhash64, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256`` (binary), ``keep_id``, ``group_size``.

    Rows are combined three times: within each task before the shuffle, then per digest and salt,
    then per digest over the winners of the salts. The salt is the task that read the row, so a text
    that fills a third of the table is one row per task after the first step and at most ``salts``
    rows after the second. Every step groups by the full text as well, so two texts with one digest
    never meet; ``digest`` only places them.
    """
    read = docs.select("doc_id", one_space("text").alias("content"), (F.spark_partition_id() % salts).alias("salt"))
    digests = read.withColumn("digest", digest("content"))
    salted = digests.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.select(F.unhex(F.sha2("content", 256)).alias("text_sha256"), "keep_id", "group_size")


def _one_text_each(texts: DataFrame) -> DataFrame:
    """``texts`` as a lookup by SHA-256, failing if two different texts ever share one."""
    clash = F.raise_error(F.lit("two different texts have the same SHA-256"))
    return texts.groupBy("text_sha256").agg(
        F.min("keep_id").alias("keep_id"),
        F.when(F.count("*") == 1, F.sum("group_size")).otherwise(clash.cast("bigint")).alias("group_size"),
    )


def exact_groups(docs: DataFrame, digest=F.xxhash64, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Returns ``doc_id``, ``keep_id`` (smallest id of the group), ``group_size``, ``kept`` and
    ``text_sha256`` (hex). A null text is an empty one. A null id is larger than all others: it is
    kept only where the whole group has null ids. Repeated rows count each and share ``kept``.
    The lookup is stored, so that Spark can split the rows of a heavy text in the last join.
    """
    lookup = materialize(_one_text_each(distinct_texts(docs, digest, salts)))
    rows = docs.select("doc_id", F.unhex(F.sha2(one_space("text"), 256)).alias("text_sha256"))
    joined = rows.join(lookup, "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, digest=F.xxhash64, salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged.

    The row with the smallest id stays; of repeated rows with that id, the least by its columns.
    The id is part of the join key, so no key is more frequent than an id.
    """
    lookup = _one_text_each(distinct_texts(docs, digest, salts))
    stays = lookup.select(F.struct("text_sha256", F.col("keep_id").alias("doc_id")).alias("key"))
    sha = F.unhex(F.sha2(one_space("text"), 256)).alias("text_sha256")
    kept = docs.select(F.struct(sha, "doc_id").alias("key"), as_row(docs)).join(stays, "key", "left_semi")
    return kept.groupBy("key").agg(least_row(docs)).select("row.*")
