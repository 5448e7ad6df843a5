"""What the operators of this package share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.shared import col


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def as_row(table: DataFrame) -> Column:
    """All columns in one struct ``row``, where their names cannot clash with those that an operator adds."""
    return F.struct(*map(col, table.columns)).alias("row")


def least_row(table: DataFrame) -> Column:
    """The least ``row`` of a group; maps have no order, so rows that hold one are compared as JSON."""
    ordered = not {"map", "variant"} & set(re.findall(r"\w+", table.schema.simpleString()))
    return (F.min("row") if ordered else F.min_by("row", F.to_json("row"))).alias("row")


def given(names: list[str], added: list[str]) -> list[Column]:
    """The columns of ``row``, but for those named like one that is added, which takes their place."""
    taken = {name.lower() for name in added}
    return [F.col("row").getField(name).alias(name) for name in names if name.lower() not in taken]


def whole(text: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % folds


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe equality of the named columns, which come out once."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_right_{name}"))
    return left.join(renamed, condition, how).drop(*(f"_right_{name}" for name in names))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, train: Column, rows: dict[int, int]) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``rows[value]`` documents of each label value.

    ``train`` says which ids may be learned from. The ids are taken in the order of a hash, so the
    sample is the same on every run. Only their ids are broadcast, a bounded number. An id counts once: with the
    least of its labels and, of its texts, the one with the least hash (then the least text).
    """
    known = marks.filter(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    usable = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64(F.lit(label), "doc_id")
    picked = [usable.filter(F.col("label") == v).orderBy(order, "doc_id").limit(n) for v, n in rows.items()]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    text = F.struct(F.xxhash64(whole("text")).alias("hash"), whole("text").alias("text"))
    found = docs.select("doc_id", text.alias("text")).join(ids, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text.text", "label")
