"""Filters and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.values import percentage
from varve.shared import col


def in_list(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(col(column).isin(list(values)))


def in_table(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the values of ``listed``, a table of one column of any length.

    A semi-join: repeated values change nothing, and null is in no list. Spark broadcasts a list
    that its estimates call small; before the shuffle for a longer one it may drop rows by a Bloom
    filter of the list (``spark.sql.optimizer.runtime.bloomFilter``).
    """
    (name,) = listed.columns
    value = f"_listed_{uuid4().hex}"
    return df.join(listed.select(col(name).alias(value)), col(column) == F.col(value), "left_semi")


def in_box(df: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Rows whose named columns all lie in their inclusive ranges.

    Text is read as a number; text that is none, like null, lies outside. Numeric columns are
    compared as they are, so that the scan can use the bounds.
    """
    types = dict(df.dtypes)
    for name, (low, high) in ranges.items():
        value = col(name).try_cast("double") if types[name] == "string" else col(name)
        df = df.filter(value.between(low, high))
    return df


def not_all_null(df: DataFrame) -> DataFrame:
    return df.filter(reduce(or_, (col(name).isNotNull() for name in df.columns)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row, by ``order``, of each combination of ``keys``; nulls equal each other.

    The row of the least order is taken as an aggregate, which keeps one row per key and task before
    the shuffle: a key that holds most of the table never meets in one task, as it would in a
    window. Grouping starts with a hash, so the sorts compare long text only within equal hashes.
    Only the order is compared, so other columns may be of any type; of rows that tie in it, any one
    is taken.
    """
    columns = [F.col(f"`{name}`") for name in keys]
    others = [F.col(f"`{name}`") for name in df.columns if name not in keys]
    ranks = [F.col(f"`{rank}`") if isinstance(rank, str) else rank for rank in order]
    first = F.min_by(F.struct(*others) if others else F.lit(0), F.struct(*ranks))
    grouped = df.groupBy(F.xxhash64(*columns).alias("_hash"), *columns).agg(first.alias("_first"))
    return grouped.select(
        *(F.col(f"`{name}`") if name in keys else F.col(f"_first.`{name}`") for name in df.columns)
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def share_over(groups: DataFrame, count: str, percent: float) -> DataFrame:
    """Groups whose share of the sum of ``count`` is strictly above ``percent``.

    The total is a scalar subquery, computed by the same job; nothing is collected.
    """
    total = groups.agg(F.sum(col(count))).scalar()
    return groups.filter(percentage(col(count), total) > percent)
