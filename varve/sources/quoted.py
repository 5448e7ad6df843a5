"""CSV whose quoted fields may hold line feeds, read in splits."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.shared import lookup_join, materialize
from varve.sources.splits import SPLIT, along_splits, cut
from varve.sources.tables import CSV


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header, as ``read_csv(multiline=True)`` reads it, but with many tasks for one file.

    Quotes in a field are doubled and only quoted fields hold any, so a line begins within a quoted
    field just if the file has an odd number of quotes before it. Each split counts its quotes; the
    counts before a split tell where its lines begin; lines of one record are put together. Only
    records of several lines are shuffled. A record ends at a line feed, or CR and line feed, outside
    of quotes; within quotes both are kept as they are. Empty lines are no records. Every file has
    the header; another header, or a quote that is never closed, fails the job. Without a line there
    are no columns and no rows.
    """
    lines = cut(spark, path, "\n").withColumn("flips", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    lines = materialize(along_splits(lines))
    records = _records(lines, materialize(_splits(lines)))
    header = records.filter("head").orderBy("file").select("value").first()
    if header is None:
        return spark.createDataFrame([], T.StructType())
    names = _names(header.value)
    schema = ", ".join(f"f{at} STRING" for at in range(len(names)))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    data = F.when(~F.col("head"), F.col("value") != "").otherwise(F.when(F.col("value") != header.value, other).otherwise(False))
    options = {name: str(value).lower() if isinstance(value, bool) else value for name, value in CSV.items() if name != "header"}
    fields = records.filter(data).select(F.from_csv("value", schema, options).alias("f"))
    return fields.select(*(F.col(f"f.f{at}").alias(name) for at, name in enumerate(names)))


def _names(header: str) -> list[str]:
    """Column names as the CSV reader gives them: a number for no name, and one after each that repeats."""
    given = next(csv.reader([header], strict=False), [""])
    lower = [name.lower() for name in given]
    return [f"_c{at}" if not name else f"{name}{at}" if lower.count(name.lower()) > 1 else name for at, name in enumerate(given)]


def _splits(lines: DataFrame) -> DataFrame:
    """Per split whether it begins in a quoted field (``turned``) and the record that does, if any."""
    found = lines.groupBy(*SPLIT).agg(
        (F.sum("flips") % 2).alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"), F.min("row").alias("first_row")
    )
    # One row per split: a window per file holds as many rows as the file has splits.
    file = Window.partitionBy("file")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    open_quote = F.raise_error(F.concat(F.lit("a quote that is never closed in "), F.col("file"))).cast("boolean")
    closed = F.when(F.sum("quotes").over(file) % 2 == 1, open_quote).otherwise(F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    turned = found.select(*SPLIT, "first_row", "even", "odd", closed.alias("turned"), (F.col("start") == F.min("start").over(file)).alias("front"))
    begun = F.when(F.col("turned"), F.col("odd")).otherwise(F.col("even"))
    # Rows of a later split may have smaller numbers, so the last split that begins a record decides.
    head = F.max(F.when(F.col("front"), F.col("first_row"))).over(file)
    return turned.select(*SPLIT, "turned", F.last(begun, ignorenulls=True).over(before).alias("earlier"), head.alias("head_row"))


def _records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Records as ``file, head, value``; the first of a file is its ``head``."""
    placed = lookup_join(lines, splits, SPLIT)
    begun = F.when(F.col("turned"), F.col("odd")).otherwise(F.col("even"))
    placed = placed.select(
        *SPLIT, "row", "value", "flips", "head_row", (F.col("inside") != F.col("turned")).alias("goes_on"), F.coalesce(begun, "earlier").alias("record")
    )
    placed = placed.withColumn("head", F.col("record") == F.col("head_row"))
    alone = ~F.col("goes_on") & (F.col("flips") % 2 == 0)
    parts = F.sort_array(F.collect_list(F.struct("start", "row", "value")))
    longer = (
        placed.filter(~alone)
        .groupBy("file", "record", "head")
        .agg(F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("value"))
    )
    both = placed.filter(alone).select("file", "head", "value").unionByName(longer.select("file", "head", "value"))
    return both.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
