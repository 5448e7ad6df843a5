"""Fixed-layout text drops, read as lines so that one large file spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.functions.text import ends_joined, space_tokens
from varve.shared import materialize

POSITION = "_position"


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of every file as ``file, line, kept, value``, ``line`` counting from 0 within the file.

    Lines from ``kept`` on do not count: what follows the last line feed of a file, which is
    nothing in a file that ends in one and the last line in a file that does not. (In a compressed
    file the two cannot be told apart, and all lines are kept.)

    Files are read in splits, once: the lines are stored with the split they came from, because
    another scan may cut the files elsewhere (the number of cores counts). Lines per split are
    counted, and running sums over the splits of a file give each split the number of its first
    line. A line whose split was not counted fails the job.
    """
    lines = materialize(
        spark.read.option("lineSep", "\n")
        .text(path if isinstance(path, str) else list(path))
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_size").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    counted = lines.groupBy("file", "start", "size").agg(
        F.min("row").alias("first_row"),
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
    )
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.select(
        "file",
        "start",
        "first_row",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"),
        (
            F.sum("lines").over(whole) - (F.sum("bytes").over(whole) == F.col("size") + 1).cast("int")
        ).alias("kept"),
    )
    splits = materialize(splits)
    # One row per split, and no split holds more than its share of a file: no key is heavy.
    numbered = lines.join(splits, on=["file", "start"], how="left")
    lost = F.raise_error(F.concat(F.lit("a line of no known split of "), F.col("file"))).cast("bigint")
    line = F.coalesce("offset", lost) + F.col("row") - F.col("first_row")
    return numbered.select("file", line.alias("line"), "kept", "value")


def _fields(fields: int, mode: str) -> Column:
    """Space-separated fields of ``value``; a line with another number of them fails or is null."""
    tokens = space_tokens(F.col("value"))
    if mode == "DROPMALFORMED":
        return F.when(F.size(tokens) == fields, tokens)
    if mode != "FAILFAST":
        raise ValueError(f"mode is FAILFAST or DROPMALFORMED, not {mode!r}")
    wrong = F.concat(F.lit(f"expected {fields} fields: "), F.col("value"))
    return F.when(F.size(tokens) == fields, tokens).otherwise(F.raise_error(wrong))


def _parsed(
    lines: DataFrame, data: Column, names: Sequence[str], fields: int, mode: str, position: bool
) -> DataFrame:
    """Fields of the ``data`` lines. One condition holds it all: the optimizer may reorder filters,
    and a line that is no data must not fail."""
    found = F.when(data & (F.col("line") < F.col("kept")), _fields(fields, mode))
    parsed = lines.select(F.struct("file", "line").alias(POSITION), found.alias("_fields"))
    columns = [F.col("_fields")[at].alias(name) for at, name in enumerate(names)]
    return parsed.filter(F.col("_fields").isNotNull()).select(*columns, *([POSITION] if position else []))


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    header_line: int = 3,
    first_line: int = 5,
    fields: int = 3,
    columns: Sequence[str] | None = None,
    mode: str = "FAILFAST",
    position: bool = False,
) -> DataFrame:
    """Text table with its column names on one line and its data from another, all as strings.

    Without ``columns`` the names are looked up in one of the files. Every file must carry them.
    ``position`` adds the file and line of each row as ``_position``.
    """
    lines = numbered_lines(spark, path)
    header = space_tokens(F.regexp_replace("value", r"^\s+|\s+$", ""))
    if columns is None:
        found = lines.filter(F.col("line") == header_line).select(header.alias("names")).first()
        if found is None:
            raise ValueError(f"no line {header_line} in {path}")
        columns = found.names
    expected = F.array(*(F.lit(name) for name in columns))
    other = F.concat(F.lit("another header in "), F.col("file"))
    data = F.when((F.col("line") == header_line) & (header != expected), F.raise_error(other).cast("boolean"))
    data = data.otherwise(F.col("line") >= first_line)
    return _parsed(lines, data, list(columns)[:fields], fields, mode, position)


def read_text_series(
    spark: SparkSession,
    path: str | Sequence[str],
    date: str = "Date",
    value: str = "Anomaly",
    mode: str = "FAILFAST",
    position: bool = False,
) -> DataFrame:
    """Lines of a date and a value; of the date its year and month digits are kept (``yyyyMM``)."""
    series = _parsed(numbered_lines(spark, path), F.lit(True), [date, value], 2, mode, position)
    return series.withColumn(date, ends_joined(F.col(date)))
