"""CSV and columnar tables: reading, whole-table writing, manifests and names for SQL."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from varve.shared import col, file_system

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# Parts of a column of a clustered table: a power of two.
PARTS = 64
MANIFEST = "_symlink_format_manifest"


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header, all columns text, empty fields null, quotes doubled inside quotes.

    Blanks at the ends of fields are kept.
    ``multiline`` allows line feeds inside quoted fields; a file is then read by one task, unlike by
    ``varve.sources.quoted.read_quoted_csv``.
    """
    return spark.read.options(**CSV).option("multiLine", multiline).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files that ``read_csv`` reads back; lists and nested fields become JSON text."""
    nested = ("array", "map", "struct")
    columns = [
        F.to_json(F.col(f"`{name}`")).alias(name) if kind.startswith(nested) else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    _replace(df.select(*columns).write.options(**CSV).format("csv"), df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the whole table at ``path``, which ``df`` may read."""
    _replace(df.write.format("parquet"), df.sparkSession, path)


def write_clustered(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the whole table at ``path``, with rows that are near in the numbers ``by`` near in the files.

    Rows are ordered along a space-filling curve: each column is cut at quantiles into 64 parts, and
    the bits of the parts take turns in the place of a row. So the least and greatest values that
    files and row groups carry lie close together in every column, and a box on any of them, or on
    all, skips most of the table. Text is read as a number; what is none, like null, comes first.
    The quantiles are approximate, which only the evenness of the order depends on.
    """
    types = dict(df.dtypes)
    values = [col(name).try_cast("double") if types[name] == "string" else col(name).cast("double") for name in by]
    cuts = [at / PARTS for at in range(1, PARTS)]
    found = df.select(*(F.percentile_approx(value, cuts).alias(f"c{at}") for at, value in enumerate(values))).first()
    # Each step is a column, computed once a row and not for each comparison of the sort.
    own = uuid4().hex
    names, place = [f"_value{at}_{own}" for at in range(len(by))], f"_place_{own}"
    placed = df.withColumns(dict(zip(names, values))).withColumn(place, F.lit(0).cast("long"))
    for at, name in enumerate(names):
        part = f"_part{at}_{own}"
        placed = _with_part(placed, name, found[at], part)
        dealt = F.array(*(F.lit(_dealt(one, at, len(by))).cast("long") for one in range(PARTS)))
        placed = placed.withColumn(place, F.col(place).bitwiseOR(F.get(dealt, F.col(part)))).drop(part)
    order = [place, *names]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    _replace(ordered.write.format("parquet"), df.sparkSession, path)


def _with_part(df: DataFrame, name: str, bounds: Sequence[float] | None, out: str) -> DataFrame:
    """Add as ``out`` how many of the ``PARTS`` - 1 ``bounds``, which rise, are below the number ``name``: none for null.

    The search halves the bounds, so a row takes six comparisons and not 63.
    """
    df, step = df.withColumn(out, F.lit(0)), PARTS // 2
    known = F.array(*(F.lit(float(bound)) for bound in bounds or []))
    while bounds and step:
        below = F.get(known, F.col(out) + (step - 1)) < F.col(name)
        df, step = df.withColumn(out, F.col(out) + F.when(below, step).otherwise(0)), step // 2
    return df


def _dealt(part: int, at: int, columns: int) -> int:
    """The bits of ``part``, each at its turn in a place made of ``columns`` parts."""
    return sum((part >> bit & 1) << bit * columns + at for bit in range(PARTS.bit_length() - 1))


def _replace(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write beside ``path``, then swap: a job that fails leaves the old table as it was.

    On an object store a rename is a copy, which takes the longer the larger the tables are.
    """
    target = path.rstrip("/")
    new, old = f"{target}.new-{uuid4().hex}", f"{target}.old-{uuid4().hex}"
    writer.save(new)
    files, here = file_system(spark, target)
    place = lambda name: file_system(spark, name)[1]
    # A rename into a folder that exists moves the table inside it, so that the old one would stay.
    if files.exists(here) and (not files.rename(here, place(old)) or files.exists(here)):
        raise OSError(f"{target} could not be moved away and is as it was; the new table is at {new}")
    if not files.rename(place(new), here):
        raise OSError(f"the new table is at {new}, the one it replaces at {old}")
    files.delete(place(old), True)


def write_manifest(spark: SparkSession, path: str) -> str:
    """Text list of the data files of the table at ``path``, for SQL engines that read such lists.

    The file listing is itself a table (only paths are read, no contents). Spark keeps the status of
    every file of such a scan on the driver, as it does for any scan: some 100 bytes a file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("value"))
    )
    target = f"{path.rstrip('/')}/{MANIFEST}"
    files.write.mode("overwrite").text(target)
    return target


def expose(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Make the table at ``path`` available to ``spark.sql`` as ``name``."""
    table = read_table(spark, path)
    table.createOrReplaceTempView(name)
    return table


def save_as(df: DataFrame, name: str) -> None:
    """Keep ``df`` as a table of the session's catalog."""
    df.write.mode("overwrite").saveAsTable(name)
