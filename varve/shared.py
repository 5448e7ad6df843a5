"""Shared storage, and joins against tables whose size is checked first."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

_stored: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def col(name: str) -> Column:
    """The column of exactly that name, whatever dots or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it.

    Only a local session that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="varve-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/varve-{name}-{uuid4().hex}"


def materialize(df: DataFrame, outlast: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read instead of a recomputation, and values
    that depend on how rows were placed in partitions stay as they were. The table is removed at the
    end of the ``removed_after`` block it is written in, or stays if that is to be ``outlast``-ed.
    """
    path = scratch_path(df.sparkSession)
    stored = _stored.get()
    if stored is not None and not outlast:
        stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that the block materializes when it ends, also with an error."""
    before = _stored.set([])
    try:
        yield
    finally:
        paths = _stored.get()
        _stored.reset(before)
        for path in paths:
            files, place = file_system(spark, path)
            files.delete(place, True)


def file_system(spark: SparkSession, path: str):
    """The store that holds ``path``, and the path as it names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows, of at most ``size`` bytes together as JSON text."""
    widths = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("width")).limit(rows + 1)
    found, total = widths.agg(F.count("*"), F.sum("width")).first()
    return found <= rows and (total or 0) <= size


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``facts``, where one key may hold a large share of the rows, to ``lookup``.

    A lookup of at most ``rows`` rows and ``BROADCAST_BYTES`` is broadcast. Beyond that the heavy keys
    of ``facts`` are told apart: those that hold more rows than an average shuffle partition, so
    fewer than there are partitions. Their part of the lookup, one row per key, is broadcast; the
    rest, in which no key is heavy, is shuffled. Both tables are read more than once and so should
    be materialized; ``lookup`` is unique in ``on``, its rows take some kilobytes at most, and no
    key is null.
    """
    if fits_broadcast(lookup, rows):
        return facts.join(F.broadcast(lookup), on=list(on), how=how)
    counts = materialize(facts.groupBy(*on).agg(F.count("*").alias("_n")))
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = counts.agg(F.sum("_n") / partitions).scalar()
    heavy = F.broadcast(materialize(counts.filter(F.col("_n") > share).select(*on)))
    common = facts.join(heavy, on=list(on), how="left_anti").join(lookup, on=list(on), how=how)
    crowded = facts.join(heavy, on=list(on), how="left_semi").join(
        F.broadcast(lookup.join(heavy, on=list(on), how="left_semi")), on=list(on), how=how
    )
    return common.unionByName(crowded)
