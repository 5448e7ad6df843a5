"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.shared import materialize


def _minima(links: DataFrame) -> DataFrame:
    """Stored, so that Spark can split a heavy key in the joins that follow."""
    return materialize(links.groupBy("a").agg(F.min("b").alias("least")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is connected to, for every node of ``links`` (a, b).

    In turns, every node hands its least neighbour to its larger neighbours (a large star) and then
    to its smaller ones (a small star), until the links no longer change; that takes about the
    logarithm of the longest path. Minima are combined before the shuffle, so a node with very
    many links is never gathered in one task, and every round is written to shared storage.
    """
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minima(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = materialize(large.distinct())
        downward = _minima(large)
        met = large.join(downward, "a")
        small = met.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        after = materialize(small.unionByName(downward.select("a", F.col("least").alias("b"))).distinct())
        if after.count() == links.count() and after.join(links, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = after
