"""Chains of jumps along series of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.operators.running import running
from varve.shared import materialize

BLOCKS_PER_SPAN = 64
DOUBLES = T.ArrayType(T.DoubleType())


def chosen_of_series(ranked: DataFrame, delta: float, series: str, per_span: int = BLOCKS_PER_SPAN) -> DataFrame:
    """``series, x, low, high``: the last chosen point up to each point, and the first from it on.

    ``ranked`` is a stored table of the distinct points ``x`` of each series, in blocks that number
    bounded stretches of them in order. The first point of a series is chosen; after a chosen point
    comes the last one within ``delta`` of it, or the next one if there is none. So the last point
    is chosen too.

    The choice depends on all earlier ones, yet no step follows a series from its start. Some blocks
    make a span. Within each span, one task finds for every point at which one its chain would leave
    the span. Only points at which some chain enters a span matter further: their jumps from span to
    span are doubled until none is left, which takes as many rounds as the logarithm of the most
    jumps, and the points reached from the first one are gathered on the way. They tell where the
    real chain enters each span, so that all spans can follow it at once.
    """
    at = [series, "x"]
    spans = materialize(
        _jumps(ranked, delta, series)
        .groupBy(series, F.expr(f"block div {per_span}").alias("span"))
        .agg(F.sort_array(F.collect_list(F.struct("x", "next"))).alias("p"))
        .select(series, "span", F.col("p.x").alias("x"), F.col("p.next").alias("next"))
    )
    left = spans.select(series, "span", "x", _exits("x", "next").alias("exit"))
    starts = spans.filter(F.col("span") == 0).select(series, F.col("x")[0].alias("x"))
    entered = left.select(series, F.explode(F.array_distinct("exit")).alias("x")).filter("x IS NOT NULL").distinct()
    one = F.explode(F.arrays_zip("x", "exit")).alias("one")
    exits = left.select(series, "span", one).select(series, "span", "one.x", "one.exit")
    exits = materialize(exits.join(entered.unionByName(starts).distinct(), at, "left_semi"))
    reached, jumps = starts, exits.filter("exit IS NOT NULL").select(*at, F.col("exit").alias("to"))
    while not jumps.isEmpty():
        onward = reached.join(jumps, at).select(series, F.col("to").alias("x"))
        reached = materialize(reached.unionByName(onward).distinct())
        again = jumps.select(series, F.col("x").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(again, [series, "to"]).select(*at, F.col("beyond").alias("to")))
    entries = exits.join(reached, at).select(series, "span", F.col("x").alias("entry"))
    marked = spans.join(entries, [series, "span"], "left").select(
        series, F.explode(F.arrays_zip("x", _followed("x", "next", "entry").alias("mark"))).alias("one")
    )
    marked = marked.select(series, "one.x", "one.mark")
    return materialize(running(marked, [series], ["x"], tops={"low": "mark"}, lows={"high": "mark"}).drop("mark"))


def _jumps(ranked: DataFrame, delta: float, series: str) -> DataFrame:
    """The point that would be chosen next after each, null after the last."""
    point = F.col("x")
    known = ranked.select(series, "block", "x", point.alias("at"), F.lit(0).alias("kind"), point.alias("point"))
    asked = ranked.select(series, "block", "x", (point + delta).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("point"))
    found = running(known.unionByName(asked), [series], ["at", "kind"], tops={"within": "point"}, lows={"after": "point"})
    following = F.when(F.col("within") > F.col("x"), F.col("within")).otherwise(F.col("after"))
    return found.filter(F.col("kind") == 1).select(series, "block", "x", following.alias("next"))


@F.pandas_udf(DOUBLES)
def _exits(x: pd.Series, following: pd.Series) -> pd.Series:
    """Per span the first point beyond it of the chain from each of its points."""
    return pd.Series([_ends(a, np.array(b, float)) for a, b in zip(x, following)])


def _ends(x, following):
    inside = np.searchsorted(x, following).tolist()
    ends = [None if np.isnan(point) else point for point in following.tolist()]
    for at in range(len(x) - 1, -1, -1):
        if ends[at] is not None and inside[at] < len(x):
            ends[at] = ends[inside[at]]
    return ends


@F.pandas_udf(DOUBLES)
def _followed(x: pd.Series, following: pd.Series, entry: pd.Series) -> pd.Series:
    """Per span its points, null but for those of the chain from ``entry`` on."""
    return pd.Series([_marks(a, np.array(b, float), first) for a, b, first in zip(x, following, entry)])


def _marks(x, following, entry):
    marks = [None] * len(x)
    inside = np.searchsorted(x, following).tolist()
    at = len(x) if pd.isna(entry) else int(np.searchsorted(x, entry))
    while at < len(x):
        marks[at] = float(x[at])
        at = len(x) if np.isnan(following[at]) else inside[at]
    return marks
