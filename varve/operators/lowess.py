"""Robust locally weighted regression (LOWESS) of many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.lowess_blocks import fits_of_long_series, fits_within_tasks
from varve.shared import col, materialize, removed_after


def lowess(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    frac: float = 0.2,
    it: int = 3,
    out: str = "lowess",
    spread: bool = True,
    delta: float = 0.0,
) -> DataFrame:
    """Add ``out``, the smoothed ``y`` over ``x`` within each series named by ``by``.

    A fit is a line through the ``frac`` share of the series nearest in x, by tricube weights; it
    is repeated ``it`` times with bisquare weights that discount points far off the last fit. Rows
    whose x or y is null or not finite take no part and get null; rows with equal x get one value,
    and a tie longer than the neighbourhood counts whole, whatever the order of its rows.

    With ``delta`` above 0, lines are fitted at chosen points only, and the values between two of
    them lie on the straight line that joins theirs. The first point of a series is chosen, and
    after a chosen point the last one within ``delta`` of it, or else the next one.

    Series of any length are spread over the cluster: those of more rows than ``FANOUT`` blocks hold go
    block by block, any number of shorter ones each within a task. Where every series is known
    to be short, such as one value a month, ``spread=False`` looks for no longer ones: the same
    values without that search. Only the distinct points are written to the
    shared folder, and removed again but for the fits; ``df`` itself is evaluated twice, so
    materialize it first if it is expensive or not deterministic.
    """
    if not delta >= 0:
        raise ValueError(f"delta below 0: {delta}")
    if out.lower() in (name.lower() for name in df.columns):
        raise ValueError(f"column in use: {out}")
    series = F.struct(*map(col, by)) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(
        F.struct(*map(col, df.columns)).alias("_row"),
        series.alias("_s"),
        col(x).cast("double").alias("_x"),
        col(y).cast("double").alias("_y"),
    )
    usable = _finite("_x") & _finite("_y")
    points = rows.filter(usable).groupBy("_s", F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.count("*").alias("copies"))
    if spread:
        with removed_after(df.sparkSession):
            fits = fits_of_long_series(materialize(points), frac, it, delta)
    else:
        fits = materialize(fits_within_tasks(points, frac, it, delta))
    smoothed = rows.filter(usable).join(fits.withColumnRenamed("x", "_x"), ["_s", "_x"], "left")
    left_out = rows.filter(~usable).select("_row.*", F.lit(None).cast("double").alias(out))
    return smoothed.select("_row.*", F.col("fit").alias(out)).unionByName(left_out)


def _finite(name: str):
    value = F.col(name)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
