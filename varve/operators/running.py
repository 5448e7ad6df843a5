"""Running aggregates and ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.shared import materialize


# How many low bits of an image are still open after each round of the exact median.
ROUNDS = (52, 35, 18, 0)
LARGEST, LEAST_NORMAL = 1.7976931348623157e308, 2.2250738585072014e-308


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    tops: Mapping[str, str] | None = None,
    whole: Mapping[str, str] | None = None,
    lows: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums and running maxima, up to and with each row, in the order of ``order``.

    ``sums`` and ``tops`` map a new column to the one it runs over, ``whole`` maps one to the
    running sum of which it is to be the end, and ``lows`` one to the column whose minimum from
    each row on it is to be. A window by group would bring a group into one task.
    Here the rows are range-partitioned by group and order, so a large group lies in many ranges;
    each range runs on its own, and the totals of the ranges before it (one row per group and
    range) are joined to it, which needs no further shuffle of the rows. For an even split (``by``,
    ``order``) should be unique. The placement in ranges is written down, so that a retried task
    finds the same ranges. Groups are not to be null.
    """
    sums, tops, whole, lows = (dict(given or {}) for given in (sums, tops, whole, lows))
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id())
    )
    within = Window.partitionBy(*by, "_range")
    here = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    onward = within.orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(
        *(F.sum(column).alias(out) for out, column in sums.items()),
        *(F.max(column).alias(out) for out, column in tops.items()),
        *(F.min(column).alias(out) for out, column in lows.items()),
    )
    carried = totals.select(
        *by,
        "_range",
        *(F.sum(out).over(before).alias(f"_{out}") for out in sums),
        *(F.max(out).over(before).alias(f"_{out}") for out in tops),
        *(F.min(out).over(after).alias(f"_{out}") for out in lows),
        *(F.sum(column).over(group).alias(out) for out, column in whole.items()),
    )
    local = placed.select(
        "*",
        *(F.sum(column).over(here).alias(out) for out, column in sums.items()),
        *(F.max(column).over(here).alias(out) for out, column in tops.items()),
        *(F.min(column).over(onward).alias(out) for out, column in lows.items()),
    )
    combined = {out: F.col(out) + F.coalesce(F.col(f"_{out}"), F.lit(0)) for out in sums}
    combined |= {out: F.greatest(F.col(out), F.col(f"_{out}")) for out in tops}
    combined |= {out: F.least(F.col(out), F.col(f"_{out}")) for out in lows}
    joined = local.join(carried, on=[*by, "_range"])
    return joined.withColumns(combined).drop("_range", *(f"_{out}" for out in [*sums, *tops, *lows]))


def ordered_image(value: Column) -> Column:
    """A long for each double, in the same order; only equal doubles (and the two zeros) share one."""
    size = F.least(F.abs(value), F.lit(LARGEST))
    near = F.floor(F.log2(size))
    power = lambda exponent: F.pow(F.lit(2.0), exponent)
    exponent = F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    fraction = ((size / power(exponent) - 1) * power(F.lit(52))).cast("long")
    normal = (exponent + 1023) * F.lit(1 << 52) + fraction
    small = (F.least(size, F.lit(LEAST_NORMAL)) * power(F.lit(537)) * power(F.lit(537))).cast("long")
    image = F.when(size < LEAST_NORMAL, small).otherwise(normal)
    return F.when(F.abs(value) > LARGEST, F.lit(2047 << 52)).otherwise(image) * F.when(value < 0, -1).otherwise(1)


def exact_median(
    df: DataFrame, by: str, value: str, copies: str, out: str = "median", few: bool = False, image: str | None = None
) -> DataFrame:
    """Exact median per group of the double ``value``, each counted ``copies`` times; no value is null.

    Rows are not sorted, gathered or moved. The bits of the image of the middle values are settled
    from the top, 12 to 18 a round: rows whose image begins with the bits settled so far are counted
    by the next bits, which combines before the shuffle to at most 524,288 counts a group, and the
    running count tells which bits the middle has. ``df`` is read once a round, so it should be
    stored, with the column ``image`` of its images to save their computation. ``few`` says that the
    groups are few enough to broadcast a row for each.
    """
    rows = df.select(
        by, F.col(value).alias("value"), F.col(copies).alias("copies"),
        (F.col(image) if image else ordered_image(F.col(value))).alias("image"),
    )
    in_order = Window.partitionBy(by).orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    settled = None
    for settles, open_bits in enumerate(ROUNDS):
        asked = rows.withColumn("bits", F.shiftright("image", open_bits))
        ranks = []
        if settled is not None:
            begin = F.shiftright("image", ROUNDS[settles - 1])
            asked = asked.join(F.broadcast(settled) if few else settled, by)
            asked = asked.filter((begin == F.col("low")) | (begin == F.col("high")))
            ranks = [F.max(name).alias(name) for name in ("below", "lower", "upper")]
        tallied = asked.groupBy(by, "bits").agg(F.sum("copies").alias("n"), F.max("value").alias("value"), *ranks)
        if settled is None:
            total = F.sum("n").over(Window.partitionBy(by))
            tallied = tallied.withColumn("total", total).selectExpr(
                "*", "0L AS below", "(total - 1) div 2 AS lower", "total div 2 AS upper"
            )
        tallied = tallied.withColumn("upto", F.col("below") + F.sum("n").over(in_order))
        start = F.col("upto") - F.col("n")

        def at(rank, what):
            return F.max(F.when((start <= F.col(rank)) & (F.col(rank) < F.col("upto")), what))

        settled = tallied.groupBy(by).agg(
            at("lower", F.col("bits")).alias("low"),
            at("upper", F.col("bits")).alias("high"),
            at("lower", start).alias("below"),
            F.max("lower").alias("lower"),
            F.max("upper").alias("upper"),
            ((at("lower", F.col("value")) + at("upper", F.col("value"))) / 2).alias(out),
        )
    return settled.select(by, out)
