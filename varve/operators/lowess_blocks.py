"""LOWESS of many series of any length, spread over the cluster.

Equal rows count as one with a number of copies, and rows with equal x as one point with a weight,
so a series has one point per distinct x.
Points in order of x form blocks of at most ``BLOCK``, and some blocks of a series, or those of many
short series, form a pack, which one task fits at a time. A fit needs, for each target, weighted sums
over its neighbourhood. Pairing every target with every neighbour would grow with the square of the
length. Instead, each block of targets takes

* single points only from the blocks in which a weight boundary of one of its targets lies, and
* whole nodes (blocks, or ``FANOUT`` nodes of the level below) in between, where the tricube weight
  is one polynomial and the sums follow exactly from the power sums of the node.

So a block of targets meets a few blocks and a number of nodes that grows with the logarithm of the
length. Which pack needs which blocks and nodes depends on x alone and is written down once; each
pass then sends every block and node once to every pack that needs it, and a task works through
what its packs get as a stream. No step holds a series, or an unbounded part of one, in a task.

A series of no more rows than ``FANOUT`` blocks hold needs none of that: a task that has its points has
all that its fits, medians and weights depend on, and makes all passes. Such series, however many,
are sorted by series and x and smoothed as a stream; the plan of blocks is for the others alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.operators.chains import chosen_of_series
from varve.operators.running import exact_median, ordered_image, running
from varve.operators.tricube import FAR, NEAR, POWERS, fitted, moments, node_sums, pair_sums, smooth
from varve.shared import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, materialize, removed_after

BLOCK = 256
FANOUT = 8
PACK = 16
HELD = 2048
SERIES = "_s"
PLACE = [SERIES, "block"]
POINT = [SERIES, "x"]
# Kinds of rows that a pack gets: its targets, blocks met point by point, nodes met as a whole.
TARGETS, NEAR_BLOCK, WHOLE_NODE = 0, 1, 2
# Sides in the lists of meetings beside -1, 0 and 1 of whole nodes.
BY_POINTS, GEOMETRY = 2, 3


def fits_of_long_series(points: DataFrame, frac: float, it: int, delta: float, block: int = BLOCK) -> DataFrame:
    """``_s, x, fit`` for a materialized table ``_s, x, y, copies`` of distinct points."""
    with removed_after(points.sparkSession):
        rows = points.groupBy(SERIES).agg(F.sum("copies").alias("rows"))
        long = materialize(rows.filter(F.col("rows") > FANOUT * block).select(SERIES))
        partitions = 2 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        short = lookup_join(points, long, [SERIES], "left_anti").repartition(partitions, SERIES)
        fits = fits_within_tasks(short, frac, it, delta)
        if not long.isEmpty():
            points = lookup_join(points, long, [SERIES], "left_semi")
            fits = fits.unionByName(_fits_by_blocks(points, frac, it, delta, block))
        return materialize(fits, outlast=True)


def fits_within_tasks(points: DataFrame, frac: float, it: int, delta: float) -> DataFrame:
    """``_s, x, fit`` for distinct points ``_s, x, y, copies`` of series that each fit a task."""
    place = F.row_number().over(Window.partitionBy(SERIES).orderBy("x", "y"))
    kinds = [points.schema[SERIES], points.schema["x"], T.StructField("fit", T.DoubleType())]

    def run(batches):
        import pyarrow as pa

        def fits(rows):
            x, y, copies, place = (rows.column(name).to_numpy() for name in ("x", "y", "copies", "place"))
            starts = np.flatnonzero(place == 1)
            ends = np.append(starts[1:], len(x))
            fit = [smooth(x[a:b], y[a:b], copies[a:b], frac, it, delta)[1] for a, b in zip(starts, ends)]
            first = np.flatnonzero((place == 1) | (x != np.roll(x, 1)))
            series = rows.column(SERIES).combine_chunks().take(pa.array(first))
            return pa.table([series, pa.array(x[first]), pa.array(np.concatenate(fit))], [SERIES, "x", "fit"]).to_batches()

        # The last series so far may go on in the next batch.
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(held.column("place").to_numpy() == 1)[-1]) if held.num_rows else 0
            if last:
                yield from fits(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from fits(held)

    return points.select(SERIES, "x", "y", "copies", place.alias("place")).mapInArrow(run, T.StructType(kinds))


def _fits_by_blocks(points: DataFrame, frac: float, it: int, delta: float, block: int) -> DataFrame:
    """``_s, x, fit`` for a stored table of distinct points, each pass spread over the blocks of all series."""
    ranked = _ranked(points, frac, block)
    places, between = _with_radii(ranked), None
    if delta > 0:
        between = chosen_of_series(ranked, delta, SERIES)
        chosen = between.select(*POINT, (F.col("x") == F.col("low")).alias("chosen"))
        places = places.join(chosen, POINT)
        points = materialize(points.join(between, POINT).join(ranked.select(*POINT, "block"), POINT))
    plan = _Plan(places if between is not None else places.withColumn("chosen", F.lit(True)))
    blocks = plan.blocks
    for _ in range(it):
        rest = F.abs(F.col("y") - F.col("fit"))
        fits = _at_points(points, plan.fit(blocks), between)
        rests = fits.select(*POINT, "block", "y", "copies", rest.alias("rest"))
        rests = materialize(rests.withColumn("image", ordered_image(F.col("rest"))))
        blocks = materialize(_reweighted(rests, plan.few_series))
    fits = plan.fit(blocks).drop("block")
    if between is not None:
        fits = _at_points(between, fits, between)
    return fits.select(*POINT, "fit")


def _at_points(points: DataFrame, fits: DataFrame, between: DataFrame | None) -> DataFrame:
    """Add the fit at x: that of the chosen point there, or on the line between two chosen ones."""
    if between is None:
        return points.join(fits, POINT)
    fits = materialize(fits)
    at = {name: fits.select(SERIES, F.col("x").alias(name), F.col("fit").alias(f"{name}_fit")) for name in ("low", "high")}
    share = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    line = F.col("low_fit") + share * (F.col("high_fit") - F.col("low_fit"))
    joined = points.join(at["low"], [SERIES, "low"]).join(at["high"], [SERIES, "high"])
    return joined.withColumn("fit", line).drop("low_fit", "high_fit")


def _reweighted(rests: DataFrame, few_series: bool) -> DataFrame:
    """Blocks with weights that discount rows far off the last fit, in terms of its median rest."""
    middle = exact_median(rests, SERIES, "rest", "copies", few=few_series, image="image")
    weight = _bisquare() * F.col("copies")
    weighed = (
        rests.join(F.broadcast(middle) if few_series else middle, SERIES)
        .groupBy(*PLACE, "x")
        .agg(F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("wy"))
    )
    listed = weighed.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("x", "w", "wy"))).alias("p"))
    return listed.select(*PLACE, F.col("p.x").alias("px"), "p.w", "p.wy")


def _bisquare() -> Column:
    rest, middle = F.col("rest"), F.col("median")
    ratio = F.when(middle > 0, F.try_divide(rest, 6 * middle)).otherwise((rest > 0).cast("double"))
    return F.when(ratio <= NEAR, 1.0).when(ratio >= FAR, 0.0).otherwise(F.pow(1 - ratio * ratio, F.lit(2)))


def _ranked(points: DataFrame, frac: float, block: int) -> DataFrame:
    """Distinct x of each series with rank, block and the size ``k`` of a neighbourhood."""
    distinct = points.groupBy(*POINT).agg(
        F.sum("copies").alias("count"),
        F.sum(F.col("copies") * F.col("y")).alias("wy"),
        F.min("y").alias("own_y"),
        F.lit(1).alias("one"),
    )
    ranked = running(distinct, [SERIES], ["x"], sums={"upto": "count", "place": "one"}, whole={"n": "upto"})
    k = F.least(F.greatest(F.floor(F.lit(frac) * F.col("n") + 1e-10), F.lit(2)), F.col("n"))
    return materialize(
        ranked.select(
            *POINT,
            "count",
            "wy",
            "own_y",
            "n",
            k.alias("k"),
            (F.col("upto") - F.col("count")).alias("start"),
            F.expr(f"(place - 1) div {block}").alias("block"),
        )
    )


def _with_radii(ranked: DataFrame) -> DataFrame:
    """Add the radius of the neighbourhood of each x: the distance of its k-th nearest row.

    The neighbourhood that begins at rank l is left behind by targets beyond the middle of the
    values at ranks l and l + k. Both values are constant over stretches of ranks; a stretch begins
    where either one enters another point. In order of the middles, a target lies between the last
    stretch it has left behind, whose right value ends its neighbourhood, and the first it has not,
    whose left value begins it.
    """
    end = F.col("n") - F.col("k")
    nothing = F.lit(None).cast("double")
    changes = ranked.select(SERIES, F.col("start").alias("rank"), F.lit(0).alias("kind"), F.col("x").alias("left"), nothing.alias("right"))
    changes = changes.unionByName(
        ranked.select(SERIES, (F.col("start") - F.col("k")).alias("rank"), F.lit(1).alias("kind"), nothing.alias("left"), F.col("x").alias("right"))
    ).unionByName(
        ranked.filter(F.col("start") + F.col("count") == F.col("n")).select(
            SERIES, end.alias("rank"), F.lit(2).alias("kind"), nothing.alias("left"), F.lit(float("inf")).alias("right")
        )
    )
    stretches = running(changes, [SERIES], ["rank", "kind"], tops={"begin": "left", "end": "right"})
    middle = F.when(F.col("begin").isNull(), float("-inf")).otherwise((F.col("begin") + F.col("end")) / 2)
    kept = ["block", "own_y", "count", "wy"]
    types = dict(ranked.dtypes)
    events = stretches.select(
        SERIES, middle.alias("x"), F.lit(1).alias("kind"), "begin", "end", *(F.lit(None).cast(types[name]).alias(name) for name in kept)
    )
    targets = ranked.select(*POINT, F.lit(0).alias("kind"), nothing.alias("begin"), nothing.alias("end"), *kept)
    found = running(events.unionByName(targets), [SERIES], ["x", "kind"], tops={"right": "end"}, lows={"left": "begin"})
    radius = F.greatest(F.col("x") - F.col("left"), F.col("right") - F.col("x"))
    return found.filter(F.col("kind") == 0).select(*POINT, radius.alias("radius"), *kept)


class _Plan:
    """Which blocks and nodes each pack of targets takes: a matter of x alone, so settled once."""

    def __init__(self, places: DataFrame):
        members = F.struct("x", "radius", "own_y", F.col("count").cast("double").alias("w"), "wy", "chosen")
        grouped = materialize(
            places.groupBy(*PLACE)
            .agg(F.sort_array(F.collect_list(members)).alias("t"), F.min("x").alias("low"), F.max("x").alias("high"), *_boundaries())
            .withColumn("id", F.monotonically_increasing_id())
        )
        name = F.when(F.col("block") == 0, F.octet_length(F.to_json(SERIES)))
        most, total, series, size = grouped.agg(F.max("block"), F.count("*"), F.count(name), F.sum(name)).first()
        self.few_series = series <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
        self.levels = 1
        while FANOUT**self.levels <= (most or 0):
            self.levels += 1
        bags = -(-total // PACK) or 1
        self.pack = F.pmod(F.xxhash64(SERIES), F.lit(bags)) * F.lit(1 << 32) + F.expr(f"block div {PACK}")
        self.blocks = grouped.select(*PLACE, F.col("t.x").alias("px"), "t.w", "t.wy")
        chosen = F.filter("t", lambda one: one["chosen"])
        self.targets = grouped.withColumn("t", chosen).filter(F.size("t") > 0).select(
            self.pack.alias("pack"), F.lit(TARGETS).alias("kind"), *PLACE, F.array("id").alias("ids"), F.lit(0).alias("side"),
            F.col("t.x").alias("a"), F.col("t.radius").alias("b"), F.col("t.own_y").alias("c"),
        )
        bounds = grouped.drop("t")
        lists = materialize(self._meetings(_with_ranges(bounds)).unionByName(self._geometry(bounds)))
        self.near = lists.filter(F.col("side") == BY_POINTS).select(SERIES, F.col("node").alias("block"), "pack", "ids")
        self.far = lists.filter(F.col("side").between(-1, 1)).select(SERIES, "side", "level", "node", "pack", "ids")
        self.above = lists.filter(F.col("side") == GEOMETRY).select(SERIES, F.col("node").alias("block"), "center", "half")

    def _meetings(self, ranges: DataFrame) -> DataFrame:
        """Per pack the blocks and nodes it takes, with the ids of the target blocks that meet them."""
        between = [("first", "f0"), ("g0", "f1"), ("g1", "f2"), ("g2", "last")]
        points = [_structs(BY_POINTS, 0, f"if({a} < {b}, sequence({a}, {b} - 1), array())") for a, b in between]
        nodes = [piece for zone, side in enumerate((-1, 0, 1)) for piece in self._cover(f"f{zone}", f"g{zone}", side)]
        met = F.explode(F.expr(f"concat({', '.join(points + nodes)})")).alias("one")
        return (
            ranges.select(SERIES, self.pack.alias("pack"), "id", met)
            .groupBy(SERIES, "one.side", "one.level", "one.node", "pack")
            .agg(F.collect_list("id").alias("ids"))
            .withColumns({"center": F.lit(None).cast("array<double>"), "half": F.lit(None).cast("array<double>")})
        )

    def _cover(self, start: str, end: str, side: int) -> list[str]:
        """The fewest aligned nodes that make up blocks ``start`` to before ``end``."""
        pieces = []
        for level in range(self.levels):
            size, above = FANOUT**level, FANOUT ** (level + 1)
            a, b = f"(({start} + {size - 1}) div {size})", f"({end} div {size})"
            up_a, up_b = f"(({start} + {above - 1}) div {above})", f"({end} div {above})"
            whole = f"if({a} < {b}, sequence({a}, {b} - 1), array())"
            if level == self.levels - 1:
                ids = whole
            else:
                head = f"if({a} < {up_a} * {FANOUT}, sequence({a}, {up_a} * {FANOUT} - 1), array())"
                tail = f"if({up_b} * {FANOUT} < {b}, sequence({up_b} * {FANOUT}, {b} - 1), array())"
                ids = f"if({up_a} < {up_b}, concat({head}, {tail}), {whole})"
            pieces.append(_structs(side, level, ids))
        return pieces

    def _geometry(self, blocks: DataFrame) -> DataFrame:
        """Per block the centers and half widths of the nodes above it, lowest level first."""
        levels = F.explode(F.sequence(F.lit(0), F.lit(self.levels - 1))).alias("level")
        listed = blocks.select(*PLACE, "low", "high", levels).withColumn("node", _node_above())
        shapes = (
            listed.groupBy(SERIES, "level", "node")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .select(
                SERIES,
                "level",
                "node",
                ((F.col("low") + F.col("high")) / 2).alias("center"),
                F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 2).otherwise(1.0).alias("half"),
            )
        )
        above = listed.select(*PLACE, "level", "node").join(shapes, [SERIES, "level", "node"])
        listed = above.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("level", "center", "half"))).alias("up"))
        return listed.select(
            SERIES, F.lit(GEOMETRY).alias("side"), F.lit(0).alias("level"), F.col("block").alias("node"),
            F.lit(None).cast("bigint").alias("pack"), F.lit(None).cast("array<bigint>").alias("ids"), "up.center", "up.half",
        )

    def fit(self, blocks: DataFrame) -> DataFrame:
        """``_s, block, x, fit`` at the chosen points, for weights ``w`` and weighted ``wy`` at ``px``."""
        nothing = F.lit(None).cast(blocks.schema[SERIES].dataType).alias(SERIES)
        none = F.lit(None).cast("bigint").alias("block")
        near = self.near.join(blocks, PLACE).select(
            "pack", F.lit(NEAR_BLOCK).alias("kind"), nothing, none, "ids", F.lit(0).alias("side"),
            F.col("px").alias("a"), F.col("w").alias("b"), F.col("wy").alias("c"),
        )
        whole = self.far.join(self._node_moments(blocks), [SERIES, "level", "node"]).select(
            "pack", F.lit(WHOLE_NODE).alias("kind"), nothing, none, "ids", "side",
            F.col("moments").alias("a"), F.array("center", "half").alias("b"), F.array().cast("array<double>").alias("c"),
        )
        partitions = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = self.targets.unionByName(near).unionByName(whole).repartition(partitions, "pack")
        doubles = T.ArrayType(T.DoubleType())
        schema = T.StructType(
            [blocks.schema[SERIES], blocks.schema["block"], T.StructField("x", doubles), T.StructField("fit", doubles)]
        )
        fits = sent.sortWithinPartitions("pack", "kind").mapInArrow(_fit_packs, schema)
        return fits.select(*PLACE, F.explode(F.arrays_zip("x", "fit")).alias("one")).select(*PLACE, "one.x", "one.fit")

    def _node_moments(self, blocks: DataFrame) -> DataFrame:
        """Power sums per node: those of its blocks about the node's center, added up."""
        length = 2 * POWERS
        moved = F.posexplode(_block_moments("px", "w", "wy", "center", "half")).alias("level", "m")
        parts = blocks.join(self.above, PLACE).select(*PLACE, "center", "half", moved)
        summed = parts.groupBy(SERIES, "level", _node_above().alias("node")).agg(
            F.max(F.get("center", "level")).alias("center"),
            F.max(F.get("half", "level")).alias("half"),
            *(F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(length)),
        )
        return summed.select(SERIES, "level", "node", "center", "half", F.array(*(f"m{i}" for i in range(length))).alias("moments"))


class _Targets:
    """A block of targets and what it has met so far."""

    def __init__(self, series, block, x, radius, own_y):
        self.series, self.block, self.x, self.radius, self.own_y = series, block, x, radius, own_y
        self.sums, self.near, self.held, self.nodes = np.zeros((5, len(x))), [], 0, []

    def meet_points(self, *arrays):
        self.near.append(arrays)
        self.held += len(arrays[0])
        if self.held >= HELD:
            self._settle_points()

    def meet_node(self, *node):
        self.nodes.append(node)
        if len(self.nodes) >= HELD:
            self._settle_nodes()

    def _settle_points(self):
        if self.near:
            self.sums += pair_sums(self.x, self.radius, *map(np.concatenate, zip(*self.near)))
        self.near, self.held = [], 0

    def _settle_nodes(self):
        if self.nodes:
            side, center, half, power_sums = map(np.array, zip(*self.nodes))
            self.sums += node_sums(self.x, self.radius, side, center, half, power_sums)
        self.nodes = []

    def fit(self):
        self._settle_points()
        self._settle_nodes()
        return fitted(self.sums, self.radius, self.own_y)


def _fit_packs(batches):
    """Fits of the packs whose rows come in order of pack and kind."""
    import pyarrow as pa

    def fits(targets):
        doubles = pa.list_(pa.float64())
        columns = [
            pa.concat_arrays([one.series for one in targets]),
            pa.array([one.block for one in targets], pa.int64()),
            pa.array([one.x for one in targets], doubles),
            pa.array([one.fit() for one in targets], doubles),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[SERIES, "block", "x", "fit"])

    def lists(batch, name):
        column = batch.column(name)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return lambda row: flat[offsets[row] : offsets[row + 1]]

    now, targets = None, {}
    for batch in batches:
        packs, kinds, sides = (batch.column(name).to_numpy() for name in ("pack", "kind", "side"))
        ids, a, b, c = (lists(batch, name) for name in ("ids", "a", "b", "c"))
        for row in range(batch.num_rows):
            if packs[row] != now:
                if targets:
                    yield fits(targets.values())
                now, targets = packs[row], {}
            if kinds[row] == TARGETS:
                series, block = batch.column(SERIES).slice(row, 1), batch.column("block")[row].as_py()
                targets[ids(row)[0]] = _Targets(series, block, a(row), b(row), c(row))
            elif kinds[row] == NEAR_BLOCK:
                for one in ids(row):
                    targets[one].meet_points(a(row), b(row), c(row))
            else:
                for one in ids(row):
                    targets[one].meet_node(sides[row], *b(row), a(row))
    if targets:
        yield fits(targets.values())


def _boundaries() -> list[Column]:
    """Least and greatest place, over the chosen targets of a block, of each change of the weights."""
    columns = []
    for name, reach in (("a", -FAR), ("b", -NEAR), ("c", NEAR), ("d", FAR)):
        place = F.when(F.col("chosen"), F.col("x") + reach * F.col("radius"))
        columns += [F.min(place).alias(f"{name}_low"), F.max(place).alias(f"{name}_high")]
    return columns


def _with_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks of targets with the block ranges they meet.

    ``f0..g0``, ``f1..g1`` and ``f2..g2`` (ends not included) lie wholly left of, around and right
    of all the targets; what remains of ``first..last`` is met point by point.
    """
    names = [f"{zone}_{end}" for zone in "abcd" for end in ("low", "high")]
    asked = blocks.filter(F.col("a_low").isNotNull()).select(
        *PLACE,
        "id",
        F.explode(F.array(*(F.struct(F.lit(n).alias("which"), F.col(n).alias("value")) for n in names))).alias("one"),
    ).select(SERIES, "one.value", F.lit(1).alias("kind"), "block", "one.which", F.lit(None).cast("bigint").alias("known"), "id")
    known = blocks.select(
        SERIES, F.col("low").alias("value"), F.lit(0).alias("kind"), "block", F.lit("").alias("which"), F.col("block").alias("known"), "id"
    )
    found = running(known.unionByName(asked), [SERIES], ["value", "kind", "block", "which"], tops={"at": "known"})
    found = found.filter(F.col("kind") == 1).withColumn("at", F.coalesce("at", F.lit(-1)))
    ranges = found.groupBy(*PLACE).agg(
        F.max("id").alias("id"), *(F.max(F.when(F.col("which") == name, F.col("at"))).alias(name) for name in names)
    )
    starts = {f"f{i}": F.col(f"{zone}_high") + 1 for i, zone in enumerate("abc")}
    ends = {f"g{i}": F.greatest(F.col(f"{zone}_low"), F.col(f"f{i}")) for i, zone in enumerate("bcd")}
    edges = {"first": F.greatest("a_low", F.lit(0)), "last": F.col("d_high") + 1}
    return ranges.withColumns(starts | edges).withColumns(ends)


def _node_above() -> Column:
    return F.floor(F.col("block") / F.pow(F.lit(FANOUT), F.col("level"))).cast("bigint")


def _structs(side: int, level: int, ids: str) -> str:
    return f"transform(cast({ids} as array<bigint>), n -> struct({side} as side, {level} as level, n as node))"


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _block_moments(px: pd.Series, w: pd.Series, wy: pd.Series, center: pd.Series, half: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [moments(x, c, h, a, b) for c, h in zip(centers, halves)]
            for x, a, b, centers, halves in zip(px, w, wy, center, half)
        ]
    )
