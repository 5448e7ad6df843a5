import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve import shared
from varve.operators import chains, lowess_blocks
from varve.operators.lowess import lowess
from varve.operators.tricube import moments, node_sums, pair_sums
from varve.operators.tricube import smooth as smooth_places


def one_by_one(x, y, frac=0.2, it=3, delta=0.0):
    """The definition, target after target, with a window that slides along the sorted series.

    With ``delta``, targets follow each other in jumps, and what they pass over lies on lines.
    """
    order = np.lexsort((y, x))
    xs, ys, n = x[order], y[order], len(x)
    k = min(max(int(frac * n + 1e-10), 2), n)
    robust = np.ones(n)
    for again in range(it + 1):
        fit, left = np.zeros(n), 0
        for i in range(n):
            if i and xs[i] == xs[i - 1]:
                fit[i] = fit[i - 1]
                continue
            while left + k < n and xs[i] > (xs[left] + xs[left + k]) / 2:
                left += 1
            window = np.arange(left, left + k)
            radius = max(xs[i] - xs[left], xs[left + k - 1] - xs[i])
            if radius == 0:  # a tie longer than the window counts whole, whatever its order
                window = np.flatnonzero(xs == xs[i])
            wx, wy = xs[window], ys[window]
            d = np.abs(wx - xs[i]) / (radius or 1)
            w = np.select([d <= 0.001, d >= 0.999], [1.0, 0.0], (1 - d**3) ** 3) * robust[window]
            if w.sum() <= 0:
                fit[i] = ys[i]
                continue
            w /= w.sum()
            middle = (w * wx).sum()
            spread = max((w * (wx - middle) ** 2).sum(), 1e-12)
            fit[i] = (w * (1 + (xs[i] - middle) * (wx - middle) / spread) * wy).sum()
        last = xs[0]
        while delta > 0 and last < xs[-1]:
            within, beyond = xs[(xs > last) & (xs <= last + delta)], xs[xs > last]
            to = within[-1] if len(within) else beyond[0]
            ends = [fit[np.flatnonzero(xs == place)[0]] for place in (last, to)]
            passed = (xs > last) & (xs < to)
            fit[passed] = ends[0] + (xs[passed] - last) / (to - last) * (ends[1] - ends[0])
            last = to
        if again < it:
            rest = np.abs(ys - fit)
            median = np.median(rest)
            u = rest / (6 * median) if median > 0 else (rest > 0).astype(float)
            robust = np.select([u <= 0.001, u >= 0.999], [1.0, 0.0], (1 - u * u) ** 2)
    out = np.empty(n)
    out[order] = fit
    return out


def smooth(x, y, frac, it, delta=0.0):
    places, fit = smooth_places(x, y, np.ones(len(x), int), frac, it, delta)
    return fit[np.searchsorted(places, x)]


def series(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "months":
        x = np.array([(1910 + i // 12) * 100 + i % 12 + 1 for i in range(n)], float)
    elif kind == "even":
        x = np.sort(rng.uniform(0, 100, n))
    elif kind == "ties":
        x = rng.integers(0, max(3, n // 8), n).astype(float)
    elif kind == "heavy tie":
        x = np.where(rng.random(n) < 0.4, 5.0, rng.uniform(0, 10, n))
    else:
        x = np.concatenate([rng.normal(size=n // 2), 1e5 + rng.exponential(size=n - n // 2) ** 3])
    return x, np.sin(x / (np.ptp(x) / 7)) + rng.standard_t(2, n) * 0.3


KINDS = ["months", "even", "ties", "heavy tie", "gap"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n, frac", [(1, 0.2), (2, 0.2), (7, 0.2), (83, 0.2), (1500, 0.2), (700, 2 / 3), (50, 1.0)])
def test_smooth_follows_the_definition(kind, n, frac):
    x, y = series(kind, n) if n > 2 else (np.arange(n, dtype=float), np.arange(n, dtype=float))
    assert smooth(x, y, frac, 3) == pytest.approx(one_by_one(x, y, frac), rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("share", [0.0, 0.001, 0.03, 0.3, 2.0])
def test_jumps_within_one_task(kind, share):
    x, y = series(kind, 300)
    delta = share * np.ptp(x)
    assert smooth(x, y, 0.2, 3, delta) == pytest.approx(one_by_one(x, y, 0.2, 3, delta), rel=1e-8, abs=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.integers(12, 120), st.floats(-5, 5), st.floats(-50, 50), st.integers(0, 1000))
def test_a_straight_line_stays(n, slope, start, seed):
    x = np.random.default_rng(seed).permutation(n).astype(float)
    assert smooth(x, start + slope * x, 0.5, 0) == pytest.approx(start + slope * x, abs=1e-7)


def test_an_outlier_is_discounted():
    x = np.arange(60, dtype=float)
    y = x + np.random.default_rng(0).normal(size=60)
    y[30] += 20
    assert abs(smooth(x, y, 0.3, 0)[30] - 30) > 1.5
    assert abs(smooth(x, y, 0.3, 3)[30] - 30) < 0.7


def test_a_target_without_weighted_neighbours_keeps_its_own_value():
    x = np.arange(60, dtype=float)
    y = x + np.random.default_rng(0).normal(size=60) * 0.01
    y[30] += 100
    assert smooth(x, y, 0.3, 3)[30] == y[30]


@pytest.mark.parametrize("side", [-1, 0, 1])
def test_whole_nodes_sum_like_their_points(side):
    rng = np.random.default_rng(1)
    x, radius = rng.uniform(-0.0003, 0.0003, 40), rng.uniform(1.0, 1.2, 40)
    sources = {-1: (-0.9, -0.2), 0: (-0.0004, 0.0004), 1: (0.01, 0.98)}[side]
    z, w, y = rng.uniform(*sources, 200), rng.random(200), rng.normal(size=200)
    center, half = (z.min() + z.max()) / 2, np.ptp(z) / 2
    node = moments(z, center, half, w, w * y)[None, :]
    whole = node_sums(x, radius, np.array([side]), np.array([center]), np.array([half]), node)
    assert whole == pytest.approx(pair_sums(x, radius, z, w, w * y), rel=1e-11, abs=1e-11)


def frame_of(kinds, n):
    parts = [pd.DataFrame(dict(zip("xy", series(kind, n, 5))) | {"g": kind}) for kind in kinds]
    return pd.concat(parts, ignore_index=True)


def test_blocks_and_nodes_give_the_same_fits(spark, monkeypatch):
    # Blocks of 8 points make several levels of nodes out of a short series.
    monkeypatch.setattr(lowess_blocks.fits_of_long_series, "__defaults__", (8,))
    frame = frame_of(["even", "heavy tie", "gap"], 700)
    out = lowess(spark.createDataFrame(frame), "x", "y", by=["g"]).toPandas()
    assert len(out) == len(frame)
    for kind, part in out.groupby("g"):
        assert part.lowess.values == pytest.approx(one_by_one(part.x.values, part.y.values), rel=1e-8, abs=1e-8), kind


@pytest.mark.parametrize("share", [0.004, 0.1])
def test_jumps_along_one_long_and_many_short_series(spark, monkeypatch, share):
    # Spans of 8 points: the long series takes many rounds of doubled jumps, with and without points passed over.
    monkeypatch.setattr(lowess_blocks.fits_of_long_series, "__defaults__", (8,))
    monkeypatch.setattr(chains.chosen_of_series, "__defaults__", (1,))
    rng = np.random.default_rng(8)
    short = pd.DataFrame({"g": rng.integers(0, 12, 400).astype(str), "x": rng.uniform(0, 100, 400).round(1), "y": rng.normal(size=400)})
    frame = pd.concat([frame_of(["even", "heavy tie"], 250), short], ignore_index=True)
    delta = 100 * share
    out = lowess(spark.createDataFrame(frame), "x", "y", by=["g"], frac=0.6, it=1, delta=delta).toPandas()
    assert len(out) == len(frame)
    for g, part in out.groupby("g"):
        wanted = one_by_one(part.x.values, part.y.values, 0.6, 1, delta)
        assert part.lowess.values == pytest.approx(wanted, rel=1e-8, abs=1e-8), g


def test_jumps_of_an_empty_table_and_below_zero(spark):
    df = spark.createDataFrame([], "x int, y double")
    assert lowess(df, "x", "y", delta=1.0).collect() == []
    with pytest.raises(ValueError):
        lowess(df, "x", "y", delta=-1.0)


def test_fewer_than_sixteen_writes_and_one_table_left(spark, monkeypatch, tmp_path):
    written = []
    path = lambda session, name="table": written.append(str(tmp_path / f"{len(written)}")) or written[-1]
    monkeypatch.setattr(shared, "scratch_path", path)
    df = spark.createDataFrame(frame_of(["even"], 60))
    out = lowess(df, "x", "y", by=["g"])
    assert len(written) <= 15 and os.listdir(tmp_path) == [os.path.basename(written[-1])]
    assert out.count() == 60


def test_joins_without_broadcast_give_the_same_fits(spark, monkeypatch):
    monkeypatch.setattr(lowess_blocks.fits_of_long_series, "__defaults__", (16,))
    monkeypatch.setattr(lowess_blocks, "BROADCAST_ROWS", 0)
    frame = frame_of(["heavy tie"], 300)
    out = lowess(spark.createDataFrame(frame), "x", "y", by=["g"], it=1).toPandas()
    assert out.lowess.values == pytest.approx(one_by_one(out.x.values, out.y.values, it=1), rel=1e-8, abs=1e-8)


def test_short_series_need_no_plan_of_blocks(spark, monkeypatch):
    # Batches of 7 rows: series begin and end anywhere in them.
    monkeypatch.setattr(lowess_blocks, "_Plan", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 40, 900), "x": rng.uniform(0, 50, 900).round(0), "y": rng.normal(size=900).round(1)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = lowess(spark.createDataFrame(frame), "x", "y", by=["g"], frac=0.5).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == len(frame)
    for g, part in out.groupby("g"):
        assert part.lowess.values == pytest.approx(one_by_one(part.x.values, part.y.values, 0.5), rel=1e-8, abs=1e-8), g


def test_series_of_many_rows_go_block_by_block(spark, monkeypatch):
    # Blocks of 4 points: 32 rows are short, 33 are long, also where many of them are copies.
    monkeypatch.setattr(lowess_blocks.fits_of_long_series, "__defaults__", (4,))
    ranked, listed = lowess_blocks._ranked, []

    def noted(points, *more):
        listed.extend(row.g for row in points.select("_s.g").distinct().collect())
        return ranked(points, *more)

    monkeypatch.setattr(lowess_blocks, "_ranked", noted)
    short, long = frame_of(["even"], 32), frame_of(["ties"], 33)
    copied = pd.DataFrame({"x": [1.0, 2.0, 3.0] * 20, "y": [0.5, 1.5, 1.0] * 20, "g": "copied"})
    frame = pd.concat([short, long, copied], ignore_index=True)
    out = lowess(spark.createDataFrame(frame), "x", "y", by=["g"], it=1).toPandas()
    assert sorted(listed) == ["copied", "ties"]
    for g, part in out.groupby("g"):
        assert part.lowess.values == pytest.approx(one_by_one(part.x.values, part.y.values, it=1), rel=1e-8, abs=1e-8), g


@pytest.mark.parametrize("spread", [True, False])
def test_long_and_short_series_nulls_and_null_keys(spark, spread):
    frame = frame_of(["even", "ties"], 120)
    frame = frame[(frame.g == "even") | (frame.index % 4 == 0)]
    df = spark.createDataFrame(frame).withColumn("g", F.when(F.col("g") == "even", F.col("g")))
    odd = spark.createDataFrame([("even", None, 1.0), ("even", 1.0, float("nan")), (None, 2.0, None)], "g string, x double, y double")
    out = lowess(df.unionByName(odd), "x", "y", by=["g"], out="fit", it=1, spread=spread).toPandas()
    assert out.fit.isna().sum() == 3 and len(out) == len(frame) + 3
    kept = out[out.fit.notna()]
    for _, part in kept.groupby("g", dropna=False):
        assert part.fit.values == pytest.approx(one_by_one(part.x.values, part.y.values, it=1), rel=1e-8, abs=1e-8)


def test_copies_of_one_row_in_a_long_series(spark, monkeypatch):
    monkeypatch.setattr(lowess_blocks.fits_of_long_series, "__defaults__", (16,))
    x, y = series("even", 150, 2)
    x, y = np.concatenate([x, np.full(80, x[70])]), np.concatenate([y, np.full(80, y[70])])
    out = lowess(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", it=1).toPandas()
    assert out.lowess.values == pytest.approx(one_by_one(out.x.values, out.y.values, it=1), rel=1e-8, abs=1e-8)


def test_other_columns_and_types_stay(spark):
    df = spark.sql("SELECT id, CAST(id AS float) AS y, date_add(date'2020-01-01', CAST(id AS int)) AS d, IF(id > 5, NULL, 'a') AS t FROM range(20)")
    out = lowess(df, "id", "y", out="s", spread=False)
    assert out.dtypes == df.dtypes + [("s", "double")]
    assert sorted(map(tuple, out.drop("s").collect())) == sorted(map(tuple, df.collect()))


def test_columns_of_any_name_survive(spark):
    names = ["_s", "_x", "_y", "_row", "fit", "x", "copies", "place.state"]
    df = spark.range(12).select(*((F.col("id") * (i + 2)).alias(name) for i, name in enumerate(names)))
    out = lowess(df, "_x", "place.state", by=["_s"], out="smooth.y", spread=False)
    assert out.columns == [*names, "smooth.y"]
    assert sorted(map(tuple, out.select([F.col(f"`{n}`") for n in names]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        lowess(df, "_x", "_y", out="Fit")


@pytest.mark.parametrize("spread", [True, False])
def test_empty_input(spark, spread):
    df = spark.createDataFrame([], "x int, y double")
    assert lowess(df, "x", "y", spread=spread).collect() == []
