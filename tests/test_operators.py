import os
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.operators import combine
from varve.operators.columns import add_year_month, drop, keep, rename, sanitize_names
from varve.operators.combine import _in_cells, _parts, _tasks, count_by, exact_mean_by, grid_join, join_on, mean_by
from varve.operators.rows import distinct_rows, first_per_key, in_box, in_list, in_table, not_all_null, share_over
from varve.operators.running import exact_median, ordered_image, running
from varve.plans.gold import change_on_previous, correlations, ranked
from varve.shared import fits_broadcast, lookup_join, materialize, removed_after

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, "x")], "`a b` int, `c(5)` int, d string")
    assert sanitize_names(df).columns == ["a_b", "c5", "d"]
    assert keep(df, ["d", "a b"]).columns == ["d", "a b"]
    assert rename(df, {"a b": "e", "missing": "f"}).columns == ["e", "c(5)", "d"]
    assert drop(df, "d").columns == ["a b", "c(5)"]
    with pytest.raises(ValueError, match="share a name"):
        sanitize_names(spark.createDataFrame([(1, 2)], "`a b` int, `A_b` int"))


@quick
@given(st.lists(st.text(alphabet="ab ()_", min_size=1, max_size=6), min_size=1, max_size=4))
def test_sanitized_names_hold_no_banned_character(spark, names):
    df = spark.range(1).select(*(F.lit(0).alias(f"{i}{n}") for i, n in enumerate(names)))
    assert not set("".join(sanitize_names(df).columns)) & set(" ()")


def test_add_year_month(spark):
    df = spark.sql("SELECT date'2011-03-04' AS Date UNION ALL SELECT CAST(NULL AS date)")
    assert set(rows(add_year_month(df, "Date").select("Year", "Month"))) == {(2011, 3), (None, None)}


def test_filters(spark):
    df = spark.createDataFrame(
        [("a", "-10.41", 113.09), ("a", "-43.38", 153.38), ("b", "-10.4", 120.0), ("c", "abc", 120.0), ("d", "", 120.0),
         ("e", None, 120.0), (None, "-20", 120.0), ("f", "-20", 153.4)],
        "k string, lat string, lon double",
    )
    boxed = in_box(df, lat=(-43.38, -10.41), lon=(113.09, 153.38))
    assert sorted(rows(boxed.select("lat", "lon"))) == [("-10.41", 113.09), ("-20", 120.0), ("-43.38", 153.38)]
    assert {r[0] for r in rows(in_list(df, "k", ["a", "f", "z"]))} == {"a", "f"}
    nulls = spark.createDataFrame([(None, None), (1, None), (None, "x")], "a int, b string")
    assert not_all_null(nulls).count() == 2


def test_numeric_bounds_reach_the_scan(spark):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = in_box(customers, c_acctbal=(1.0, 2.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,1.0)" in plan and "LessThanOrEqual(c_acctbal,2.0)" in plan


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [("a", None, 3, "late"), ("a", None, 1, "early"), ("a", "x", 2, "other"), (None, None, 5, "null"), (None, None, 4, "first")],
        "k string, m string, at int, v string",
    )
    first = first_per_key(df, ["k", "m"], ["at"])
    assert first.columns == df.columns
    assert {r[3] for r in rows(first)} == {"early", "other", "first"}
    assert sorted(rows(first_per_key(first, ["k", "m"], ["at"])), key=str) == sorted(rows(first), key=str)


def test_first_per_key_takes_columns_of_any_type(spark):
    df = spark.sql("SELECT id % 2 AS k, -id AS at, map('id', id) AS m, array(id) AS `a.b` FROM range(10)")
    first = first_per_key(df, ["k"], ["at"])
    assert first.columns == df.columns
    assert sorted((r.k, r.m["id"], r["a.b"]) for r in first.collect()) == [(0, 8, [8]), (1, 9, [9])]


def test_first_per_key_combines_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    plan = first_per_key(df, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None)], "a int, b string")
    assert distinct_rows(df).count() == 3


def test_share_over(spark):
    def over(counts):
        df = spark.createDataFrame(counts, "k string, n bigint")
        return sorted(r[0] for r in rows(share_over(df, "n", 5.0)))

    assert over([("edge", 5), ("above", 6), ("most", 89)]) == ["above", "most"]
    assert over([]) == []
    assert over([("a", 0), ("b", 0)]) == []


@quick
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12))
def test_share_over_agrees_with_arithmetic(spark, counts):
    df = spark.createDataFrame(list(enumerate(counts)), "k int, n bigint")
    total = sum(counts)
    expected = [i for i, n in enumerate(counts) if total and n / total * 100 > 5]
    assert sorted(r.k for r in share_over(df, "n", 5.0).collect()) == expected


def test_aggregates_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    assert rows(count_by(df, ["k"], "v", "n"), "k") == [("a", 1), ("b", 0)]
    assert rows(mean_by(df, ["k"], "v", "m"), "k") == [("a", 1.0), ("b", None)]


def test_join_multiplies_and_drops_null_keys(spark):
    index = spark.createDataFrame([(2000, 1.0), (2000, 2.0), (2001, 3.0), (None, 4.0)], "Year int, g float")
    counts = spark.createDataFrame([(2000, 5), (None, 6)], "Year int, c int")
    means = spark.createDataFrame([(2000, 0.1), (2001, 0.2), (None, 0.3)], "Year int, m double")
    joined = join_on(index, counts, means, on="Year")
    assert joined.columns == ["Year", "g", "c", "m"]
    assert rows(joined, "g") == [(2000, 1.0, 5, 0.1), (2000, 2.0, 5, 0.1)]


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_of_heavy_keys_and_by_broadcast(spark, limit, how):
    facts = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = lookup_join(facts, lookup, ["k"], how=how, rows=limit)
    plain = facts.join(lookup, on="k", how=how)
    assert sorted(rows(joined), key=str) == sorted(rows(plain), key=str)


def test_wide_lookups_are_not_broadcast(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("v"))
    assert fits_broadcast(wide, 100, 200_000)
    assert not fits_broadcast(wide, 100, 90_000)
    assert not fits_broadcast(wide, 99, 200_000)


def test_running_across_ranges(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": np.where(np.arange(2000) < 1500, "hot", "cold"), "x": rng.permutation(2000), "v": rng.integers(0, 9, 2000)})
    frame["w"] = rng.integers(0, 10_000, 2000)
    df = spark.createDataFrame(frame)
    out = running(df, ["g"], ["x"], sums={"s": "v"}, tops={"t": "w"}, whole={"all": "s"}).toPandas().sort_values(["g", "x"])
    frame = frame.sort_values(["g", "x"])
    assert out.s.tolist() == frame.groupby("g").v.cumsum().tolist()
    assert out.t.tolist() == frame.groupby("g").w.cummax().tolist()
    assert out["all"].tolist() == frame.groupby("g").v.transform("sum").tolist()


def test_exact_median(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 1001), "v": rng.normal(size=1001).round(1), "c": rng.integers(1, 5, 1001)})
    out = {r.g: r["median"] for r in exact_median(spark.createDataFrame(frame), "g", "v", "c").collect()}
    for g, part in frame.groupby("g"):
        assert out[g] == pytest.approx(np.median(np.repeat(part.v, part.c)), abs=1e-15)


@pytest.mark.parametrize("few", [True, False])
def test_exact_median_of_awkward_numbers(spark, few):
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1 - 2**-53, 1 + 2**-52, 1e308, -1e308, 2.0**-1022, 8.0]
    groups = {0: odd, 1: [3.0], 2: [1.0, 2.0], 3: rng.lognormal(0, 200, 401).tolist(), 4: (-rng.lognormal(0, 3, 400)).tolist(), 5: [7.5] * 10}
    groups[6] = [float("inf")] * 3 + [1.0]
    df = spark.createDataFrame([(g, v, 1) for g, values in groups.items() for v in values], "g int, v double, c int")
    out = {r.g: r["median"] for r in exact_median(df, "g", "v", "c", few=few).collect()}
    assert out == {g: np.median(values) for g, values in groups.items()}


def test_images_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(6)
    bits = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 4000), np.arange(-50, 50) + (1023 << 52), np.arange(50), [1 << 52, (1 << 52) - 1]])
    values = bits.astype(np.int64).view(np.float64)
    values = np.unique(values[np.isfinite(values)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ordered_image(F.col("v")).alias("i"))
    images = [r.i for r in sorted(df.collect(), key=lambda r: r.v)]
    assert all(a < b for a, b in zip(images, images[1:]))


def test_running_minima_from_each_row_on(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 500), "x": rng.permutation(500), "v": rng.normal(size=500)})
    out = running(spark.createDataFrame(frame), ["g"], ["x"], lows={"low": "v"}).toPandas().sort_values(["g", "x"])
    wanted = frame.sort_values(["g", "x"]).iloc[::-1].groupby("g").v.cummin().iloc[::-1]
    assert out.low.tolist() == wanted.tolist()


def test_exact_means_do_not_depend_on_placement(spark):
    rng = np.random.default_rng(9)
    values = [*(rng.normal(size=3000) * 10.0 ** rng.integers(-30, 30, 3000)), 5e-324, -5e-324, 1e308, 1e308, -1e308, 0.1, None]
    frame = [(f"g{i % 3}", None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame([*frame, ("none", None), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), (None, 2.0)], "`g.g` string, v double")
    found = [
        {r[0]: repr(r[1]) for r in exact_mean_by(df.repartition(n).sortWithinPartitions(F.rand(n)), ["g.g"], "v", "m").collect()} for n in (1, 7, 64)
    ]
    assert found[0] == found[1] == found[2]
    for g in ("g0", "g1", "g2"):
        given = [Fraction(v) for key, v in frame if key == g and v is not None]
        assert found[0][g] == repr(float(sum(given) / len(given)))
    assert [found[0][g] for g in ("none", "inf", "nan", None)] == ["None", "inf", "nan", "2.0"]


def test_a_key_hot_on_both_sides_is_dealt_over_a_grid(spark):
    def side(name, n):
        key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 97).cast("string"))
        return spark.range(n).select(key.alias("k.k"), F.col("id").alias(name), F.lit(name).alias("_key"))

    left, right = side("a", 900), side("b", 600).drop("_key")
    joined = grid_join(left, right, "k.k", cell=40)
    assert joined.columns == ["k.k", "a", "_key", "b"]
    wanted = left.toPandas().dropna(subset="k.k").merge(right.toPandas().dropna(subset="k.k"), on="k.k")
    assert sorted(map(tuple, joined.select("a", "b").collect())) == sorted(zip(wanted.a, wanted.b))
    hot = spark.createDataFrame([("hot", 8, 5)], "_key string, _lines long, _columns long")
    cells = _in_cells(left.select(F.col("`k.k`").alias("_key"), F.struct("a").alias("_left")).filter("_key = 'hot'"), hot, "_lines", "_columns", "_i", "_j")
    sizes = [r["count"] for r in cells.groupBy("_i", "_j").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 80
    assert grid_join(left, right.filter("b < 0"), "k.k").collect() == []


def test_what_a_grid_copies_grows_with_the_rows(spark):
    """Small cells of a key that is hot on both sides do not copy each row as often as there are cells."""
    sizes = spark.createDataFrame([(3,), (50,), (51,), (2_400,), (216_000,), (5_000_000,)], "n long")
    assert [r[0] for r in sizes.select(_parts("n", 50)).collect()] == [1, 1, 2, 8, 8, 50]
    assert [r[0] for r in sizes.select(_parts("n", 10**6)).collect()] == [1, 1, 1, 1, 1, 5]
    sides = [spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias(name)) for name, n in (("a", 900), ("b", 600))]
    joined = grid_join(*sides, "k", cell=5)
    assert joined.distinct().count() == joined.count() == 900 * 600


def test_the_tasks_of_a_grid_grow_with_its_pairs(spark, monkeypatch):
    """Few rows of one key make many pairs, which no task makes most of."""
    sides = [spark.range(n, numPartitions=1).select(F.lit(1).alias("k"), F.col("id").alias(name)) for name, n in (("a", 900), ("b", 600))]
    monkeypatch.setattr(combine, "PAIRS", 900 * 600 // 50)
    joined = grid_join(*sides, "k", cell=5)
    made = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == joined.distinct().count() == 900 * 600
    assert len(made) > 20 and max(made) < 900 * 600 / 6
    keys = spark.createDataFrame([(1, 900, 600, 8, 8), (2, 3, 1, 1, 1)], "_key long, _l long, _r long, _lines long, _columns long")
    assert [_tasks(keys), _tasks(keys.filter("_key = 2")), _tasks(keys.filter("_key = 3"))] == [50, 0, 0]
    monkeypatch.setattr(combine, "PAIRS", 1)
    assert _tasks(keys) == 65


def test_a_list_of_any_length(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "`x.x` string")
    listed = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "`x.x` string")
    assert rows(in_table(df, "x.x", listed)) == [("a",), ("a",)]
    assert rows(in_table(df, "x.x", listed.filter("`x.x` = 'c'"))) == []


def test_stored_tables_go_at_the_end_of_a_block(spark):
    def place(df):
        return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]

    with pytest.raises(KeyError), removed_after(spark):
        gone, stays = place(materialize(spark.range(3))), place(materialize(spark.range(3), outlast=True))
        raise KeyError
    assert not os.path.exists(gone) and os.path.exists(stays) and os.path.exists(place(materialize(spark.range(3))))


def test_materialize_keeps_rows_and_types(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS `b c`, CAST(NULL AS date) AS d, named_struct('e', 2) AS s")
    copy = materialize(df)
    assert copy.dtypes == df.dtypes and rows(copy) == rows(df)


def test_analyses(spark):
    df = spark.createDataFrame([(2000, 1.0, 2.0), (2001, 2.0, 4.0), (2003, 4.0, 8.0)], "Year int, a double, b double")
    assert rows(correlations(df, ["a", "b"])) == [("a", "b", pytest.approx(1.0))]
    assert rows(change_on_previous(df, "Year", "a"), "Year") == [(2000, 1.0, None), (2001, 2.0, 1.0), (2003, 4.0, None)]
    groups = spark.createDataFrame([("x", 1), ("z", 3), ("y", 3)], "k string, n int")
    assert [r.k for r in ranked(groups, "n", "k").collect()] == ["y", "z", "x"]


def test_names_with_dots(spark):
    df = spark.createDataFrame([("a", "1", 2), ("a", "3", 4), (None, None, None)], "`place.state` string, `at.x` string, `n.n` int")
    assert in_list(df, "place.state", ["a"]).count() == 2
    assert in_box(df, **{"at.x": (0, 2), "n.n": (0, 9)}).count() == 1
    assert not_all_null(df).count() == 2
    assert count_by(df, ["place.state"], "n.n", "n").filter("n = 2").count() == 1
    assert mean_by(df, ["place.state"], "n.n", "n").filter("n = 3").count() == 1
    assert share_over(df.filter("`n.n` is not null"), "n.n", 50).count() == 1
