import datetime as dt
import json

import numpy as np
import pytest

from varve.operators.tricube import smooth as smooth_places
from varve.plans import full_run, gold, landing, silver
from varve.sources.tables import read_table


def smooth(x, y, frac, it):
    return smooth_places(x, y, np.ones(len(x), int), frac, it)[1]


def event(title, start, lat="-30", lon="140", end="", **more):
    return {"title": title, "startDate": start, "endDate": end, "lat": lat, "lon": lon, **more}


EVENTS = [
    event("Flood - A", "2/17/1983 0:00", note="kept"),
    event("Flood - A", "2/17/1983 0:00", note="same keys"),
    event("Flood - B", "17/2/1983 0:00"),
    event("Flood - C", "3/4/2011 0:00", lat="-10.41", lon="113.09"),
    event("Envionmental - Heatwave", "1/1/2011 0:00"),
    event("Environmental - long drought", "1/1/2012 0:00"),
    event("Flood - no time", "1/1/2012"),
    event("Flood - too far north", "1/1/2012 0:00", lat="-10.40"),
    event("Flood - nowhere", "1/1/2012 0:00", lat="abc"),
    event("Meteor - D", "1/1/2012 0:00"),
    event("Flood", "1/1/2012 0:00"),
    event(None, None, None, None, None),
    event("Bushfire - \"E\", F", "1/2/2012 0:00", note="line\nfeed"),
]


@pytest.fixture
def drops(tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "a.json").write_text(json.dumps({"result": {"records": EVENTS}}))
    years = "".join(f"{y}  0.{y % 100:02d}  {(y - 1980) / 10}\n" for y in range(1980, 2013))
    (tmp_path / "index.txt").write_text("a\nb\nc\nYear No_Smoothing Lowess(5)\n---\n" + years + "1980 0.80 0.0\n")
    months = [(y, m) for y in range(1980, 2013) for m in range(1, 13)]
    lines = [f"{y}{m:02d}01{y}{m:02d}  {np.sin(i):.3f}\n" for i, (y, m) in enumerate(months)]
    (tmp_path / "series.txt").write_text("".join(lines) + lines[0])
    return tmp_path


def test_full_run(spark, drops):
    target = full_run.run(spark, f"{drops}/events", f"{drops}/index.txt", f"{drops}/series.txt", f"{drops}/lake")
    events = read_table(spark, f"{drops}/lake/silver/df_dis_silver")
    assert events.dtypes == [("Category", "string"), ("Date", "date"), ("Lat", "string"), ("Lon", "string")]
    assert sorted(((r.Category, r.Date) for r in events.collect()), key=str) == [
        ("Bushfire", dt.date(2012, 1, 2)),
        ("Drought", dt.date(2012, 1, 1)),
        ("Flood", None),
        ("Flood", dt.date(1983, 2, 17)),
        ("Flood", dt.date(1983, 2, 17)),
        ("Flood", dt.date(2011, 3, 4)),
        ("Heatwave", dt.date(2011, 1, 1)),
    ]
    measures = read_table(spark, f"{target}/consolidated_measures")
    assert measures.dtypes == [
        ("Year", "int"),
        ("Global_Temp_Index_Lowess", "float"),
        ("Disaster_Count_Lowess", "double"),
        ("Temp_Anomaly_Lowess", "double"),
    ]
    assert [(r.Year, r.Disaster_Count_Lowess) for r in measures.orderBy("Year").collect()] == [(1983, 2.0), (2011, 2.0), (2012, 2.0)]
    shares = read_table(spark, f"{target}/categorical_disasters")
    assert {(r.Category, r.Count) for r in shares.collect()} == {("Flood", 3), ("Bushfire", 1), ("Drought", 1), ("Heatwave", 1)}
    series = read_table(spark, f"{target}/temp_anomalies")
    assert [t for _, t in series.dtypes] == ["date", "float", "double", "int", "int"]
    rows = series.orderBy("Date").collect()
    x = np.array([r.Year * 100 + r.Month for r in rows], float)
    y = np.array([r.Anomaly for r in rows], float)
    assert len(rows) == 33 * 12
    assert [r.Anomaly_Lowess for r in rows] == pytest.approx(smooth(x, y, 0.2, 3), abs=1e-9)
    for name in ("consolidated_measures", "categorical_disasters", "temp_anomalies"):
        assert spark.read.text(f"{target}/{name}/_symlink_format_manifest").count() >= 1


def test_a_run_can_be_repeated(spark, drops):
    inputs = (f"{drops}/events", f"{drops}/index.txt", f"{drops}/series.txt", f"{drops}/lake")
    first = [sorted(map(tuple, read_table(spark, f"{full_run.run(spark, *inputs)}/temp_anomalies").collect())) for _ in range(2)]
    assert first[0] == first[1]


def test_landing_removes_duplicates_before_empty_rows(spark, drops):
    landing.land(spark, f"{drops}/events", f"{drops}/index.txt", f"{drops}/series.txt", f"{drops}/out")
    read = lambda name: spark.read.csv(f"{drops}/out/{name}_ingress", header=True, escape='"', multiLine=True)
    events = read("df_dis")
    assert events.count() == len(EVENTS) - 2
    assert [r.note for r in events.filter("title = 'Flood - A'").collect()] == ["kept"]
    assert read("df_glo").columns == ["Year", "No_Smoothing", "Lowess(5)"]
    assert read("df_glo").count() == 33 and read("df_ano").count() == 33 * 12


def test_silver_index_keeps_years_that_differ(spark):
    raw = spark.createDataFrame([("2010", "0.5"), ("2010.0", "0.6"), ("x", "y")], "Year string, Lowess5 string")
    rows = {(r.Year, r.Global_Temp_Index_Lowess and round(r.Global_Temp_Index_Lowess, 3)) for r in silver.silver_index(raw).collect()}
    assert rows == {(2010, 0.5), (2010, 0.6), (None, None)}


def test_silver_series_over_equal_months(spark):
    raw = spark.createDataFrame([(f"{1990 + i // 12}{i % 12 + 1:02d}", str(np.cos(i))) for i in range(96)] + [("199013", "1")], "Date string, Anomaly string")
    rows = silver.silver_series(raw, equal_months=True).orderBy("Date").collect()
    assert rows[0].Date is None and rows[0].Anomaly_Lowess is None
    y = np.array([r.Anomaly for r in rows[1:]], float)
    assert [r.Anomaly_Lowess for r in rows[1:]] == pytest.approx(smooth(np.arange(96.0), y, 0.2, 3), abs=1e-9)


def test_coordinates_can_be_cast(spark):
    raw = spark.createDataFrame([("Flood - A", "1/1/2012 0:00", None, "-30", "140")], "title string, startDate string, endDate string, lat string, lon string")
    assert dict(silver.silver_events(raw).dtypes)["Lat"] == "string"
    assert dict(silver.silver_events(raw, cast_coords=True).dtypes)["Lat"] == "double"


def test_category_without_dates_counts_zero(spark):
    rows = [("a", dt.date(2000, 1, 1))] * 19 + [("b", dt.date(2000, 1, 1))] + [("c", None)] * 30
    events = spark.createDataFrame(rows, "Category string, Date date")
    assert [(r.Category, r.Count) for r in gold.category_shares(events).collect()] == [("a", 19)]
