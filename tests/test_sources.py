import csv
import gzip
import io
import json
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.sources import tables
from varve.sources.envelopes import _scan
from varve.sources.quoted import read_quoted_csv
from varve.sources.records import read_records
from varve.sources.splits import cut
from varve.sources.tables import expose, read_csv, read_table, save_as, write_clustered, write_csv, write_manifest, write_table
from varve.sources.text import read_text_series, read_text_table

HEAD = "Index\nof temperatures\n\n Year No_Smoothing  Lowess(5) \r\n----\n"


@pytest.fixture
def split_small(spark):
    """Splits of some ten lines, so that one file is read by many tasks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_text_table(spark, tmp_path):
    path = write(tmp_path / "a.txt", HEAD + "1880  -0.16   -0.09\n1881 -0.08  -0.13\r\n")
    table = read_text_table(spark, path)
    assert table.columns == ["Year", "No_Smoothing", "Lowess(5)"]
    assert sorted(map(tuple, table.collect())) == [("1880", "-0.16", "-0.09"), ("1881", "-0.08", "-0.13\r")]


def test_text_table_without_a_final_line_feed_loses_its_last_line(spark, tmp_path):
    path = write(tmp_path / "a.txt", HEAD + "1880 1 2\n1881 3 4 too many")
    assert [r.Year for r in read_text_table(spark, path).collect()] == ["1880"]


def test_wrong_number_of_fields(spark, tmp_path):
    path = write(tmp_path / "a.txt", HEAD + "1880 1 2\n\n1881 3\n1882 5 6\n")
    with pytest.raises(Exception, match="expected 3 fields"):
        read_text_table(spark, path).collect()
    kept = read_text_table(spark, path, mode="DROPMALFORMED")
    assert sorted(r.Year for r in kept.collect()) == ["1880", "1882"]


def test_large_files_in_many_splits(spark, tmp_path, split_small):
    for name, end in (("a", "\n"), ("b", "")):
        lines = [f"{name}{i}  {i * i} {i}" for i in range(500)]
        write(tmp_path / f"{name}.txt", HEAD + "\n".join(lines) + end)
    table = read_text_table(spark, str(tmp_path), position=True).cache()
    assert table.rdd.getNumPartitions() > 8
    a = table.filter(F.col("Year").startswith("a"))
    assert a.count() == 500 and table.count() == 999
    assert [r.Year for r in a.orderBy("_position").collect()] == [f"a{i}" for i in range(500)]
    assert [r[0] for r in a.orderBy("_position").select("_position.line").collect()] == list(range(5, 505))


def test_files_with_another_header_fail(spark, tmp_path):
    write(tmp_path / "a.txt", HEAD + "1 2 3\n")
    write(tmp_path / "b.txt", HEAD.replace("Year", "Day") + "1 2 3\n")
    with pytest.raises(Exception, match="another header"):
        read_text_table(spark, str(tmp_path), columns=["Year", "No_Smoothing", "Lowess(5)"]).collect()


def test_text_series(spark, tmp_path, split_small):
    write(tmp_path / "a.txt", "".join(f"{1910 + i // 12}{i % 12 + 1:02d}01{1910 + i // 12}{i % 12 + 1:02d}   -{i}.5\n" for i in range(240)))
    series = read_text_series(spark, str(tmp_path))
    assert series.columns == ["Date", "Anomaly"] and series.count() == 240
    assert series.filter("Anomaly = '-13.5'").collect() == [("191102", "-13.5")]


RECORD = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("place", T.StructType([T.StructField("state", T.StringType()), T.StructField("at", T.StructType([T.StructField("x", T.IntegerType())]))])),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
RECORDS = [
    {"title": "Flood - X", "lat": -20.5, "place": {"state": "QLD", "at": {"x": 1}}, "tags": ["a", "b"]},
    {"title": None, "lat": None, "place": None, "tags": []},
]


@pytest.mark.parametrize("schema", [None, RECORD])
def test_records_in_an_envelope(spark, tmp_path, schema):
    write(tmp_path / "a.json", json.dumps({"help": "?", "result": {"records": RECORDS, "total": 2}}, indent=2))
    records = read_records(spark, str(tmp_path), schema)
    assert set(records.columns) == {"title", "lat", "place.state", "place.at.x", "tags"}
    rows = [r.asDict() for r in records.collect()]
    assert {"title": "Flood - X", "lat": -20.5, "place.state": "QLD", "place.at.x": 1, "tags": ["a", "b"]} in rows
    assert {"title": None, "lat": None, "place.state": None, "place.at.x": None, "tags": []} in rows


def test_records_by_line_keep_their_position(spark, tmp_path):
    pages = [{"result": {"records": [{"title": f"{p}-{i}"} for i in range(3)]}} for p in range(4)]
    write(tmp_path / "a.json", "\n".join(map(json.dumps, pages)))
    schema = T.StructType([T.StructField("title", T.StringType())])
    records = read_records(spark, str(tmp_path), schema, multiline=False, position=True)
    assert [r.title for r in records.orderBy("_position").collect()] == [f"{p}-{i}" for p in range(4) for i in range(3)]


def test_csv_round_trip(spark, tmp_path):
    rows = [('He said "hi", ok', "1"), ("two\nlines", None), ("back\\slash", "x y"), ("comma, and 'quote'", "")]
    df = spark.createDataFrame(rows, "`a b(1)` string, c string")
    write_csv(df, f"{tmp_path}/t")
    back = read_csv(spark, f"{tmp_path}/t", multiline=True)
    assert back.columns == df.columns
    expected = [(a, c or None) for a, c in rows]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(expected, key=str)


def test_empty_csv_fields_are_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,\n,"x ""y"" z"\n')
    assert sorted(map(tuple, read_csv(spark, path).collect()), key=str) == [("1", None), (None, 'x "y" z')]


def test_tables_are_replaced_whole_also_from_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    write_table(read_table(spark, path).filter("id > 2"), path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == [3, 4]
    assert expose(spark, "shown", path).count() == spark.sql("SELECT * FROM shown").count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        write_table(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert read_table(spark, path).count() == 5


def test_csv_keeps_blanks_and_writes_nested_fields_as_text(spark, tmp_path):
    texts = ["  lead", "trail  ", '  q"x  ', "\t", "a,b ", "ends\r"]
    rows = spark.createDataFrame([(i, t, [i, 2], (i,)) for i, t in enumerate(texts)], "i int, t string, l array<int>, s struct<a: int>")
    write_csv(rows, str(tmp_path / "c"))
    back = sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), multiline=True).collect()))
    assert back == [(str(i), t, f"[{i},2]", f'{{"a":{i}}}') for i, t in enumerate(texts)]


def test_no_line_is_lost_when_files_are_cut_elsewhere(spark, tmp_path):
    write(tmp_path / "a.txt", HEAD + "".join(f"{i} {i} {i}\n" for i in range(20_000)))
    old = {key: spark.conf.get(key, None) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    table = read_text_table(spark, str(tmp_path), position=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "31")
    try:
        lines = {r["Year"]: r["_position"]["line"] for r in table.collect()}
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert lines == {str(i): i + 5 for i in range(20_000)}


@pytest.mark.parametrize("text", ['{"result": {"records": [{"title"', '{"other": 1}', '{"result": {"records": "none"}}'])
def test_malformed_envelopes_fail_or_go(spark, tmp_path, text):
    write(tmp_path / "a.json", text + "\n" + '{"result": {"records": [{"title": "x"}]}}' + "\n")
    schema = T.StructType([T.StructField("title", T.StringType())])
    with pytest.raises(Exception, match="(?s)MALFORMED|Malformed|without records"):
        read_records(spark, str(tmp_path), schema, multiline=False).collect()
    kept = read_records(spark, str(tmp_path), schema, multiline=False, mode="DROPMALFORMED")
    assert [r.title for r in kept.collect()] == ["x"]


def test_a_saved_table_is_found_by_name(spark):
    for rows in (5, 2):
        save_as(spark.range(rows), "varve_saved")
        assert spark.sql("SELECT count(*) AS n FROM varve_saved").first().n == rows
    spark.sql("DROP TABLE varve_saved")


def test_manifest_lists_the_files_of_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    for rows, parts in ((100, 4), (50, 2)):
        write_table(spark.range(rows).repartition(parts), path)
        listed = [r.value for r in spark.read.text(write_manifest(spark, path)).collect()]
        assert len(listed) == parts
        assert spark.read.parquet(*listed).count() == rows
    assert read_table(spark, path).count() == 50


@pytest.fixture
def splits_of(spark):
    """Sets the bytes of a split."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


AWKWARD = ["two\nlines", 'a "quoted" word', '"', '""\n""', "\n\n", "CR\r\nand LF", "ends in CR\r", ' " , \n" ', "plain", "é\n日本", "", None]


@pytest.mark.parametrize("size", [17, 64, 10_000])
def test_quoted_csv_in_splits_equals_the_read_by_one_task(spark, tmp_path, splits_of, size):
    rows = [(f"{i}", AWKWARD[i % len(AWKWARD)], AWKWARD[(i * 5 + i // 12) % len(AWKWARD)]) for i in range(30)]
    df = spark.createDataFrame(rows, "`a b(1)` string, `x \"y\"` string, c string")
    write_csv(df.coalesce(1), f"{tmp_path}/t")
    whole = read_csv(spark, f"{tmp_path}/t", multiline=True)
    splits_of(size)
    split = read_quoted_csv(spark, f"{tmp_path}/t")
    assert split.columns == whole.columns == df.columns
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(((a, b or None, c or None) for a, b, c in rows), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(*[st.text(alphabet='a",\n\r é', max_size=9)] * 2), max_size=12),
    st.sampled_from(["\n", "\r\n"]),
    st.booleans(),
    st.integers(9, 40),
)
def test_quoted_csv_of_any_text(spark, tmp_path_factory, splits_of, rows, end, final, size):
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([("k", "v"), *rows])
    text = text.getvalue() if final else text.getvalue().removesuffix(end)
    path = write(tmp_path_factory.mktemp("csv") / "a.csv", text)
    splits_of(size)
    found = read_quoted_csv(spark, path)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((a or None, b or None) for a, b in rows), key=str)


def test_one_csv_file_is_read_by_many_tasks_and_records_cross_splits(spark, tmp_path, splits_of):
    long = "\n".join(f'line {i} of "one" field' for i in range(300))
    rows = [(str(i), long if i == 20 else f"text\n{i}") for i in range(60)]
    for name, part in (("a", rows[:40]), ("b", rows[40:])):
        write_csv(spark.createDataFrame(part, "k string, v string").coalesce(1), f"{tmp_path}/t/{name}")
    splits_of(500)
    lines = cut(spark, f"{tmp_path}/t/*", "\n")
    assert lines.rdd.getNumPartitions() > 10
    found = read_quoted_csv(spark, f"{tmp_path}/t/*")
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_quoted_csv_that_is_not_well_formed(spark, tmp_path):
    open_quote = write(tmp_path / "a.csv", 'a,b\n1,"two\nlines\n')
    with pytest.raises(Exception, match="never closed"):
        read_quoted_csv(spark, open_quote).collect()
    write(tmp_path / "c1.csv", "a,b\n1,2\n")
    write(tmp_path / "c2.csv", "a,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        read_quoted_csv(spark, f"{tmp_path}/c*.csv").collect()
    assert read_quoted_csv(spark, write(tmp_path / "e.csv", "")).collect() == []
    bare = read_quoted_csv(spark, write(tmp_path / "h.csv", "a,,A\n\n1\n1,2,3,4\n"))
    assert bare.columns == ["a0", "_c1", "A2"] and sorted(map(tuple, bare.collect()), key=str) == [("1", "2", "3"), ("1", None, None)]


SIGNS = ['}"{[', "\\", '\\"', "a}, {b", "]}", "\n", "é}", "", "result", "records", '"records": [{']


def an_envelope(n, indent=None, before=None, after=None):
    def record(i):
        text = SIGNS[i % len(SIGNS)]
        nested = {"x": text, "deep": {"list": [text, text]}, "list": [{"y": i}, {"y": -i}]} if i % 3 else None
        return {"title": f"{i} {text}", "place": nested, "tags": [text] * (i % 4)}

    given = {"help": "} { a ] [ \" b", "fields": [{"id": "a"}, {"id": "b"}], "x": {"records": [1, [2]]}} | (before or {})
    result = {"fields": [{"id": "}"}, {"id": "b", "info": {"a": [1]}}], "meta": {"a": {}, "b": {"c": 1}}, "records": [record(i) for i in range(n)]}
    return json.dumps(given | {"result": result | {"total": n, "links": {"a": "}"}}} | (after or {}), indent=indent, ensure_ascii=False)


TEXTS = T.ArrayType(T.StringType())
PLACE = T.StructType().add("x", "string").add("deep", T.StructType().add("list", TEXTS)).add("list", T.ArrayType(T.StructType().add("y", T.IntegerType())))
NESTED = T.StructType().add("title", "string").add("place", PLACE).add("tags", TEXTS)


@pytest.mark.parametrize("size", [70, 1000])
@pytest.mark.parametrize("indent", [None, 1])
def test_envelope_in_splits_equals_the_read_by_one_task(spark, tmp_path, splits_of, size, indent):
    write(tmp_path / "a.json", an_envelope(12, indent))
    write(tmp_path / "b.json", an_envelope(3, None, after={"z": [{"a": {}}, {"records": [{}]}]}) + "\n ")
    write(tmp_path / "c.json", an_envelope(0, indent))
    whole = read_records(spark, str(tmp_path), NESTED, mode="DROPMALFORMED").collect()
    splits_of(size)
    split = read_records(spark, str(tmp_path), NESTED, position=True)
    assert sorted(map(tuple, split.drop("_position").collect()), key=str) == sorted(map(tuple, whole), key=str) and len(whole) == 15
    ordered = split.filter("_position.file LIKE '%a.json'").orderBy("_position").collect()
    assert [int(r.title.split()[0]) for r in ordered] == list(range(12))
    if size == 70:
        assert cut(spark, str(tmp_path), "}").rdd.getNumPartitions() > 10


GOOD = '{"result": {"records": [{"a": 1}, {"a": 2}]}}'
BAD = {
    "truncated at the end": GOOD[:-1],
    "truncated in a record": GOOD[:34],
    "truncated in a string": '{"result": {"records": [{"a": "x}, {',
    "no list": '{"result": {"record": [{"a": 1}]}}',
    "list elsewhere": '{"records": [{"a": 1}], "result": {"x": [{"records": [{"a": 1}]}]}}',
    "comma too many": '{"result": {"records": [{"a": 1}, ]}}',
    "comma missing": '{"result": {"records": [{"a": 1} {"a": 2}]}}',
    "another bracket": '{"result": {"records": [{"a": 1}, {"a": 2}}]}',
    "bracket in a record": '{"result": {"records": [{"a": 1}, {"a": [2}, {"a": 3}]}}',
    "no object": '{"result": {"records": [{"a": 1}, null, {"a": 2}]}}',
    "a number": '{"result": {"records": [{"a": 1}, 0]}}',
    "a list": '{"result": {"records": [[1], {"a": 2}]}}',
    "bad record": '{"result": {"records": [{"a": 1}, {"a" 2}]}}',
    "wrong type": '{"result": {"records": [{"a": "x"}]}}',
    "something after": GOOD + " {}",
    "a list of envelopes": "[" + GOOD + "]",
    "blank": " \n",
}


def around(text):
    """Pieces around the records, sign by sign: text, depth, whether in a string, whether without a brace at the end."""
    pieces = text.split("}")
    bare, depth, inside, kept = pieces[-1] != "", 0, False, []
    pieces = pieces if bare else pieces[:-1]
    for at, value in enumerate(pieces):
        last = at == len(pieces) - 1
        begin, low, escaped = (value, depth, inside, bare and last), depth, False
        for sign in value + "}" * (not begin[3]):
            if inside:
                inside, escaped = escaped or sign != '"', sign == "\\" and not escaped
            else:
                inside, depth = sign == '"', depth + (sign in "{[") - (sign in "}]")
            low = min(low, depth)
        further = begin[1] == 3 and not begin[2] and re.match(r"\s*,\s*\{", value)
        if last or low < 3 or not (further or begin[1] > 3):
            kept.append(begin)
    return list(zip(*kept))


def test_what_stands_around_the_records():
    for text in (GOOD, an_envelope(9), an_envelope(9, 1), an_envelope(0), an_envelope(2, after={"z": [[{"a": [{}]}], {"records": [[{}]]}]})):
        error, opens, place, closes = _scan(*around(text))
        assert error is None and opens <= closes and around(text)[0][opens][:place].endswith('"records": [')
    for name in BAD.keys() - {"bad record", "wrong type"}:
        assert _scan(*around(BAD[name]))[0], name


@pytest.mark.parametrize("name", ["truncated in a record", "truncated in a string", "bad record", "wrong type", "something after"])
def test_malformed_envelopes_fail_in_splits(spark, tmp_path, splits_of, name):
    write(tmp_path / "good.json", GOOD)
    write(tmp_path / "bad.json", BAD[name])
    splits_of(16)
    with pytest.raises(Exception, match="envelope|MALFORMED|parse|convert"):
        read_records(spark, str(tmp_path), T.StructType().add("a", T.IntegerType())).collect()


def test_compressed_and_empty_drops(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(gzip.compress((GOOD + "\n").encode()))
    schema = T.StructType().add("a", T.IntegerType())
    assert sorted(r.a for r in read_records(spark, str(tmp_path), schema).collect()) == [1, 2]
    write(tmp_path / "b.json", "")
    assert read_records(spark, str(tmp_path / "b.json"), schema).collect() == []
    with pytest.raises(ValueError, match="no record"):
        read_records(spark, write(tmp_path / "c.json", '{"result": {"records": []}}'))


def test_a_box_on_a_clustered_table_meets_few_files(spark, tmp_path):
    def met(path):
        files = [pq.read_metadata(file).row_group(0) for file in sorted(tmp_path.glob(f"{path}/*.parquet"))]
        bounds = [[(group.column(at).statistics.min, group.column(at).statistics.max) for at in (0, 1)] for group in files]
        return sum(a[0] <= 0.35 and a[1] >= 0.3 and b[0] <= 0.65 and b[1] >= 0.6 for a, b in bounds) / len(files)

    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.random(20_000), "b": rng.random(20_000), "t": "x"}))
    odd = spark.createDataFrame([(None, 0.5, "y"), (0.5, None, None), (None, None, "z"), (float("nan"), 0.1, "n")], df.schema)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_clustered(df, str(tmp_path / "t"), ["a", "b"])
        write_table(df.repartition(64), str(tmp_path / "u"))
        both = df.unionByName(odd)
        write_clustered(both, str(tmp_path / "v"), ["a", "b"])
        write_clustered(df.limit(0), str(tmp_path / "w"), ["a"])
        write_clustered(odd.select(F.lit("7").alias("x.x")), str(tmp_path / "x"), ["x.x"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert met("u") == 1 and met("t") < 0.2
    assert sorted(map(repr, read_table(spark, str(tmp_path / "v")).collect())) == sorted(map(repr, both.collect()))
    assert read_table(spark, str(tmp_path / "w")).count() == 0 and read_table(spark, str(tmp_path / "x")).count() == 4


def test_the_curve_is_cheap_to_order_by(spark, tmp_path, monkeypatch):
    """Parts are found by halving, for all rows as by counting the bounds, and the sort compares columns alone."""
    bounds = [float(n // 2) for n in range(63)]
    odd = [None, float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 0.5, 30.5, 31.0, 32.0]
    df = spark.createDataFrame([(v,) for v in odd + [n / 4 for n in range(140)]], "v double")
    below = F.coalesce(F.expr(f"if(v is null, null, size(filter(array({', '.join(f'{b}D' for b in bounds)}), b -> b < v)))"), F.lit(0))
    assert tables._with_part(df, "v", bounds, "part").filter(F.col("part") != below).count() == 0
    assert [r.part for r in tables._with_part(df, "v", None, "part").distinct().select("part").distinct().collect()] == [0]
    seen = []
    monkeypatch.setattr(tables, "_replace", lambda writer, *_: seen.append(writer._df._jdf.queryExecution().optimizedPlan().toString()))
    write_clustered(df.withColumn("w", -F.col("v")), str(tmp_path / "t"), ["v", "w"])
    ordering = [line for line in seen[0].splitlines() if "Sort [" in line or "RepartitionByExpression" in line]
    assert len(ordering) == 2 and not any("filter(" in line or "lambda" in line or "CASE" in line for line in ordering)


def test_what_splits_know_goes_to_the_pieces(spark, tmp_path, splits_of):
    """Pieces and lines are not shuffled to meet the row of their split or file, and headers need no other records."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {name: spark.conf.get(name) for name in conf}
    write(tmp_path / "a.csv", 'a,"b\nc"\n' + "".join(f'{n},"x\n{n}"\n' for n in range(100)))
    write(tmp_path / "a.json", GOOD)
    splits_of(64)
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        read = read_quoted_csv(spark, str(tmp_path / "a.csv"))
        records = read_records(spark, str(tmp_path / "a.json"), T.StructType().add("a", T.IntegerType()))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (read, records)]
        assert not any("SortMergeJoin" in plan for plan in plans) and all("BroadcastHashJoin" in plan for plan in plans)
        assert read.columns == ["a", "b\nc"] and sorted(map(tuple, read.collect())) == sorted((str(n), f"x\n{n}") for n in range(100))
        assert sorted(r.a for r in records.collect()) == [1, 2]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("moves", [0, 1])
def test_a_rename_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch, moves):
    """The store refuses to move the old table away, or says that it did and did not."""
    path = str(tmp_path / "t")
    write_table(spark.range(3), path)

    class Refusing:
        def __init__(self, files):
            self.files = files

        def rename(self, old, new):
            return bool(moves)

        def __getattr__(self, name):
            return getattr(self.files, name)

    found = tables.file_system
    monkeypatch.setattr(tables, "file_system", lambda *given: (Refusing(found(*given)[0]), found(*given)[1]))
    with pytest.raises(OSError, match="could not be moved"):
        write_table(spark.range(5), path)
    assert read_table(spark, path).count() == 3
