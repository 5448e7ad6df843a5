import datetime as dt

import pytest
from pyspark.sql import functions as F

from varve.functions.text import category_of, ends_joined, leading_token, refined_category, space_tokens
from varve.functions.values import (
    first_date,
    month_index,
    month_number,
    month_start,
    percentage,
    tolerant_float,
    tolerant_int,
)


def values(spark, inputs, column):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    width = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"{name} string" for name in "abc"[:width])
    return [r.out for r in spark.createDataFrame(rows, schema).withColumn("out", column).orderBy("i").collect()]


@pytest.mark.parametrize(
    "title, expected",
    [
        ("Flood - Queensland", "Flood"),
        ("Severe Storm - Sydney - again", "Severe Storm"),
        ("Severe Storm Sydney", "Severe"),
        ("Flood", None),
        (None, None),
        ("Flood - X", "Flood"),
        ("Flood\x1f- X", "Flood"),
        ("Flood\r - X", "Flood\r"),
        ("first line\nHail - X", "Hail"),
        ("Hail -X", "Hail"),
        ("Hail- X", "Hail-"),
        (" Flood", ""),
    ],
)
def test_category_of(spark, title, expected):
    assert values(spark, [title], category_of(F.col("a"))) == [expected]


def test_refined_category(spark):
    inputs = [
        ("Environmental", "A DROUGHT and a heatwave"),
        ("Envionmental", "long drought, then bushfire"),
        ("Environmental", "Bushfire"),
        ("Environmental", "locusts"),
        ("Flood", "drought"),
        (None, "drought"),
    ]
    out = values(spark, inputs, refined_category(F.col("a"), F.col("b")))
    assert out == ["Heatwave", "Drought", "Bushfire", "Others", "Flood", None]


def test_dates_of_mixed_layout(spark):
    texts = ["2/17/1983 0:00", "17/2/1983 0:00", "3/4/2011 0:00", "3/4/2011", "", "31/2/2011 0:00", None]
    expected = [dt.date(1983, 2, 17), dt.date(1983, 2, 17), dt.date(2011, 3, 4), None, None, None, None]
    assert values(spark, texts, first_date(leading_token(F.col("a")))) == expected


def test_months(spark):
    day = month_start(F.col("a"))
    texts = ["191001", "202012", "202013", "20201", None, "abcdef"]
    assert values(spark, texts, day)[:3] == [dt.date(1910, 1, 1), dt.date(2020, 12, 1), None]
    assert values(spark, texts, day)[4:] == [None, None]
    assert values(spark, texts[:2], month_number(day)) == [191001, 202012]
    assert values(spark, ["201912", "202001"], month_index(day)) == [2019 * 12 + 11, 2020 * 12]


def test_tolerant_numbers(spark):
    texts = ["2010", "2010.0", " 7 ", "-3.9", "", "abc", None]
    assert values(spark, texts, tolerant_int(F.col("a"))) == [2010, 2010, 7, -3, None, None, None]
    assert values(spark, ["0.5", "x", None], tolerant_float(F.col("a"))) == [0.5, None, None]


def test_tokens_and_ends(spark):
    assert values(spark, ["  a  b ", "", "a\tb c\r"], space_tokens(F.col("a"))) == [["a", "b"], [], ["a\tb", "c\r"]]
    assert values(spark, ["1910-01", "19101231", "abc"], ends_joined(F.col("a"))) == ["191001", "191031", "abcbc"]


def test_percentage_of_zero_is_null(spark):
    out = values(spark, [("1", "4"), ("0", "0")], percentage(F.col("a").cast("int"), F.col("b").cast("int")))
    assert out == [25.0, None]
