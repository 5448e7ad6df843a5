"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from varve.queries.registry import QUERIES as REFERENCE

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else repr(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(cells)


def test_every_query_has_an_oracle():
    assert REFERENCE.keys() <= ORACLES.keys() and ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = sql.execute(ORACLES[name])
    expected = comparable([d[0] for d in cursor.description], cursor.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["yearly_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan and "partial_count" in plan


def test_no_query_joins_without_a_key(spark):
    for name in ("share_over", "gold_category", "yearly_join", "category_rank"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_shared_folder_is_that_of_the_session(spark):
    from varve.shared import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert os.path.isabs(shared_dir(spark).removeprefix("file:"))
