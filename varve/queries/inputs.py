"""The given tables, shaped into the inputs that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.plans.silver import CATEGORIES
from varve.shared import scratch_path

# Rows per file or per line of the raw drops: what one page of a source holds.
PAGE = 5000

EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("title", "startDate", "endDate", "lat", "lon", "note")]
)


NESTED_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA,
        T.StructField(
            "source",
            T.StructType([T.StructField("key", T.StringType()), T.StructField("of", T.StructType([T.StructField("state", T.StringType())]))]),
        ),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def day_number(time: str) -> Column:
    return F.unix_date(F.to_date(time))


def mixed_date_text(date: Column, key: Column) -> Column:
    return (
        F.when(key % 3 == 0, F.date_format(date, "d/M/yyyy H:mm"))
        .when(key % 3 == 1, F.date_format(date, "M/d/yyyy H:mm"))
        .otherwise(F.date_format(date, "d/M/yyyy"))
    )


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """One raw event per order: a title with a category, a start in mixed layouts, a place in text."""
    orders = table(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    names = [*CATEGORIES, "Meteor", "Shipwreck"]
    words = ["near the coast", "HEATWAVE in the city", "long Drought inland", "a bushfire, spreading", 'the "great" one']
    return orders.select(
        F.when(key % 17 == 0, F.concat(F.lit("Flood "), F.col("o_orderpriority")))
        .otherwise(F.concat(pick(names, key), F.lit(" - "), pick(words, key)))
        .alias("title"),
        F.when(key % 5 == 4, F.date_format("o_orderdate", "yyyy"))
        .otherwise(mixed_date_text(F.col("o_orderdate"), key))
        .alias("startDate"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("endDate"),
        F.when(key % 19 == 0, F.lit("abc")).otherwise((-45 + F.col("o_custkey") % 40).cast("string")).alias("lat"),
        (105 + F.floor(price) % 60).cast("string").alias("lon"),
        key.cast("string").alias("note"),
        key.alias("_key"),
    )


def record_pages(records: DataFrame, key: str, columns) -> DataFrame:
    """One JSON envelope per ``PAGE`` consecutive keys, as column ``value``."""
    paged = records.groupBy(F.expr(f"{key} div {PAGE}").alias("_page")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).alias("_at"), F.struct(*columns).alias("_record")))).alias("_all")
    )
    listed = F.struct(F.col("_all._record").alias("records"))
    return paged.select(F.to_json(F.struct(listed.alias("result"))).alias("value"))


def blank_records(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events with blanks around texts, line feeds and quotes within them, and nested objects."""
    key = F.col("_key").cast("string")
    return event_records(spark, folder).select(
        F.concat(F.when(F.col("_key") % 7 == 0, "  ").otherwise(""), "title", F.lit(" "), key, F.lit(" \t")).alias("title"),
        *EVENT_SCHEMA.names[1:5],
        F.concat(F.lit(" } one\n\n\"two\", "), key, F.lit("\r\n[ { ")).alias("note"),
        F.struct(key.alias("key"), F.struct(F.concat(F.lit(" ]"), "lat", F.lit("\n")).alias("state")).alias("of")).alias("source"),
        "_key",
    )


def write_envelopes(pages: DataFrame, name: str) -> str:
    """One file for each page."""
    path = scratch_path(pages.sparkSession, name)
    pages.select("value", F.xxhash64("value").alias("page")).write.partitionBy("page").text(path)
    return path


def write_lines(pages: DataFrame, name: str) -> str:
    path = scratch_path(pages.sparkSession, name)
    pages.write.text(path)
    return path


def write_text_files(lines: DataFrame, page: Column, order: str, head: str, name: str) -> str:
    """Files of ``head`` and the ``line`` column in order, one file per ``page``."""
    path = scratch_path(lines.sparkSession, name)
    paged = lines.groupBy(page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "line"))).alias("all")
    )
    body = F.array_join("all.line", "\n")
    paged.select("page", F.concat(F.lit(head), body).alias("value")).write.partitionBy("page").text(path)
    return path


def month_means(spark: SparkSession, folder: str) -> DataFrame:
    """Per month of the orders: ``month`` (``yyyyMM``) and the mean price as whole-number text."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(
        F.round(F.avg("o_totalprice")).cast("bigint").cast("string").alias("mean")
    )


def raw_drops(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """Files of events, of a yearly table and of a monthly series."""
    records = event_records(spark, folder)
    fields = [F.col(name) for name in EVENT_SCHEMA.names]
    events = write_lines(record_pages(records, "_key", fields), "events")
    years = (
        table(spark, folder, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
        .withColumn("line", F.concat_ws("  ", "year", "n", "s"))
    )
    head = "A yearly index\nof shipped lines\n\n Year  No_Smoothing  Lowess(5) \n-----\n"
    index = write_text_files(years, F.lit(0), "year", head, "index")
    months = month_means(spark, folder).withColumn(
        "line", F.concat(F.left("month", F.lit(4)), F.lit("-"), F.right("month", F.lit(2)), F.lit("   "), "mean")
    )
    series = write_text_files(months, F.lit(0), "month", "", "series")
    return events, index, series
