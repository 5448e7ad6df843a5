"""The queries: each takes a session and the folder of the tables, and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.text import category_of, ends_joined, leading_token, refined_category, space_tokens
from varve.functions.values import first_date, month_index, month_number, month_start, tolerant_float, tolerant_int
from varve.operators.columns import add_year_month, drop, keep, rename, sanitize_names
from varve.operators.combine import count_by, exact_mean_by, grid_join, join_on, mean_by
from varve.operators.lowess import lowess
from varve.operators.rows import distinct_rows, first_per_key, in_box, in_list, in_table, not_all_null, share_over
from varve.plans import full_run, gold, landing, silver
from varve.plans.bronze import to_bronze
from varve.queries.inputs import (
    EVENT_SCHEMA,
    NESTED_SCHEMA,
    PAGE,
    blank_records,
    day_number,
    event_records,
    mixed_date_text,
    month_means,
    raw_drops,
    record_pages,
    table,
    write_envelopes,
    write_lines,
    write_text_files,
)
from varve.shared import materialize, scratch_path
from varve.sources.records import read_records
from varve.sources.tables import expose, read_csv, read_table, write_clustered, write_csv, write_manifest, write_table
from varve.sources.text import read_text_series, read_text_table


def category_from_title(spark: SparkSession, folder: str) -> DataFrame:
    part, size = table(spark, folder, "part"), F.col("p_size")
    title = (
        F.when(size % 3 == 0, F.concat("p_type", F.lit(" - "), "p_name"))
        .when(size % 3 == 1, F.col("p_name"))
        .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    )
    return part.select("p_partkey", category_of(title).alias("category"))


def refine_category(spark: SparkSession, folder: str) -> DataFrame:
    part, key = table(spark, folder, "part"), F.col("p_partkey")
    category = F.when(key % 4 == 0, "Environmental").when(key % 4 == 1, "Envionmental").otherwise(F.col("p_type"))
    word = F.when(key % 5 == 0, " Bushfire after DROUGHT").when(key % 5 == 1, " heatWave").when(key % 5 == 2, " bushfire")
    title = F.concat("p_name", word.otherwise(""))
    return part.select("p_partkey", refined_category(category, title).alias("category"))


def mixed_dates(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    text = mixed_date_text(F.col("o_orderdate"), F.col("o_orderkey"))
    token = leading_token(text)
    return orders.select("o_orderkey", token.alias("token"), first_date(token).alias("day"))


def month_key_date(spark: SparkSession, folder: str) -> DataFrame:
    orders, date = table(spark, folder, "orders"), F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 13 == 0, F.date_format(date, "yyyy-'13'")).otherwise(F.date_format(date, "yyyy-MM"))
    key = ends_joined(text)
    day = month_start(key)
    return orders.select(
        "o_orderkey",
        key.alias("month_key"),
        day.alias("day"),
        month_number(day).alias("month_number"),
        month_index(day).alias("month_index"),
    )


def tolerant_casts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    )
    return orders.select(
        "o_orderkey",
        tolerant_int(text).alias("whole"),
        tolerant_float(text).cast("double").alias("number"),
    )


def documents_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = space_tokens(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.size(tokens).alias("tokens"), F.try_element_at(tokens, F.lit(1)).alias("first")
    )


def whitelist(spark: SparkSession, folder: str) -> DataFrame:
    kept = in_list(table(spark, folder, "part"), "p_brand", ["Brand#1", "Brand#2", "Brand#12", "Brand#99"])
    return kept.select("p_partkey", "p_brand")


def whitelist_table(spark: SparkSession, folder: str) -> DataFrame:
    small = table(spark, folder, "part").filter(F.col("p_size") <= 10).select("p_partkey")
    return in_table(table(spark, folder, "lineitem"), "l_partkey", small).select("l_orderkey", "l_linenumber", "l_partkey")


def bounding_box(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.when(F.col("c_custkey") % 11 == 0, "abc").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    customers = table(spark, folder, "customer").withColumn("balance", balance)
    return in_box(customers, balance=(1000.0, 4000.5), c_nationkey=(3, 12)).select("c_custkey", "balance", "c_nationkey")


def share_over_query(spark: SparkSession, folder: str) -> DataFrame:
    brands = count_by(table(spark, folder, "part"), ["p_brand"], "p_partkey", "n")
    return share_over(brands, "n", 4.0)


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return first_per_key(table(spark, folder, "documents"), ["text", "lang"], ["doc_id"])


def dedup_full(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


def drop_all_null(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels")
    return not_all_null(documents.join(labels, on="doc_id", how="left").select("quality", "toxic"))


def sanitise_names(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_custkey").alias("Customer (Key)"),
        F.col("o_totalprice").alias("Price(5)"),
    )
    return sanitize_names(orders)


def project_rename(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    kept = keep(orders, ["o_totalprice", "o_orderkey", "o_custkey", "o_orderstatus"])
    return drop(rename(kept, {"o_orderkey": "key", "o_totalprice": "price"}), "o_custkey")


def denorm_dates(spark: SparkSession, folder: str) -> DataFrame:
    return add_year_month(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


def yearly_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return count_by(orders, [F.year("o_orderdate").alias("year")], "o_orderdate", "n")


def yearly_mean(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    means = mean_by(lines, [F.year("l_shipdate").alias("year")], "l_quantity", "mean")
    return means.withColumn("mean", F.round("mean", 6))


def exact_means(spark: SparkSession, folder: str) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, folder, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, -paid).otherwise(paid).alias("paid"))
    return exact_mean_by(lines, ["l_returnflag"], "paid", "mean").withColumn("mean", F.round("mean", 6))


def skewed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with every supplier of its nation; cells of 50 rows split the nations of many customers."""
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    return grid_join(customers, suppliers, "key", cell=50)


def yearly_join(spark: SparkSession, folder: str) -> DataFrame:
    return join_on(yearly_count(spark, folder), yearly_mean(spark, folder), on="year")


def fan_out_join(spark: SparkSession, folder: str) -> DataFrame:
    """Joins multiply rows of equal keys and keep no row whose key is null or missing."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    customers = count_by(table(spark, folder, "customer"), [F.col("c_nationkey").alias("key")], "c_custkey", "customers")
    return join_on(suppliers, nations, customers, on="key")


def lowess_monthly(spark: SparkSession, folder: str) -> DataFrame:
    months = count_by(
        table(spark, folder, "orders"), [month_number(F.col("o_orderdate")).alias("month")], "o_orderdate", "n"
    )
    return lowess(months, "month", "n", out="fit", spread=False).withColumn("fit", F.round("fit", 6))


def lowess_grouped(spark: SparkSession, folder: str) -> DataFrame:
    hours = (
        table(spark, folder, "events")
        .groupBy("event_type", (day_number("ts") * 24 + F.hour("ts")).alias("hour"))
        .agg(F.count("value").alias("n"))
    )
    return lowess(hours, "hour", "n", by=["event_type"], out="fit").withColumn("fit", F.round("fit", 6))


def lowess_jumps(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts, fitted about every 30 hours and on lines in between."""
    hours = (
        table(spark, folder, "events")
        .groupBy("event_type", (day_number("ts") * 24 + F.hour("ts")).alias("hour"))
        .agg(F.sum("value").alias("total"))
    )
    smoothed = lowess(hours, "hour", "total", by=["event_type"], out="fit", delta=30.0)
    return smoothed.select("event_type", "hour", F.round("fit", 6).alias("fit"))


def lowess_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """One long series, of a quarter of the events, beside a short one for each other user."""
    user = F.when(F.col("user_id") % 4 == 0, -1).otherwise(F.col("user_id")).alias("who")
    day = day_number("ts") + (F.hour("ts") * 60 + F.minute("ts")) / 1440
    events = table(spark, folder, "events").select("event_id", user, "value", day.alias("day"))
    smoothed = lowess(events, "day", "value", by=["who"], frac=0.5, it=2, out="fit")
    return smoothed.select("event_id", "who", F.round("fit", 6).alias("fit"))


def lowess_users(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "value", (day_number("ts") * 24 + F.hour("ts")).alias("hour")
    )
    smoothed = lowess(events, "hour", "value", by=["user_id"], frac=0.5, out="fit")
    return smoothed.select("event_id", "user_id", F.round("fit", 6).alias("fit"))


def lowess_long(spark: SparkSession, folder: str) -> DataFrame:
    """Every event of a type as one series."""
    day = day_number("ts") + (F.hour("ts") * 60 + F.minute("ts")) / 1440
    events = table(spark, folder, "events").select("event_id", "event_type", "value", day.alias("day"))
    smoothed = lowess(events, "day", "value", by=["event_type"], out="fit")
    return smoothed.select("event_id", "event_type", F.round("fit", 6).alias("fit"))


def consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Per month: mean quantity shipped, smoothed number of orders, smoothed mean price."""
    orders = table(spark, folder, "orders")
    ordered = [month_number(F.col("o_orderdate")).alias("month")]
    shipped = [month_number(F.col("l_shipdate")).alias("month")]
    index = mean_by(table(spark, folder, "lineitem"), shipped, "l_quantity", "mean_quantity")
    per_month = materialize(
        orders.groupBy(*ordered).agg(
            F.count("o_orderdate").alias("orders"), (F.avg("o_totalprice") / 1000).alias("price")
        )
    )
    counts = lowess(per_month.select("month", "orders"), "month", "orders", out="orders_smooth", spread=False)
    prices = lowess(per_month.select("month", "price"), "month", "price", out="price_smooth", spread=False)
    joined = join_on(index, drop(counts, "orders"), drop(prices, "price"), on="month")
    return joined.select("month", *(F.round(c, 6).alias(c) for c in joined.columns if c != "month"))


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("props", F.from_json("props", "k int"))
    pages = record_pages(events, "event_id", ["event_id", "event_type", "value", "props"])
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StructType([T.StructField("k", T.IntegerType())])),
        ]
    )
    records = read_records(spark, write_lines(pages, "pages"), schema, multiline=False)
    return rename(records, {"props.k": "props_k"})


def text_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat_ws("  ", "o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("line"),
    )
    # Priorities hold spaces, which would be fields of their own.
    lines = lines.withColumn("line", F.replace("line", F.lit("NOT SPECIFIED"), F.lit("NONE")))
    head = "Orders\n\nwith prices\nKey Priority  Cents(5)\n---\n"
    path = write_text_files(lines, F.expr(f"o_orderkey div {PAGE}"), "o_orderkey", head, "orders")
    return sanitize_names(read_text_table(spark, path))


def text_series(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat_ws(" ", F.date_format("o_orderdate", "yyyy/MM"), F.round(-F.col("o_totalprice")).cast("bigint")).alias("line"),
    )
    path = write_text_files(lines, F.expr(f"o_orderkey div {PAGE}"), "o_orderkey", "", "series")
    return read_text_series(spark, path)


def bronze_of_blanks(spark: SparkSession, folder: str) -> DataFrame:
    _, index, series = raw_drops(spark, folder)
    pages = record_pages(blank_records(spark, folder), "_key", [F.col(name) for name in NESTED_SCHEMA.names])
    base = scratch_path(spark, "layers")
    landing.land(spark, write_envelopes(pages, "envelopes"), index, series, f"{base}/ingress", NESTED_SCHEMA)
    to_bronze(spark, f"{base}/ingress", f"{base}/bronze")
    return read_table(spark, f"{base}/bronze/df_dis_bronze")


def bronze_events(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes of nested records with blanks and line feeds, through landing to bronze."""
    return rename(bronze_of_blanks(spark, folder), {"source.key": "source_key", "source.of.state": "source_of_state"})


def silver_blanks(spark: SparkSession, folder: str) -> DataFrame:
    return silver.silver_events(bronze_of_blanks(spark, folder))


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "documents"), path)
    return read_csv(spark, path, multiline=True)


def clustered_box(spark: SparkSession, folder: str) -> DataFrame:
    """A box on two columns of a table written along a curve through them."""
    path = scratch_path(spark)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    write_clustered(lines, path, ["l_quantity", "l_extendedprice"])
    return in_box(read_table(spark, path), l_quantity=(10, 15), l_extendedprice=(5000, 20000))


def table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    write_table(table(spark, folder, "orders"), path)
    return read_table(spark, path)


def table_sql(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    write_table(table(spark, folder, "orders"), path)
    expose(spark, "varve_orders", path)
    return spark.sql(
        "SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM varve_orders GROUP BY ALL"
    )


def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a written table that lie in the files its manifest lists."""
    path = scratch_path(spark)
    write_table(table(spark, folder, "orders"), path)
    listed = spark.read.text(write_manifest(spark, path)).select(F.regexp_replace("value", "^file:/+", "file:/").alias("file"))
    rows = read_table(spark, path).select(
        "o_orderstatus", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file")
    )
    return rows.join(listed, on="file", how="left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def landed_events(spark: SparkSession, folder: str) -> DataFrame:
    # The drop holds every record twice, the second time with another note.
    records = event_records(spark, folder)
    again = records.withColumns({"note": F.concat(F.lit("again "), "note")})
    both = records.withColumn("_position", F.struct(F.lit(0).alias("copy"), "_key")).unionByName(
        again.withColumn("_position", F.struct(F.lit(1).alias("copy"), "_key"))
    )
    return landing.landed_events(both.drop("_key"))


def landed_index(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("Year"),
        F.col("l_quantity").cast("int").alias("Lowess(5)"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("_position"),
        F.col("l_orderkey").alias("raw"),
    )
    return sanitize_names(landing.landed_index(lines))


def landed_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return landing.landed_series(
        orders.select(F.date_format("o_orderdate", "yyyyMM").alias("Date"), F.col("o_orderstatus").alias("Anomaly"))
    )


def silver_events(spark: SparkSession, folder: str) -> DataFrame:
    return silver.silver_events(event_records(spark, folder))


def silver_index(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("Year"),
        F.when(F.col("l_returnflag") == "A", "?").otherwise(F.col("l_quantity").cast("string")).alias("Lowess5"),
    )
    return silver.silver_index(lines)


def silver_series(spark: SparkSession, folder: str) -> DataFrame:
    raw = rename(month_means(spark, folder), {"month": "Date", "mean": "Anomaly"})
    series = silver.silver_series(raw)
    return series.withColumns(
        {"Anomaly": F.col("Anomaly").cast("double"), "Anomaly_Lowess": F.round("Anomaly_Lowess", 4)}
    )


def gold_series(spark: SparkSession, folder: str) -> DataFrame:
    return gold.with_year_month(silver_series(spark, folder))


def gold_category(spark: SparkSession, folder: str) -> DataFrame:
    return gold.category_shares(silver_events(spark, folder))


def gold_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly measures of daily events: wider smoothing, as there are few years."""
    lines = table(spark, folder, "lineitem")
    index = mean_by(lines, [F.year("l_shipdate").alias("Year")], "l_quantity", "Global_Temp_Index_Lowess")
    series = gold.with_year_month(silver.silver_series(rename(month_means(spark, folder), {"month": "Date", "mean": "Anomaly"})))
    measures = gold.consolidated_measures(silver_events(spark, folder), index, series, frac=0.8)
    return measures.select(
        "Year",
        F.round("Global_Temp_Index_Lowess", 6).alias("Global_Temp_Index_Lowess"),
        F.round("Disaster_Count_Lowess", 6).alias("Disaster_Count_Lowess"),
        F.round("Temp_Anomaly_Lowess", 4).alias("Temp_Anomaly_Lowess"),
    )


def full_run_gold(spark: SparkSession, folder: str) -> DataFrame:
    """From raw files through all layers to the consolidated table."""
    events, index, series = raw_drops(spark, folder)
    base = scratch_path(spark, "layers")
    target = full_run.run(spark, events, index, series, base, EVENT_SCHEMA, multiline=False)
    measures = read_table(spark, f"{target}/consolidated_measures")
    return measures.select(
        "Year",
        F.col("Global_Temp_Index_Lowess").cast("double").alias("Global_Temp_Index_Lowess"),
        F.round("Disaster_Count_Lowess", 6).alias("Disaster_Count_Lowess"),
        F.round("Temp_Anomaly_Lowess", 4).alias("Temp_Anomaly_Lowess"),
    )


def measure_corr(spark: SparkSession, folder: str) -> DataFrame:
    pairs = gold.correlations(consolidated(spark, folder), ["mean_quantity", "orders_smooth", "price_smooth"])
    return pairs.withColumn("corr", F.round("corr", 6))


def yoy_change(spark: SparkSession, folder: str) -> DataFrame:
    changes = gold.change_on_previous(consolidated(spark, folder), "month", "orders_smooth", step=100)
    return changes.withColumn("change", F.round("change", 5))


def category_rank(spark: SparkSession, folder: str) -> DataFrame:
    return gold.ranked(gold_category(spark, folder), "Count", "Category")


QUERIES = {
    "category_from_title": category_from_title,
    "refine_category": refine_category,
    "mixed_dates": mixed_dates,
    "month_key_date": month_key_date,
    "tolerant_casts": tolerant_casts,
    "space_tokens": documents_tokens,
    "whitelist": whitelist,
    "whitelist_table": whitelist_table,
    "bounding_box": bounding_box,
    "share_over": share_over_query,
    "dedup_first": dedup_first,
    "dedup_full": dedup_full,
    "drop_all_null": drop_all_null,
    "sanitise_names": sanitise_names,
    "project_rename": project_rename,
    "denorm_dates": denorm_dates,
    "yearly_count": yearly_count,
    "yearly_mean": yearly_mean,
    "exact_means": exact_means,
    "skewed_join": skewed_join,
    "yearly_join": yearly_join,
    "fan_out_join": fan_out_join,
    "lowess_monthly": lowess_monthly,
    "lowess_grouped": lowess_grouped,
    "lowess_jumps": lowess_jumps,
    "lowess_mixed": lowess_mixed,
    "lowess_users": lowess_users,
    "lowess_long": lowess_long,
    "consolidated": consolidated,
    "json_records": json_records,
    "text_table": text_table,
    "text_series": text_series,
    "bronze_events": bronze_events,
    "silver_blanks": silver_blanks,
    "csv_round_trip": csv_round_trip,
    "clustered_box": clustered_box,
    "table_round_trip": table_round_trip,
    "table_sql": table_sql,
    "manifest_rows": manifest_rows,
    "landed_events": landed_events,
    "landed_index": landed_index,
    "landed_series": landed_series,
    "silver_events": silver_events,
    "silver_index": silver_index,
    "silver_series": silver_series,
    "gold_series": gold_series,
    "gold_category": gold_category,
    "gold_measures": gold_measures,
    "full_run": full_run_gold,
    "measure_corr": measure_corr,
    "yoy_change": yoy_change,
    "category_rank": category_rank,
}
