"""Gold: tables ready for analysis, and the analyses over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators.columns import add_year_month, drop
from varve.operators.combine import count_by, join_on, exact_mean_by
from varve.operators.lowess import lowess
from varve.operators.rows import share_over
from varve.sources.tables import read_table, write_manifest, write_table

# Fixed value: least share of the events, in percent, that a category must exceed.
LEAST_SHARE = 5.0


def with_year_month(series: DataFrame) -> DataFrame:
    return add_year_month(series, "Date")


def consolidated_measures(events: DataFrame, index: DataFrame, series: DataFrame, frac: float = 0.2) -> DataFrame:
    """Per year: the index, the smoothed number of events and the mean of the smoothed series.

    ``series`` carries its year. Both aggregates come before any smoothing or join, so what is
    shuffled after them is one row per year.
    """
    counts = count_by(events, [F.year("Date").alias("Year")], "Date", "Disaster_Count")
    smoothed = lowess(counts, x="Year", y="Disaster_Count", out="Disaster_Count_Lowess", frac=frac, spread=False)
    means = exact_mean_by(series, ["Year"], "Anomaly_Lowess", "Temp_Anomaly_Lowess")
    return join_on(index, drop(smoothed, "Disaster_Count"), means, on="Year")


def category_shares(events: DataFrame, percent: float = LEAST_SHARE) -> DataFrame:
    """``Category, Count`` of the categories above ``percent`` of all dated events."""
    return share_over(count_by(events, ["Category"], "Date", "Count"), "Count", percent)


def to_gold(spark: SparkSession, silver: str, target: str) -> None:
    events = read_table(spark, f"{silver}/df_dis_silver")
    index = read_table(spark, f"{silver}/df_glo_silver")
    series = with_year_month(read_table(spark, f"{silver}/df_ano_silver"))
    tables = {
        "consolidated_measures": consolidated_measures(events, index, series),
        "categorical_disasters": category_shares(events),
        "temp_anomalies": series,
    }
    for name, table in tables.items():
        write_table(table, f"{target}/{name}")
        write_manifest(spark, f"{target}/{name}")


def correlations(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Correlation of every two measures, one row per pair, in one pass over the table."""
    pairs = [(a, b) for at, a in enumerate(measures) for b in measures[at + 1 :]]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    listed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*listed)))


def change_on_previous(df: DataFrame, key: str, measure: str, step: int = 1, out: str = "change") -> DataFrame:
    """Difference of ``measure`` from the row whose ``key`` is ``step`` less; null without one."""
    previous = df.select((F.col(key) + step).alias(key), F.col(measure).alias("_previous"))
    joined = df.select(key, measure).join(previous, on=key, how="left")
    return joined.select(key, measure, (F.col(measure) - F.col("_previous")).alias(out))


def ranked(groups: DataFrame, count: str, name: str) -> DataFrame:
    return groups.orderBy(F.desc(count), F.asc(name))
