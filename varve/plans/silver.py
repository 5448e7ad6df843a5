"""Silver: typed, filtered and smoothed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.text import category_of, leading_token, refined_category
from varve.functions.values import first_date, month_index, month_number, month_start, tolerant_float, tolerant_int
from varve.operators.columns import keep, rename
from varve.operators.lowess import lowess
from varve.operators.rows import in_box, in_list
from varve.plans.landing import EVENT_KEYS
from varve.sources.tables import read_table, write_table

# Accepted categories (one is spelt as in the source) and the bounds of the region.
CATEGORIES = (
    "Severe Storm",
    "Tsunami",
    "Landslide",
    "Envionmental",
    "Environmental",
    "Earthquake",
    "Cyclone",
    "Bushfire",
    "Tornado",
    "Hail",
    "Flood",
)
LATITUDES = (-43.38, -10.41)
LONGITUDES = (113.09, 153.38)


def silver_events(
    raw: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    latitudes: tuple[float, float] = LATITUDES,
    longitudes: tuple[float, float] = LONGITUDES,
    cast_coords: bool = False,
) -> DataFrame:
    """``Category, Date, Lat, Lon`` of the accepted records; coordinates stay text unless cast."""
    named = keep(raw, EVENT_KEYS).withColumn("Category", category_of(F.col("title")))
    accepted = in_box(in_list(named, "Category", categories), lat=latitudes, lon=longitudes)
    titled = rename(
        accepted,
        {"title": "Title", "startDate": "Start_Date", "endDate": "End_Date", "lat": "Lat", "lon": "Lon"},
    )
    dated = titled.withColumns(
        {
            "Date": first_date(leading_token(F.col("Start_Date"))),
            "Category": refined_category(F.col("Category"), F.col("Title")),
        }
    )
    if cast_coords:
        dated = dated.withColumns({name: F.col(name).try_cast("double") for name in ("Lat", "Lon")})
    return keep(dated, ["Category", "Date", "Lat", "Lon"])


def silver_index(raw: DataFrame) -> DataFrame:
    index = rename(keep(raw, ["Year", "Lowess5"]), {"Lowess5": "Global_Temp_Index_Lowess"})
    return index.withColumns(
        {
            "Year": tolerant_int(F.col("Year")),
            "Global_Temp_Index_Lowess": tolerant_float(F.col("Global_Temp_Index_Lowess")),
        }
    )


def silver_series(raw: DataFrame, equal_months: bool = False, **smoothing) -> DataFrame:
    """``Date, Anomaly, Anomaly_Lowess``, smoothed over ``year * 100 + month``.

    On that axis a year ends with a step of 89; ``equal_months`` smooths over equal steps instead. A
    series holds a value or a few per month, so one task smooths it; ``spread=True`` for more.
    """
    typed = raw.select(month_start(F.col("Date")).alias("Date"), tolerant_float(F.col("Anomaly")).alias("Anomaly"))
    axis = month_index if equal_months else month_number
    placed = typed.withColumn("_x", axis(F.col("Date")))
    return lowess(placed, x="_x", y="Anomaly", out="Anomaly_Lowess", **({"spread": False} | smoothing)).drop("_x")


def to_silver(spark: SparkSession, bronze: str, target: str) -> None:
    write_table(silver_events(read_table(spark, f"{bronze}/df_dis_bronze")), f"{target}/df_dis_silver")
    write_table(silver_index(read_table(spark, f"{bronze}/df_glo_bronze")), f"{target}/df_glo_silver")
    write_table(silver_series(read_table(spark, f"{bronze}/df_ano_bronze")), f"{target}/df_ano_silver")
