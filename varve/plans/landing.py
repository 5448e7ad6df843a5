"""Landing: raw drops without duplicates and empty rows, as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from varve.operators.rows import distinct_rows, first_per_key, not_all_null
from varve.sources.records import read_records
from varve.sources.tables import write_csv
from varve.sources.text import POSITION, read_text_series, read_text_table

# The columns that identify a record of each drop, and the names of the tables.
EVENT_KEYS = ("title", "startDate", "endDate", "lat", "lon")
INDEX_KEYS = ("Year", "Lowess(5)")
TABLES = ("df_dis", "df_glo", "df_ano")


def landed_events(records: DataFrame) -> DataFrame:
    """Read with ``position``: of records with the same keys the first in the drop stays."""
    return not_all_null(first_per_key(records, EVENT_KEYS, [POSITION]).drop(POSITION))


def landed_index(table: DataFrame) -> DataFrame:
    return not_all_null(first_per_key(table, INDEX_KEYS, [POSITION]).drop(POSITION))


def landed_series(series: DataFrame) -> DataFrame:
    return not_all_null(distinct_rows(series))


def land(
    spark: SparkSession,
    events: str,
    index: str,
    series: str,
    target: str,
    event_schema: T.StructType | None = None,
    multiline: bool = True,
) -> None:
    """Read the three drops and write ``df_dis``, ``df_glo`` and ``df_ano`` under ``target``."""
    frames = (
        landed_events(read_records(spark, events, event_schema, multiline, position=True)),
        landed_index(read_text_table(spark, index, position=True)),
        landed_series(read_text_series(spark, series)),
    )
    for name, frame in zip(TABLES, frames):
        write_csv(frame, f"{target}/{name}_ingress")
