"""Bronze: landed CSV as columnar tables with plain column names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from varve.operators.columns import sanitize_names
from varve.plans.landing import TABLES
from varve.sources.quoted import read_quoted_csv
from varve.sources.tables import read_csv, write_table


def to_bronze(spark: SparkSession, landing: str, target: str, multiline: bool = True) -> None:
    """Files are read in splits, also where landed fields hold line feeds.

    Where no field does, ``multiline=False`` saves the count of quotes before the parsing.
    """
    for name in TABLES:
        path = f"{landing}/{name}_ingress"
        raw = read_quoted_csv(spark, path) if multiline else read_csv(spark, path)
        write_table(sanitize_names(raw), f"{target}/{name}_bronze")
