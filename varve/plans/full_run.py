"""The whole chain, each layer finished before the next begins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from varve.plans.bronze import to_bronze
from varve.plans.gold import to_gold
from varve.plans.landing import land
from varve.plans.silver import to_silver


def run(
    spark: SparkSession,
    events: str,
    index: str,
    series: str,
    base: str,
    event_schema: T.StructType | None = None,
    multiline: bool = True,
    multiline_csv: bool = True,
) -> str:
    """From raw drops to gold under ``base``; returns the folder of the gold tables.

    ``multiline`` says that a JSON file holds one envelope, ``multiline_csv`` that landed fields may
    hold line feeds.
    """
    layers = [f"{base}/{layer}" for layer in ("ingress", "bronze", "silver", "gold")]
    land(spark, events, index, series, layers[0], event_schema, multiline)
    to_bronze(spark, layers[0], layers[1], multiline_csv)
    to_silver(spark, layers[1], layers[2])
    to_gold(spark, layers[2], layers[3])
    return layers[3]
