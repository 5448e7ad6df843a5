"""Choosing, renaming and adding columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"`{name}`") for name in columns))


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def sanitize_names(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores and parentheses go."""
    table = str.maketrans({" ": "_", "(": None, ")": None})
    names = [name.translate(table) for name in df.columns]
    folded = [name.lower() for name in names]
    clashes = sorted({name for name in names if folded.count(name.lower()) > 1})
    if clashes:
        raise ValueError(f"columns share a name once sanitized: {clashes}")
    return df.toDF(*names)


def add_year_month(df: DataFrame, date: str, year: str = "Year", month: str = "Month") -> DataFrame:
    return df.withColumns({year: F.year(date), month: F.month(date)})
