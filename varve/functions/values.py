"""Column functions for dates and numbers held in text, and for shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts in order of precedence.
MIXED_DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy")


def first_date(text: Column, formats: Sequence[str] = MIXED_DATE_FORMATS) -> Column:
    """Date by the first layout that fits; null if none does."""
    return F.coalesce(*(F.try_to_date(text, layout) for layout in formats))


def month_start(text: Column) -> Column:
    """First day of a ``yyyyMM`` month; null for a month that does not exist."""
    return F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd")


def tolerant_int(text: Column) -> Column:
    """Whole part of a number in text, null for other text."""
    return text.try_cast("double").try_cast("int")


def tolerant_float(text: Column) -> Column:
    return text.try_cast("float")


def month_number(date: Column) -> Column:
    """``year * 100 + month``: December to January is a step of 89."""
    return F.year(date) * 100 + F.month(date)


def month_index(date: Column) -> Column:
    """Months since year 0, in equal steps."""
    return F.year(date) * 12 + F.month(date) - 1


def percentage(part: Column, total: Column) -> Column:
    """Share of ``total`` in percent; null where the total is zero."""
    return F.try_divide(part, total) * 100
