"""Months written as yyyyMM text; text order is time order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(period: Column) -> Column:
    """Months since year 0, so that differences are plain subtractions."""
    year = F.substring(period, 1, 4).cast("int")
    month = F.substring(period, 5, 2).cast("int")
    return year * 12 + month - 1


def period_of_index(index: Column) -> Column:
    year = F.floor(index / 12).cast("int")
    return (year * 100 + index - year * 12 + 1).cast("string")


def add_months(period: Column, months: int) -> Column:
    return period_of_index(month_index(period) + F.lit(months))


def date_month_index(date: Column) -> Column:
    """Month index of a date or zone-less timestamp, independent of the session time zone."""
    return F.year(date) * 12 + F.month(date) - 1
