"""Report text: rounded or human-readable numbers, ranges and subtotal labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of subtotal rows.
TOTAL_LABELS = {
    "loan_term": "All Terms",
    "vintage": "All",
    "state": "US",
    "channel": "All Orig. Channels",
    "balance": "Tot. Cohort",
    "second_home": "All Occ.",
}
DEFAULT_TOTAL = "Total"
OCCUPANCY_LABELS = {"N": "Primary Occ.", "Y": "Second Home"}


def grouped_digits(x: Column, places: int) -> Column:
    """Thousands separators, half rounded away from zero."""
    return F.format_number(F.round(x, places), places)


def percent(x: Column, places: int = 1, human: bool = False) -> Column:
    """A fraction as '12.34%' for people, else rounded to four more places."""
    if not human:
        return F.round(x, places + 4)
    return F.concat(grouped_digits(x * 100, places), F.lit("%"))


def number(x: Column, places: int = 1, human: bool = False) -> Column:
    """A number with separators for people, else rounded to two more places."""
    return grouped_digits(x, places) if human else F.round(x, places + 2)


def thousands_range(low: Column, high: Column, separator: str = "-") -> Column:
    """Two amounts in thousands, such as '85k-417k'."""
    ends = [F.concat(grouped_digits(x.cast("double") / 1000, 0), F.lit("k")) for x in (low, high)]
    return F.concat(ends[0], F.lit(separator), ends[1])


def number_range(low: Column, high: Column, places: int, separator: str = "-") -> Column:
    return F.concat(grouped_digits(low, places), F.lit(separator), grouped_digits(high, places))


def dimension_label(name: str, value: Column, is_total: Column) -> Column:
    """Text of a group key; subtotal rows are told from NULL keys by their grouping bit."""
    text = value.cast("string")
    if name == "second_home":
        for flag, label in OCCUPANCY_LABELS.items():
            text = F.when(value == flag, F.lit(label)).otherwise(text)
    return F.when(is_total == 1, F.lit(TOTAL_LABELS.get(name, DEFAULT_TOTAL))).otherwise(text)


def total_or(value: Column, is_total: Column) -> Column:
    """'Total' on subtotal rows, else the key as text."""
    return F.when(is_total == 1, F.lit(DEFAULT_TOTAL)).otherwise(value.cast("string"))
