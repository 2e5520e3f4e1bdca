"""Original-balance segments. Super-conforming loans always form their own segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col

# Segment names in report order, and the percentile edges between the first four.
NAMED_ORDER = ("VLOW", "LOW", "MED", "HIGH", "SUPER")
PERCENTILE_EDGES = (0.10, 0.40, 0.80)
SUPER = "SUPER"
CONFORMING = "CONF"


def _super_or(segment: Column) -> Column:
    return F.when(c("high_balance_loan_indicator") == "Y", F.lit(SUPER)).otherwise(segment)


def by_cutoffs(low_k: int, medium_k: int, very_low_k: int | None = None) -> Column:
    """HIGH above `medium_k`, MED above `low_k`, LOW above `very_low_k` (if given), else VLOW."""
    segment = F.lit("VLOW")
    if very_low_k is not None:
        segment = F.when(c("orig_upb") > very_low_k * 1000, F.lit("LOW")).otherwise(segment)
    segment = F.when(c("orig_upb") > low_k * 1000, F.lit("MED")).otherwise(segment)
    segment = F.when(c("orig_upb") > medium_k * 1000, F.lit("HIGH")).otherwise(segment)
    return _super_or(segment)


def by_steps(steps: Sequence[str]) -> Column:
    """First step (thousands, as written, such as '085') the balance does not exceed."""
    segment = F.lit(CONFORMING)
    for step in reversed(steps):
        segment = F.when(c("orig_upb") <= int(step) * 1000, F.lit(f"{step}K")).otherwise(segment)
    return _super_or(segment)


def by_percentile(pctile: Column, edges: Sequence[float] = PERCENTILE_EDGES) -> Column:
    """Named segment from a loan's own percentile."""
    segment = F.lit("HIGH")
    for name, edge in reversed(list(zip(NAMED_ORDER, edges))):
        segment = F.when(pctile < edge, F.lit(name)).otherwise(segment)
    return _super_or(segment)


def by_percentile_cutoffs(cutoffs: Sequence[Column]) -> Column:
    """Named segment from the smallest balances that reach each percentile edge.

    A missing cutoff means that no balance of the group reaches that edge.
    """
    segment = F.lit("HIGH")
    for name, cutoff in reversed(list(zip(NAMED_ORDER, cutoffs))):
        below = cutoff.isNull() | (c("orig_upb") < cutoff)
        segment = F.when(below, F.lit(name)).otherwise(segment)
    return _super_or(segment)


def order_of(segment: Column, names: Sequence[str]) -> Column:
    """Position of a segment in report order; names outside the list come last."""
    position = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        position = F.when(segment == name, F.lit(i)).otherwise(position)
    return position
