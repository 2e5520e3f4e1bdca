"""Exact percent_rank without sorting a whole group in one task.

A window partitioned by (indicator, vintage) would put a third of a year's loans, or more, into
one task. Here equal values are counted first (map-side), values are put into value ranges, and a
rank is the number of rows in lower ranges plus the number of lower values in the same range. The
window inside a range sees at most `width / 0.01` distinct cent values, the window over ranges one
row per range. Ranks of several values come from one count of their combinations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.operators.joins import join_on_keys, split_join

c = F.col


def value_counts(loans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of loans (`_n`) of each combination of values."""
    return loans.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))


def _of_value(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    if set(counts.columns) == {*keys, value, "_n"}:
        return counts
    return counts.groupBy(*keys, value).agg(F.sum("_n").alias("_n"))


def value_ranks(counts: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """One row per (keys, distinct value) with its `pctile` and its number of loans `_n`, from
    `value_counts` of these or more columns; NULL values come first."""
    counted = _of_value(counts, keys, value).withColumn("_range", F.floor(c(value).cast("double") / width))
    over_ranges = Window.partitionBy(*keys).orderBy(c("_range").asc_nulls_first())
    ranges = (
        counted.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_range_n"))
        .withColumn("_lower", F.sum("_range_n").over(over_ranges) - c("_range_n"))
        .withColumn("_group_n", F.sum("_range_n").over(Window.partitionBy(*keys)))
        .drop("_range_n")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(c(value).asc_nulls_first())
    ranked = join_on_keys(counted, ranges, [*keys, "_range"]).withColumn(
        "_rank", c("_lower") + F.sum("_n").over(within) - c("_n")
    )
    share = c("_rank").cast("double") / (c("_group_n") - 1).cast("double")
    pctile = F.when(c("_group_n") > 1, share).otherwise(F.lit(0.0))
    return ranked.select(*keys, value, "_n", pctile.alias("pctile"))


def with_percent_rank(
    loans: DataFrame,
    keys: Sequence[str],
    value: str,
    width: float,
    name: str,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add the percent rank of `value` within `keys` to every loan; `counts` are `value_counts` of
    the loans, if there are any. A value that very many loans have is dealt over several tasks."""
    if counts is None:
        counts = value_counts(loans, (*keys, value))
    ranks = value_ranks(counts, keys, value, width).withColumnRenamed("pctile", name)
    apart = ["loan_id"] if "loan_id" in loans.columns else loans.columns
    sizes = _of_value(counts, keys, value)
    return split_join(loans, ranks, [*keys, value], sizes, "_n", F.xxhash64(*apart))


def cutoffs(ranks: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Per group, the smallest value whose percentile reaches each edge (`_cut0`, `_cut1`, ...)."""

    def first_at(edge: float) -> Column:
        return F.min(F.when(c("pctile") >= edge, c(value)))

    return ranks.groupBy(*keys).agg(
        *[first_at(edge).alias(f"_cut{i}") for i, edge in enumerate(edges)]
    )
