"""Positions in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.sources.shared import kept

c = F.col


def with_row_numbers(frame: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add each row's number in the order, from 1.

    Rows are dealt into ranges of the order and numbered inside; what lies in earlier ranges is added
    from the ranges' row counts, which are one row together. The dealt rows are written to the shared
    folder first, once: a second computation could cut other ranges, and whatever is behind the rows
    is then not computed again.
    """
    dealt = frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_sizes"))
    before = F.transform(
        "_sizes",
        lambda x, i: F.struct(
            x["_range"].alias("_r"),
            F.aggregate(
                F.slice("_sizes", F.lit(1), i), F.lit(0).cast("long"), lambda n, y: n + y["_n"]
            ).alias("_before"),
        ),
    )
    offsets = listed.select(F.inline(before))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside)
        .join(offsets, c("_range") == c("_r"))
        .withColumn(name, (c("_before") + c("_inside")).cast("int"))
        .drop("_range", "_r", "_before", "_inside")
    )
