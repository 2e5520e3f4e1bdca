"""Running sums along an order, where no group of rows has to fit a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.storage import cut

c = F.col


def with_running_sums(
    frame: DataFrame, by: str, order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Adds, for each row, the sums over the rows of its group up to it, itself included.

    Rows are dealt into ranges of (group, order), so a group with any share of all rows takes as many
    ranges as its rows need. Sums inside a range are a window; what a group has in earlier ranges is
    added from sums per (range, group), one row for each range that a group touches. The dealt rows
    are written, since a second computation could cut other ranges. Rows with equal order stay in
    one range.
    """
    dealt = frame.repartitionByRange(by, *order).withColumns(
        {"_range": F.spark_partition_id(), **{f"_{name}": x for name, x in sums.items()}}
    )
    dealt = cut(dealt)
    until = Window.unboundedPreceding, Window.currentRow
    inside = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(*until)
    ranges = dealt.groupBy(c("_range").alias("_r"), c(by).alias("_g")).agg(
        *[F.sum(f"_{name}").alias(f"_before_{name}") for name in sums]
    )
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns(
        {f"_before_{name}": F.sum(f"_before_{name}").over(earlier) for name in sums}
    ).where(F.coalesce(*[c(f"_before_{name}") for name in sums]).isNotNull())
    local = dealt.withColumns({name: F.sum(f"_{name}").over(inside) for name in sums})
    # Only groups that go on from an earlier range have a row here: one group a range at most.
    joined = local.join(ranges, (c("_range") == c("_r")) & (c(by) == c("_g")), "left")
    total = {
        name: c(name) + F.coalesce(c(f"_before_{name}"), F.lit(0).cast("long")) for name in sums
    }
    return joined.withColumns(total).select(*frame.columns, *sums)
