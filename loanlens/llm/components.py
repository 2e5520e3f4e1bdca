"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.storage import cut

c = F.col


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node.

    Each step sends one row for each edge. A node's minimum is pre-aggregated and written before it
    is joined, so both sides of a join are stored tables: a node that very many edges share is a
    heavy join key, which Spark splits (`spark.sql.adaptive.skewJoin`). Edges of a step are written
    to the shared folder. The number of steps grows with the logarithm of the longest path.
    """
    high, low = F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    now = cut(edges.where(c(first) != c(second)).select(high, low).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(c("v").alias("u"), c("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least(c("u"), F.min("v")).alias("m")))
        up = both.where(c("v") > c("u"))
        large = cut(up.join(lowest, "u").select(c("v").alias("u"), c("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where(c("v") != c("m")).select(c("v").alias("u"), "m")
        now = cut(small.unionByName(lowest).distinct().withColumnRenamed("m", "v"))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(c("v").alias("node")).distinct().withColumn("component", c("node"))
    return now.select(c("u").alias("node"), c("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Tells two edge sets apart."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], int(row[1] or 0)
