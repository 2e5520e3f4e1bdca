"""Blocks of documents in ascending id order, and packed exchanges between blocks and hash buckets.

A table is cut into blocks of about `BLOCK` text bytes. A block is one group of a grouped Arrow
function; what it has to tell about its hashes goes out as one packed binary for each bucket, so a
value costs its own bytes in the shuffle and no row. Values of a block are made distinct first:
a value that a third of all documents share reaches its bucket once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8 << 20
#: Quantiles of the ids that are measured; finer blocks are cut evenly between two of them.
QUANTILES = 2048


class Blocks:
    """How a table's ids are cut: `count` blocks, ascending by id, null ids in block 0."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int = BLOCK) -> None:
        row = docs.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.octet_length(text)).alias("bytes"),
            F.percentile_approx(
                F.col(key).cast("long"), [i / QUANTILES for i in range(QUANTILES + 1)], 20 * QUANTILES
            ).alias("edges"),
        ).first()
        self.rows = row["rows"]
        self.count = max(1, math.ceil((row["bytes"] or 0) / size))
        spread = min(QUANTILES, self.count)
        edges = row["edges"] or [0]
        step = (len(edges) - 1) / spread
        self.edges = sorted({edges[round(i * step)] for i in range(spread)})
        self.finer = max(1, math.ceil(self.count / len(self.edges)))

    def of(self, key: Column) -> Column:
        """The block of an id: a binary search in the edges, then an even cut."""
        edges = F.array(*[F.lit(e) for e in self.edges])
        n = len(self.edges)
        steps = [1 << k for k in range(max(0, n.bit_length() - 1), -1, -1)]
        at = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda i, s: F.when(
                (i + s < n) & (F.get(edges, i + s) <= key), i + s
            ).otherwise(i),
        )
        if self.finer == 1:
            return F.coalesce(at, F.lit(0)).cast("long")
        low = F.get(edges, at)
        high = F.coalesce(F.get(edges, at + 1), low + 1)
        part = F.floor((key - low).cast("double") / (high - low) * self.finer)
        part = F.greatest(F.lit(0), F.least(part, F.lit(self.finer - 1)))
        return F.coalesce(at.cast("long") * self.finer + part, F.lit(0)).cast("long")


def on_table(function: Callable[..., pa.Table], **fixed) -> Callable[[pa.Table], pa.Table]:
    """A grouped Arrow function with some arguments fixed."""

    def apply(group: pa.Table) -> pa.Table:
        return function(group, **fixed)

    return apply


def on_tables(
    function: Callable[..., pa.Table], **fixed
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cogrouped Arrow function with some arguments fixed."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right, **fixed)

    return apply
