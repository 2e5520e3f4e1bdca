"""Joins on group keys, where NULL is a key value like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task should join at most.
SPLIT = 4_000_000


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on null-safe keys; the key columns of `left` are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[name for name in right.columns if name not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame,
    rows: str,
    apart: Column,
) -> DataFrame:
    """Left join with a table that has one row per key and in `rows` the number of left rows of it;
    `sizes` has the same number of each key.

    Left rows of a key with more than `SPLIT` of them are dealt over as many salts as it takes, by the
    hash `apart`, and its row is repeated for each; all other keys have one salt. There are at most as many
    such keys as the left side has multiples of `SPLIT` rows, so they are sent to every task.
    """
    salts = F.ceil(F.col(rows) / F.lit(SPLIT)).cast("int")
    heavy = sizes.where(F.col(rows) > SPLIT).select(*keys, salts.alias("_salts"))
    known = join_on_keys(left, F.broadcast(heavy), keys)
    dealt = known.withColumn(
        "_salt", F.pmod(apart, F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    repeated = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))
    )
    return join_on_keys(dealt, repeated.drop(rows), [*keys, "_salt"]).drop("_salt")
