"""Arithmetic that keeps SQL NULL rules: a NULL operand or a zero divisor gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def ratio(top: Column, bottom: Column) -> Column:
    """Divide as doubles; NULL when the divisor is zero.

    Sums stay exact decimals up to this point, so the quotient does not depend on the order in
    which tasks added their rows.
    """
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def money(amount: Column) -> Column:
    """Round a computed amount to cents so that sums over it are exact."""
    return amount.cast(MONEY)


def guarded(value: Column, *operands: Column) -> Column:
    """`value`, or NULL when any operand is NULL (greatest() and least() skip NULLs in Spark)."""
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in operands])
    return F.when(present, value)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def yes_no(condition: Column) -> Column:
    """'Y' when the condition holds, 'N' when it does not or is unknown."""
    return F.when(condition, F.lit("Y")).otherwise(F.lit("N"))
