"""Running credit totals along the age axis of an aggregated curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.functions.numeric import ratio
from loanlens.operators.summary import bits

c = F.col


def with_cumulative_credit(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative defaults, losses and severity per cohort.

    The window runs on the aggregated curve, one row per age, and is partitioned by every key and
    its grouping bit.
    """
    cohort = [key for key in keys if key != "loan_age"]
    along_age = (
        Window.partitionBy(*cohort, *bits(cohort))
        .orderBy(c("loan_age").asc_nulls_last())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known_age = c("loan_age").isNotNull()

    def running(name: str):
        return F.sum(F.when(known_age, c(name))).over(along_age)

    return curve.withColumns(
        {
            "cum_default_upb": running("mo_default_upb"),
            "cum_net_loss": running("mo_net_loss"),
        }
    ).withColumns(
        {
            "cum_default_pct": ratio(c("cum_default_upb"), c("cohort_upb")),
            "cum_loss_pct": ratio(c("cum_net_loss"), c("cohort_upb")),
            "cum_lgd": ratio(c("cum_net_loss"), c("cum_default_upb")),
        }
    )
