"""Group-and-subtotal aggregation, and stage 2: the cohort summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.functions import measures as m
from loanlens.operators.history import LOAN_ROW
from loanlens.spec import DIMENSION_COLUMNS, CohortSpec

c = F.col


def bit(key: str) -> str:
    """Name of a key's grouping bit: 1 on rows where the key is subtotalled away."""
    return f"g_{key}"


def bits(keys: Sequence[str]) -> list[str]:
    return [bit(key) for key in keys]


def aggregate(
    rows: DataFrame, keys: Sequence[str], measures: Sequence[m.Measure], rollup: bool
) -> DataFrame:
    """Measures per group, with rollup subtotals if asked.

    Rows are first aggregated to the finest groups, so the rollup's row expansion multiplies that
    small result and not the input. Output: keys, grouping bits, measures.
    """
    names = [*keys, *bits(keys), *(measure.name for measure in measures)]
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {names}")
    parts = m.merged_parts(measures)
    grouped = rows.groupBy(*keys).agg(
        *[m.COMPUTE[kind](column).alias(name) for name, (kind, column) in parts.items()]
    )
    if rollup:
        grouped = grouped.rollup(*keys).agg(
            *[m.MERGE[kind](name).alias(name) for name, (kind, _) in parts.items()],
            *[F.grouping(key).cast("int").alias(bit(key)) for key in keys],
        )
    else:
        grouped = grouped.withColumns({bit(key): F.lit(0) for key in keys})
    return grouped.select(
        *keys, *bits(keys), *[measure.value.alias(measure.name) for measure in measures]
    )


def cohort_summary(universe: DataFrame, spec: CohortSpec) -> DataFrame:
    """Loan count, balance and coupons of every group of the universe and every subtotal."""
    weighted = m.ratio(c("rate_upb"), c("upb"))
    measures = [
        m.Measure("wa_note_rate", {**m.rate_part(), **m.upb_part()}, m.eighths(weighted)),
        m.average_rate(),
        m.plain("max_bal", "max", c("orig_upb"), "double"),
        m.Measure("loan_cnt", m.row_part(), c("rows")),
        m.Measure("orig_upb", m.upb_part(), c("upb").cast("double")),
    ]
    return aggregate(universe, spec.loan_keys, measures, rollup=True)


def with_own_totals(report: DataFrame) -> DataFrame:
    """Cohort totals of a report with one row per loan behind it: its own count and balance."""
    return report.withColumns({"cohort_loans": c("loans"), "cohort_upb": c("orig_upb")}).withColumn(
        "cohort_als", m.ratio(c("cohort_upb"), c("cohort_loans"))
    )


def cohort_totals() -> list[m.Measure]:
    """Sums over the rows that stand for loans themselves, beside the measures of their months."""
    rows = {"p_cohort_loans": ("count", F.when(c(LOAN_ROW), 1))}
    upb = {"p_cohort_upb": ("sum", F.when(c(LOAN_ROW), c("orig_upb")))}
    return [
        m.Measure("cohort_loans", rows, c("p_cohort_loans")),
        m.Measure("cohort_upb", upb, c("p_cohort_upb").cast("double")),
    ]


def with_cohort_totals(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carry the loan count and balance of each cohort from the row that has them to all its ages.

    Loans themselves have no age, so each cohort's totals are on its row without one. A row belongs
    to a cohort by its loan keys and by which of them are subtotalled, so a NULL key and a subtotal
    stay apart. The window runs on the aggregated curve and has one row per age.
    """
    cohort = Window.partitionBy(*keys, *bits(keys))
    return curve.withColumns(
        {name: F.max(name).over(cohort) for name in ("cohort_loans", "cohort_upb")}
    ).withColumn("cohort_als", m.ratio(c("cohort_upb"), c("cohort_loans")))


# Dimensions whose average coupon is looked up by value; the others use their subtotal.
COUPON_DIMENSIONS = ("balance", "channel", "vintage", "state", "hbal")


def at_average_coupon(loans: DataFrame, spec: CohortSpec) -> DataFrame:
    """Loans whose note rate is the cohort's average coupon, rounded to an eighth.

    A loan with a NULL key finds no coupon and is kept. The keys are stored codes of no proven
    number, so the join is not hinted: AQE measures the coupons.
    """
    dimensions = [d for d in spec.dimensions if d in COUPON_DIMENSIONS]
    keys = ["loan_term", *(DIMENSION_COLUMNS[d] for d in dimensions)]
    weighted = m.ratio(F.sum(c("orig_rate") * c("orig_upb")), F.sum("orig_upb"))
    coupons = loans.groupBy(*keys).agg(m.eighths(weighted).cast("decimal(5,3)").alias("_coupon"))
    matched = loans.join(coupons, keys, "left")
    return matched.filter(c("_coupon").isNull() | (c("orig_rate") == c("_coupon"))).drop("_coupon")
