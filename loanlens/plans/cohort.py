"""The cohort report: universe, totals, performance, display blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import amortization
from loanlens.functions import measures as m
from loanlens.functions.numeric import ratio
from loanlens.functions.segments import NAMED_ORDER
from loanlens.operators.cumulative import with_cumulative_credit
from loanlens.operators.history import (
    loans_and_months,
    with_horizon,
    with_payment,
    with_terminal_amounts,
)
from loanlens.operators.ranking import NAME_COLUMNS, with_party_names
from loanlens.operators.summary import (
    aggregate,
    cohort_totals,
    with_cohort_totals,
    with_own_totals,
)
from loanlens.operators.universe import build_universe
from loanlens.sources.tables import LoanTables
from loanlens.spec import CohortSpec

c = F.col


def max_period(tables: LoanTables) -> Column:
    """The last reporting month as a scalar subquery."""
    return tables.latest_period().scalar()


def report_measures(spec: CohortSpec) -> list[m.Measure]:
    """Measures of a run, in the order of the display blocks."""
    shown = set(spec.display)
    named = spec.seller_prefix is not None and "seller" not in spec.by
    chosen = [
        *([m.first_name(NAME_COLUMNS["seller"], c("seller"))] if named else []),
        *m.size(),
        *m.note_rate(),
        m.payment(),
        m.eligibility_marker(),
        m.vintage_range(),
    ]
    if spec.by_age:
        chosen += m.age_amounts() + m.prepayment_speed()
        chosen += m.delinquency_rates() + m.monthly_credit()
    if "channel" in shown:
        chosen += m.channel_shares()
    if "balance" in shown:
        chosen += m.balance_shares(NAMED_ORDER)
    if "geo" in shown:
        chosen += m.state_shares()
    if "strat" in shown:
        chosen += [m.size_range(), *m.characteristic_shares(), *m.credit_averages()]
        chosen += [m.ineligible_share(), *m.sublimit_shares(), *m.to_date_credit()]
    if "elig" in shown:
        chosen += m.eligibility_breakdown()
    if "history" in shown:
        chosen += m.horizon_prepayment(spec.prepay_horizon) + m.ever_delinquent()
    if "income" in shown:
        chosen += m.income_averages()
    if spec.shows_segment_range:
        chosen += m.segment_range()
    return chosen


def report_rows(
    tables: LoanTables, universe: DataFrame, spec: CohortSpec
) -> DataFrame:
    """Rows the report aggregates: loans and their months, loans at the horizon, or loans."""
    loans = with_payment(universe)
    if "income" in spec.display:
        income = amortization.annual_income(c("monthly_pi"), c("dti"))
        loans = loans.withColumn("annual_income", income)
    if spec.by_age:
        return loans_and_months(loans, tables.of_vintages("month", spec))
    loans = with_terminal_amounts(loans)
    if "history" in spec.display:
        month = tables.of_vintages("month", spec)
        at_horizon = with_horizon(loans, month, max_period(tables), spec)
        # Terminal amounts count on the history row they fall on, which here is the horizon row.
        placed = c("horizon_period") == c("term_period").cast("int")
        return at_horizon.withColumns(
            {name: F.when(placed, c(name)) for name in ("default_bal", "net_loss")}
        )
    return loans


def with_cohort_shares(report: DataFrame, spec: CohortSpec) -> DataFrame:
    """Percentages of the whole cohort's original balance."""
    of_cohort = {}
    if "strat" in spec.display:
        of_cohort["default_pct"] = "default_upb"
        of_cohort["loss_pct"] = "net_loss"
    if "history" in spec.display:
        of_cohort["ever_60_horizon_pct"] = "ever_60_horizon_upb"
        of_cohort["ever_60_pct"] = "ever_60_upb"
        of_cohort["ever_120_horizon_pct"] = "ever_120_horizon_upb"
    zero = F.lit(0.0)
    return report.withColumns(
        {
            name: ratio(F.coalesce(c(top), zero), c("cohort_upb"))
            for name, top in of_cohort.items()
        }
    )


def cohort_report(
    tables: LoanTables, spec: CohortSpec, universe: DataFrame | None = None
) -> DataFrame:
    """One row per group: keys, grouping bits, cohort totals and the chosen measures, unsorted.

    Pass a persisted `universe` to share it between reports; otherwise it is derived where needed,
    with only the columns each use needs.
    """
    measured = build_universe(tables, spec) if universe is None else universe
    rows = report_rows(tables, measured, spec)
    measures = report_measures(spec) + (cohort_totals() if spec.by_age else [])
    report = aggregate(rows, spec.group_keys, measures, spec.rollup)
    if spec.by_age:
        report = with_cohort_totals(report, spec.loan_keys)
        report = report.filter(c("loan_age").isNotNull())
    else:
        report = with_own_totals(report)
    if spec.min_count is not None:
        report = report.filter(c("loans") >= spec.min_count)
    report = with_party_names(report, tables.orig, spec)
    if spec.by_age:
        report = with_cumulative_credit(report, spec.group_keys)
    return with_cohort_shares(report, spec)


def age_curve(tables: LoanTables, spec: CohortSpec) -> DataFrame:
    """Prepayment, delinquency, default and loss by loan age."""
    by = spec.by if spec.by_age else (*spec.by, "age")
    return cohort_report(tables, spec.but(by=by))


def strat_report(tables: LoanTables, spec: CohortSpec) -> DataFrame:
    """Stratification table with to-date credit results."""
    return cohort_report(tables, spec.but(display=("strat", *spec.display)))


def horizon_report(tables: LoanTables, spec: CohortSpec) -> DataFrame:
    """Prepayment and delinquency at a fixed age."""
    return cohort_report(tables, spec.but(display=("history", *spec.display)))
