"""The older one-pass reports: vintage report, combined report, and its age curve.

They always show subtotals, bucket terms three ways, keep early payoffs, and join the terminal
record on the loan alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import measures as m
from loanlens.functions import performance
from loanlens.functions.numeric import ratio
from loanlens.operators.history import (
    month_columns,
    usable_history,
    with_growth,
    with_horizon,
    with_scheduled,
    with_terminal_amounts,
)
from loanlens.operators.ranking import with_party_names
from loanlens.operators.summary import aggregate
from loanlens.operators.universe import build_universe
from loanlens.plans.cohort import max_period
from loanlens.sources.tables import LoanTables
from loanlens.spec import DIMENSION_COLUMNS, CohortSpec

c = F.col

VINTAGE_REPORT_ORDER = ("vintage", "state", "channel", "first", "seller", "servicer")
COMBINED_REPORT_ORDER = ("vintage", "state", "hbal", "first", "seller", "servicer", "channel")


def legacy_spec(spec: CohortSpec) -> CohortSpec:
    return spec.but(legacy_terms=True, drop_early_payoffs=False, rollup=True)


def _counted(report: DataFrame, spec: CohortSpec) -> DataFrame:
    """Groups with enough loans."""
    return report if spec.min_count is None else report.filter(c("loans") >= spec.min_count)


def _keys(spec: CohortSpec, order: Sequence[str]) -> list[str]:
    unsupported = set(spec.by) - set(order) - {"age"}
    if unsupported:
        raise ValueError(f"this report cannot group by {sorted(unsupported)}")
    return ["loan_term", *(DIMENSION_COLUMNS[d] for d in order if d in spec.by)]


def _to_date() -> list[m.Measure]:
    parts = {"p_default_upb": ("sum", c("default_bal")), **m.upb_part()}
    return [
        m.amount("default_upb", c("default_bal")),
        m.Measure("default_pct", parts, ratio(c("p_default_upb"), c("upb"))),
    ]


def _ever(name: str, flag: str) -> m.Measure:
    return m.share(name, c(flag) == 1)


def _horizon(spec: CohortSpec) -> list[m.Measure]:
    parts = {
        "p_horizon_bal": ("sum", c("horizon_bal")),
        "p_horizon_sched": ("sum", c("horizon_sched")),
    }
    speed = performance.horizon_cpr(c("p_horizon_bal"), c("p_horizon_sched"), spec.prepay_horizon)
    return [
        m.amount("horizon_act", c("horizon_bal")),
        m.amount("horizon_sched", c("horizon_sched")),
        m.Measure("horizon_cpr", parts, speed),
    ]


def vintage_report(
    tables: LoanTables,
    spec: CohortSpec,
    prepayment: bool = True,
    credit: bool = True,
) -> DataFrame:
    """Sizes, credit averages and shares, optionally horizon speed and ever-delinquent shares."""
    spec = legacy_spec(spec)
    universe = with_terminal_amounts(build_universe(tables, spec))
    if prepayment or credit:
        month = tables.of_vintages("month", spec)
        universe = with_horizon(universe, month, max_period(tables), spec, filled=False)
    measures = [*m.size(), m.average_rate(), *m.credit_averages(), *m.characteristic_shares()]
    measures.append(m.ineligible_share())
    breakdown = {measure.name: measure for measure in m.eligibility_breakdown()}
    if "elig" not in spec.display:
        breakdown = {"appr_not_full_pct": breakdown["appr_not_full_pct"]}
    measures += breakdown.values()
    if "vintage" in spec.display:
        measures.append(m.vintage_range())
    if "geo" in spec.display:
        measures += m.state_shares(m.SHOWN_STATES[:10])
    if "elig" in spec.display:
        measures += m.sublimit_shares()
    if prepayment:
        measures += _horizon(spec)
    if credit:
        measures += _to_date()
        measures += [_ever("ever_60_pct", "ever_60_horizon")]
        measures += [_ever("ever_120_pct", "ever_120_horizon")]
    report = aggregate(universe, _keys(spec, VINTAGE_REPORT_ORDER), measures, rollup=True)
    return with_party_names(_counted(report, spec), tables.orig, spec)


def grand_total(loans: DataFrame) -> Column:
    """The original balance of all loans, as a scalar subquery; null without loans."""
    return loans.agg(F.sum("orig_upb").cast("double")).scalar()


def combined_report(tables: LoanTables, spec: CohortSpec) -> DataFrame:
    """All display blocks of the combined report; `history` adds the horizon block."""
    spec = legacy_spec(spec).but(legacy_eligibility=True)
    loans = build_universe(tables, spec)
    rows = with_terminal_amounts(loans)
    shown = set(spec.display)
    measures = list(m.size())
    if "vintage" in shown:
        measures.append(m.vintage_range())
    if "channel" in shown:
        measures += m.channel_shares()
    if "geo" in shown:
        measures += m.state_shares(m.SHOWN_STATES[:10])
    if "strat" in shown:
        measures += [*m.characteristic_shares(), *m.credit_averages(), m.ineligible_share()]
        measures += [*m.sublimit_shares(), *_to_date()]
        parts = {"p_net_loss": ("sum", c("net_loss")), **m.upb_part()}
        measures += [
            m.amount("net_loss", c("net_loss")),
            m.Measure("net_loss_pct", parts, ratio(c("p_net_loss"), c("upb"))),
        ]
    if "elig" in shown:
        measures += [*m.eligibility_breakdown(), m.interest_only_share()]
    if "history" in shown:
        rows = with_horizon(rows, tables.of_vintages("month", spec), max_period(tables), spec)
        measures += [*_horizon(spec), _ever("ever_60_pct", "ever_60_horizon")]
    report = aggregate(rows, _keys(spec, COMBINED_REPORT_ORDER), measures, rollup=True)
    report = with_party_names(report, tables.orig, spec)
    if "strat" in shown:
        report = report.withColumn("total_orig_upb", grand_total(loans))
    return _counted(report, spec)


def combined_age_curve(tables: LoanTables, spec: CohortSpec) -> DataFrame:
    """Age curve of the combined report: age is the last key, loans without history are kept. It
    has no display blocks.

    A loan has at most one history row per month, so the left join cannot meet a heavy loan.
    """
    if spec.display:
        raise ValueError(f"this curve cannot show {sorted(spec.display)}")
    spec = legacy_spec(spec).but(legacy_eligibility=True)
    loans = with_growth(with_terminal_amounts(build_universe(tables, spec)))
    history = usable_history(tables.of_vintages("month", spec))
    joined = loans.join(history, "loan_id", "left")
    zero = F.lit(0).cast("decimal(18,2)")
    rows = with_scheduled(joined).withColumns(month_columns(needs_age=False, no_loss=zero))
    measures = [
        *m.size(),
        *[m.amount(name, c(name)) for name in ("current_bal", "sched_bal", "unsched_prin")],
        *m.prepayment_speed(),
        m.amount("mo_net_loss", c("mo_net_loss")),
        *m.delinquency_rates()[:3],
    ]
    keys = [*_keys(spec, COMBINED_REPORT_ORDER), "loan_age"]
    report = aggregate(rows, keys, measures, rollup=True)
    return with_party_names(_counted(report, spec), tables.orig, spec)
