"""Stage 1: the loans a cohort is made of, with their derived attributes.

One row per loan, carrying the origination columns, the derived attributes and the columns of the
terminal record (period renamed `term_period`). Nothing is cached here: the universe is a narrow
scan of the loan-level tables, far smaller than the history it is joined to, and unused columns are
pruned per consumer. Callers that run several reports over one universe may `persist()` it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import loan, segments
from loanlens.operators.filters import cohort_filters, loan_filters, scan_filters
from loanlens.operators.joins import join_on_keys
from loanlens.operators.percentile import (
    cutoffs,
    value_counts,
    value_ranks,
    with_percent_rank,
)
from loanlens.operators.ranking import with_rank
from loanlens.operators.summary import at_average_coupon
from loanlens.sources.tables import LoanTables
from loanlens.spec import CohortSpec

c = F.col

BALANCE_GROUP = ("high_balance_loan_indicator", "vintage")
RATE_GROUP = ("vintage",)
BALANCE_RANGE = 1000.0
RATE_RANGE = 1.0


def _filtered(frame: DataFrame, predicates: list) -> DataFrame:
    for predicate in predicates:
        frame = frame.filter(predicate)
    return frame


def _joined_terminal(loans: DataFrame, term: DataFrame) -> DataFrame:
    terminal = term.withColumnRenamed("act_period", "term_period")
    return loans.join(terminal, "loan_id", "left")


def _kept_terminal(spec: CohortSpec) -> list[Column]:
    if not spec.drop_early_payoffs:
        return []
    return [c("zb_dte").isNull() | (c("zb_dte") > c("first_pay"))]


def _with_terminal(loans: DataFrame, term: DataFrame, spec: CohortSpec) -> DataFrame:
    return _filtered(_joined_terminal(loans, term), _kept_terminal(spec))


def is_of_loan(spec: CohortSpec) -> bool:
    """A loan and its terminal record alone say whether the loan is in the cohort, and in which
    segment."""
    percentile = spec.segments is not None and spec.segments.percentile
    others = spec.limit, spec.seller_rank, percentile or None, spec.average_coupon_only or None
    derived = spec.legacy_terms or spec.legacy_eligibility  # differ from `with_attributes`'s own
    return all(x is None for x in others) and not derived


def in_cohort(spec: CohortSpec) -> Column:
    """All filters of a spec that `is_of_loan`, over a loan with attributes and terminal record."""
    filters = [
        *scan_filters(spec),
        *_kept_terminal(spec),
        *loan_filters(spec),
        *cohort_filters(spec),
    ]
    return reduce(lambda a, b: a & b, filters)


def with_terminal(
    tables: LoanTables, vintages: CohortSpec, specs: Iterable[CohortSpec]
) -> DataFrame:
    """Loans that pass some spec's filters on stored columns, with their terminal records."""
    passed = [reduce(lambda a, b: a & b, scan_filters(spec)) for spec in specs]
    loans = _filtered(tables.orig, scan_filters(vintages))
    loans = loans.filter(reduce(lambda a, b: a | b, passed))
    return _joined_terminal(loans, tables.of_vintages("term", vintages))


def with_attributes(
    orig: DataFrame, legacy_terms: bool = False, legacy_eligibility: bool = False
) -> DataFrame:
    """Origination rows plus every derived attribute; unused ones are pruned by the optimizer."""
    return orig.withColumns(
        {
            "vintage": loan.vintage(),
            "loan_term": loan.term_bucket(legacy_terms),
            "second_home": loan.second_home(),
            "mi_flag": loan.mi_flag(),
            "qfico": loan.qualifying_score(),
            "eligible": loan.eligible(legacy_eligibility),
            "inel_b3": loan.fails_medium_ltv(),
            "inel_b5": loan.fails_layered_risk(),
            "inel_b6": loan.fails_high_cltv(),
            "sublimit_a": loan.sublimit_a(),
            "sublimit_b": loan.sublimit_b(),
        }
    )


def _with_balance_percentile(loans: DataFrame, counts: DataFrame) -> DataFrame:
    """`group_pctile` for every loan; `orig_upb_pctile` only for those below the size limit."""
    ranked = with_percent_rank(
        loans, BALANCE_GROUP, "orig_upb", BALANCE_RANGE, "group_pctile", counts
    )
    conforming = F.coalesce(c("high_balance_loan_indicator"), F.lit("N")) == "N"
    return ranked.withColumn("orig_upb_pctile", F.when(conforming, c("group_pctile")))


def _with_percentile_cutoffs(
    loans: DataFrame, counts: DataFrame, edges: tuple[float, ...]
) -> DataFrame:
    """Segment cutoffs of each group beside its loans, without ranking every loan."""
    ranks = value_ranks(counts, BALANCE_GROUP, "orig_upb", BALANCE_RANGE)
    cuts = cutoffs(ranks, BALANCE_GROUP, "orig_upb", edges)
    return join_on_keys(loans, cuts, BALANCE_GROUP)


def segment_of(spec: CohortSpec) -> Column:
    """The segment column: worked out from the loan, or `bal_seg` where that takes the cohort."""
    wanted = spec.segments
    if wanted is None or wanted.percentile:
        return c("bal_seg")
    if wanted.steps:
        return segments.by_steps(wanted.steps)
    return segments.by_cutoffs(wanted.low_k, wanted.medium_k, wanted.very_low_k)


def _with_segment(
    loans: DataFrame, counts: DataFrame | None, spec: CohortSpec, ranked: bool
) -> DataFrame:
    wanted = spec.segments
    if wanted is None:
        return loans
    if not wanted.percentile:
        return loans.withColumn("bal_seg", segment_of(spec))
    if ranked:
        return loans.withColumn("bal_seg", segments.by_percentile(c("group_pctile"), wanted.edges))
    cut_names = [f"_cut{i}" for i in range(len(wanted.edges))]
    return (
        _with_percentile_cutoffs(loans, counts, wanted.edges)
        .withColumn("bal_seg", segments.by_percentile_cutoffs([c(n) for n in cut_names]))
        .drop(*cut_names)
    )


#: Ranges that ids are counted in at once.
ID_RANGES = 4096


def first_loans(loans: DataFrame, n: int) -> DataFrame:
    """The n loans with the smallest ids, by a bound on the id: no row is sorted or sent.

    Ids are counted in even ranges, then in ranges of the one range that the n-th id is in, until a
    range is one id wide. Ids take at most six such counts (64 bits, 12 at a time), each a pass that
    the bounds so far reach into; they run when the plan is built.
    """
    ends = loans.agg(F.min("loan_id"), F.max("loan_id")).first()
    if ends[0] is None:
        return loans
    (low, high), rest = ends, n
    while True:
        width = (high - low) // ID_RANGES + 1
        at = F.expr(f"(CAST(loan_id AS DECIMAL(20,0)) - ({low}BD)) DIV {width}BD")
        inside = loans.filter(c("loan_id").between(low, high))
        counts = dict(inside.groupBy(at.alias("at")).count().collect())
        for k in sorted(counts):
            if counts[k] >= rest:
                break
            rest -= counts[k]
        else:
            return loans  # there are no more than n
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        if width == 1:
            return loans.filter(c("loan_id") <= low)


def windowed_universe(
    tables: LoanTables, spec: CohortSpec, percentiles: tuple[str, ...] = ()
) -> DataFrame:
    """Loans after the early filters, with segment and percentiles, before the late filters.

    `percentiles` names the percent ranks to attach: "balance" (not for super-conforming loans)
    and "rate".
    """
    loans = _filtered(tables.orig, scan_filters(spec))
    loans = _with_terminal(loans, tables.of_vintages("term", spec), spec)
    if spec.limit is not None:
        loans = first_loans(loans, spec.limit)
    loans = with_attributes(
        _filtered(loans, loan_filters(spec)), spec.legacy_terms, spec.legacy_eligibility
    )
    segmented = spec.segments is not None and spec.segments.percentile
    ranked = [*BALANCE_GROUP, "orig_upb"] if "balance" in percentiles or segmented else []
    ranked += ["orig_rate", "vintage"] if "rate" in percentiles else []
    # One count of the loans serves every rank; Spark reuses its shuffle.
    counts = value_counts(loans, tuple(dict.fromkeys(ranked))) if ranked else None
    if "balance" in percentiles:
        loans = _with_balance_percentile(loans, counts)
    loans = _with_segment(loans, counts, spec, "balance" in percentiles)
    if "rate" in percentiles:
        loans = with_percent_rank(
            loans, RATE_GROUP, "orig_rate", RATE_RANGE, "orig_rate_pctile", counts
        )
    return loans


def build_universe(
    tables: LoanTables, spec: CohortSpec, percentiles: tuple[str, ...] | None = None
) -> DataFrame:
    """The loans of the cohort; by default with the percentiles that the spec's report shows."""
    if percentiles is None:
        percentiles = ("balance",) if spec.shows_segment_range else ()
    loans = windowed_universe(tables, spec, percentiles)
    if "seller" in spec.by or spec.seller_rank is not None:
        loans = with_rank(loans, tables.orig, spec, "seller")
    if "servicer" in spec.by:
        loans = with_rank(loans, tables.orig, spec, "servicer")
    loans = _filtered(loans, cohort_filters(spec))
    if spec.average_coupon_only:
        loans = at_average_coupon(loans, spec)
    return loans
