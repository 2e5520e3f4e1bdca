"""Loan selection as lists of predicates; each list is one stage of the universe."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions import loan
from loanlens.spec import TOP_STATES, CohortSpec

c = F.col

LATE_STATE_LIST = 17


def vintages(spec: CohortSpec) -> Column:
    """Origination year in range, written on the raw column so that the scan can skip on it."""
    inside = F.lit(True)
    if spec.first_vintage is not None:
        inside = c("orig_date") >= str(spec.first_vintage)
    if spec.last_vintage is not None:
        inside = inside & (c("orig_date") < str(spec.last_vintage + 1))
    return inside


def _cents(amount: float, scale: int = 1) -> Column:
    """A bound in the type of the balance column, so that the comparison reaches the scan. Parts
    of a cent cannot change `>` or `<=` and are dropped."""
    exact = Decimal(str(amount)) * scale
    return F.lit(exact.quantize(Decimal("0.01"), ROUND_FLOOR)).cast("decimal(18,2)")


def _balance(low: float | None, high: float | None, scale: int = 1) -> list[Column]:
    bounds = [None if end is None else _cents(end, scale) for end in (low, high)]
    return _band(c("orig_upb"), *bounds)


def _band(x: Column, low: Column | int | None, high: Column | int | None) -> list[Column]:
    """low < x <= high, each end optional."""
    ends = []
    if low is not None:
        ends.append(x > low)
    if high is not None:
        ends.append(x <= high)
    return ends


def scan_filters(spec: CohortSpec) -> list[Column]:
    """Predicates on stored columns, pushed into the scan."""
    kept = [vintages(spec)]
    if spec.orig_months:
        kept.append(c("orig_date").isin(*spec.orig_months))
    if spec.term is not None:
        kept.append(loan.in_term_bucket(spec.term, spec.legacy_terms))
    kept += _balance(spec.min_balance_k, spec.max_balance_k, 1000)
    kept += _balance(spec.min_balance, spec.max_balance)
    if spec.state is not None:
        kept.append(c("state") == spec.state)
    if spec.exclude_state is not None:
        kept.append(c("state") != spec.exclude_state)
    if spec.states:
        kept.append(c("state").isin(*spec.states))
    if spec.top_states is not None and spec.top_states != LATE_STATE_LIST:
        kept.append(c("state").isin(*TOP_STATES[spec.top_states]))
    if spec.note_rate is not None:
        kept.append(c("orig_rate") == F.lit(spec.note_rate).cast("decimal(5,3)"))
    if spec.channel is not None:
        kept.append(c("channel") == spec.channel)
    return kept


def loan_filters(spec: CohortSpec) -> list[Column]:
    """Predicates applied after a row limit and before the percentile windows."""
    kept = []
    if spec.seller_prefix is not None:
        kept.append(c("seller").startswith(spec.seller_prefix))
    if spec.purpose is not None:
        kept.append(c("purpose") == spec.purpose)
    if spec.units is not None:
        kept.append(c("no_units") == spec.units)
    if spec.min_ltv is not None:
        kept += [F.coalesce(c("ocltv"), F.lit(99)) >= spec.min_ltv, c("oltv") >= spec.min_ltv]
    if spec.max_ltv is not None:
        kept += [F.coalesce(c("ocltv"), F.lit(0)) <= spec.max_ltv, c("oltv") <= spec.max_ltv]
    if "mi" in spec.by:
        # Lender-paid insurance would blur the comparison.
        kept.append(F.coalesce(c("mi_type"), F.lit(1)) == 1)
    if spec.first_buyer is not None:
        kept.append(c("first_flag") == spec.first_buyer)
    if spec.where is not None:
        kept.append(spec.where)
    return kept


def cohort_filters(spec: CohortSpec) -> list[Column]:
    """Predicates applied after the percentile windows; they must not change percentiles."""
    kept = []
    if spec.seller_rank is not None:
        kept.append(c("seller_rank").between(*spec.seller_rank))
    if spec.eligible_only:
        kept.append(c("eligible") == "Y")
    if spec.only_30_year:
        kept.append(loan.in_term_bucket(360, spec.legacy_terms))
    if spec.top_states == LATE_STATE_LIST:
        kept.append(c("state").isin(*TOP_STATES[LATE_STATE_LIST]))
    kept += _band(c("qfico"), *spec.scores)
    kept += _band(c("oltv"), *spec.ltvs)
    kept += _band(loan.combined_ltv(), *spec.cltvs)
    kept += _band(c("dti"), *spec.dtis)
    if spec.primary_only:
        kept.append(c("occ_stat") == "P")
    if spec.full_appraisal_only:
        kept.append(loan.appraisal() == loan.FULL_APPRAISAL)
    return kept
