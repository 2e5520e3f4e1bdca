"""Attributes of one loan at origination: buckets, flags, programme rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions.numeric import all_of, any_of, guarded, yes_no

c = F.col

# Term buckets in months, smallest term that falls above each bucket edge.
TERM_EDGES = ((360, 480), (240, 360), (180, 240))
LEGACY_TERM_EDGES = ((240, 360), (180, 240))
SHORTEST_TERM = 180

# What a missing input counts as.
MISSING_SCORE = 999
MISSING_LTV = 100
MISSING_DTI = 100
FULL_APPRAISAL = "A"
TERRITORIES = ("PR", "VI")

# Programme limits.
MAX_DTI = 45
MAX_CLTV = 95
MIN_SCORE = 640


def vintage() -> Column:
    return F.substring(c("orig_date"), 1, 4)


def term_bucket(legacy: bool = False) -> Column:
    """Contract term in months rounded up to a reporting bucket."""
    edges = LEGACY_TERM_EDGES if legacy else TERM_EDGES
    bucket = F.lit(SHORTEST_TERM)
    for edge, label in reversed(edges):
        bucket = F.when(c("orig_term") > edge, F.lit(label)).otherwise(bucket)
    return bucket


def in_term_bucket(label: int, legacy: bool = False) -> Column:
    """`term_bucket` equals the label, written as a range of the stored column."""
    edges = LEGACY_TERM_EDGES if legacy else TERM_EDGES
    months = c("orig_term")
    if label == SHORTEST_TERM:
        return months.isNull() | (months <= min(edge for edge, _ in edges))
    for k, (edge, name) in enumerate(edges):
        if name == label:
            above = months > edge
            return above & (months <= edges[k - 1][0]) if k else above
    return F.lit(False)


def second_home() -> Column:
    return yes_no(c("occ_stat") == "S")


def mi_flag() -> Column:
    """Borrower-paid mortgage insurance."""
    return yes_no(c("mi_type") == 1)


def qualifying_score() -> Column:
    """Lower of the two borrowers' scores; unknown without the first borrower's."""
    co_borrower = F.coalesce(c("cscore_c"), F.lit(MISSING_SCORE))
    return guarded(F.least(co_borrower, c("cscore_b")), c("cscore_b"))


def ltv() -> Column:
    return F.coalesce(c("oltv"), F.lit(MISSING_LTV))


def combined_ltv() -> Column:
    return F.coalesce(c("ocltv"), c("oltv"), F.lit(MISSING_LTV))


def dti_or_worst() -> Column:
    return F.coalesce(c("dti"), F.lit(MISSING_DTI))


def appraisal() -> Column:
    return F.coalesce(c("property_inspection_waiver_indicator"), F.lit(FULL_APPRAISAL))


# --- layered-risk rules -------------------------------------------------------------------------
# Each rule is a trigger (which loans it looks at) and a demand on those loans. Limits are fixed
# values of the programme.


def _medium_ltv_trigger() -> Column:
    return ltv() > 65


def _layered_risk_trigger() -> Column:
    cash_out = all_of(c("purpose") == "C", combined_ltv() >= 80, c("orig_term") >= 240)
    condo = all_of(c("prop") == "CO", ltv() >= 80)
    multi_unit = all_of(c("no_units") >= 2, ltv() >= 75)
    second_lien = all_of(c("ocltv").isNotNull(), c("ocltv") < 90, c("oltv") >= 70)
    return any_of(cash_out, condo, multi_unit, second_lien)


def _high_cltv_trigger() -> Column:
    return all_of(c("ocltv").isNotNull(), c("ocltv") >= 90, c("oltv") >= 70)


def _holds(trigger: Column, demand: Column) -> Column:
    """An unknown trigger leaves the loan alone; an unknown demand fails it."""
    untouched = ~F.coalesce(trigger, F.lit(False))
    return untouched | F.coalesce(demand, F.lit(False))


def eligible(legacy: bool = False) -> Column:
    """Programme eligibility 'Y'/'N'. The legacy rule also bars penalty and interest-only loans."""
    score = qualifying_score()
    terms = [
        c("occ_stat") != "I",
        dti_or_worst() <= MAX_DTI,
        combined_ltv() <= MAX_CLTV,
        score >= MIN_SCORE,
        c("prop") != "MH",
        ~c("state").isin(*TERRITORIES),
        appraisal() == FULL_APPRAISAL,
        _holds(_medium_ltv_trigger(), score >= 660),
        _holds(_layered_risk_trigger(), all_of(c("cscore_b") >= 700, dti_or_worst() <= 45)),
        _holds(_high_cltv_trigger(), all_of(c("cscore_b") >= 720, dti_or_worst() <= 43)),
    ]
    if legacy:
        terms += [F.coalesce(c(flag), F.lit("N")) == "N" for flag in ("ppmt_flg", "io")]
    return yes_no(all_of(*terms))


def fails_medium_ltv() -> Column:
    return yes_no(all_of(_medium_ltv_trigger(), qualifying_score() < 660))


def fails_layered_risk() -> Column:
    weak = any_of(c("cscore_b") < 700, dti_or_worst() > 45)
    return yes_no(all_of(_layered_risk_trigger(), weak))


def fails_high_cltv() -> Column:
    weak = any_of(c("cscore_b") < 720, dti_or_worst() > 43)
    return yes_no(all_of(_high_cltv_trigger(), weak))


def sublimit_a() -> Column:
    return yes_no(all_of(qualifying_score() < 760, combined_ltv() >= 85))


def sublimit_b() -> Column:
    return yes_no(all_of(qualifying_score() < 720, combined_ltv() >= 75, combined_ltv() < 85))
