"""Report measures as mergeable parts plus a final expression.

A part is a sum, count, minimum or maximum, so it can be aggregated to the finest group first and
merged into subtotals afterwards. Ratios are taken last, over merged parts. Parts avoid text
minimums and maximums, which would force sort-based aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens.functions import performance
from loanlens.functions.loan import FULL_APPRAISAL, TERRITORIES, appraisal, combined_ltv
from loanlens.functions.numeric import ratio
from loanlens.functions.text import grouped_digits, number_range, thousands_range

c = F.col

# How a part is computed from rows, and how computed parts merge.
COMPUTE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    name: str
    parts: dict[str, tuple[str, Column]]
    value: Column


def merged_parts(measures: Iterable[Measure]) -> dict[str, tuple[str, Column]]:
    parts: dict[str, tuple[str, Column]] = {}
    for measure in measures:
        parts.update(measure.parts)
    return parts


def upb_part() -> dict[str, tuple[str, Column]]:
    return {"upb": ("sum", c("orig_upb"))}


def row_part() -> dict[str, tuple[str, Column]]:
    return {"rows": ("count", F.lit(1))}


def first_name(name: str, column: Column) -> Measure:
    """The least text of a group, such as the one name that stands for all of them."""
    return Measure(name, {f"p_{name}": ("min", column)}, c(f"p_{name}"))


def rate_part() -> dict[str, tuple[str, Column]]:
    return {"rate_upb": ("sum", c("orig_rate") * c("orig_upb"))}


def plain(name: str, kind: str, column: Column, cast: str | None = None) -> Measure:
    value = c(f"p_{name}") if cast is None else c(f"p_{name}").cast(cast)
    return Measure(name, {f"p_{name}": (kind, column)}, value)


def amount(name: str, column: Column, empty_is_zero: bool = False) -> Measure:
    value = c(f"p_{name}").cast("double")
    if empty_is_zero:
        value = F.coalesce(value, F.lit(0.0))
    return Measure(name, {f"p_{name}": ("sum", column)}, value)


def share(name: str, condition: Column, empty_is_zero: bool = False) -> Measure:
    """Part of the balance for which the condition holds; NULL (or 0) when it never does."""
    part = f"p_{name}"
    value = ratio(c(part), c("upb"))
    if empty_is_zero:
        value = F.coalesce(value, F.lit(0.0))
    return Measure(name, {**upb_part(), part: ("sum", F.when(condition, c("orig_upb")))}, value)


def weighted_average(name: str, x: Column) -> Measure:
    """Balance-weighted average over the loans that report `x`."""
    top, bottom = f"p_{name}", f"p_{name}_upb"
    return Measure(
        name,
        {
            top: ("sum", c("orig_upb") * x),
            bottom: ("sum", F.when(x.isNotNull(), c("orig_upb"))),
        },
        ratio(c(top), c(bottom)),
    )


# --- always shown ----------------------------------------------------------------------------

def size() -> list[Measure]:
    return [
        Measure("loans", row_part(), c("rows")),
        Measure("orig_upb", upb_part(), c("upb").cast("double")),
        Measure("als", {**upb_part(), **row_part()}, ratio(c("upb"), c("rows"))),
    ]


def note_rate() -> list[Measure]:
    ends = {"rate_min": ("min", c("orig_rate")), "rate_max": ("max", c("orig_rate"))}
    weighted = ratio(c("rate_upb"), c("upb"))
    parts = {**rate_part(), **upb_part()}
    return [
        Measure("wa_rate", parts, weighted),
        Measure("wa_rate_8ths", parts, eighths(weighted)),
        Measure("rate_range", ends, number_range(c("rate_min"), c("rate_max"), 3)),
    ]


def eighths(rate: Column) -> Column:
    return F.round(rate * 8, 0) / 8


def average_rate() -> Measure:
    parts = {"rate_sum": ("sum", c("orig_rate")), **row_part()}
    return Measure("avg_note_rate", parts, F.round(ratio(c("rate_sum"), c("rows")), 3))


def payment() -> Measure:
    """Balance-weighted monthly payment; needs the column `monthly_pi`."""
    parts = {"pi_upb": ("sum", c("monthly_pi") * c("orig_upb")), **upb_part()}
    return Measure("wa_pi", parts, ratio(c("pi_upb"), c("upb")))


def eligibility_marker() -> Measure:
    """'Y' only when every loan of the group is eligible."""
    part = {"elig_min": ("min", F.when(c("eligible") == "Y", 1).otherwise(0))}
    return Measure("eligible", part, F.when(c("elig_min") == 1, "Y").otherwise("N"))


def vintage_range() -> Measure:
    year = c("vintage").cast("int")
    parts = {"year_min": ("min", year), "year_max": ("max", year)}
    text = F.concat(c("year_min").cast("string"), F.lit("-"), c("year_max").cast("string"))
    return Measure("vintages", parts, text)


# --- display blocks --------------------------------------------------------------------------


def size_range(separator: str = "-", name: str = "size_range") -> Measure:
    ends = {"upb_min": ("min", c("orig_upb")), "upb_max": ("max", c("orig_upb"))}
    return Measure(name, ends, thousands_range(c("upb_min"), c("upb_max"), separator))


def segment_range() -> list[Measure]:
    """Balance and percentile range of a segment; needs `orig_upb_pctile`."""
    pctile = c("orig_upb_pctile")
    ends = {"pct_min": ("min", pctile), "pct_max": ("max", pctile)}
    return [
        size_range(" - ", "segment_range"),
        Measure(
            "segment_pctiles", ends, number_range(c("pct_min") * 100, c("pct_max") * 100, 0)
        ),
    ]


def channel_shares() -> list[Measure]:
    names = {"broker_pct": "B", "correspondent_pct": "C", "retail_pct": "R"}
    return [share(name, c("channel") == code) for name, code in names.items()]


def balance_shares(segments: tuple[str, ...]) -> list[Measure]:
    return [share(f"bal_{s.lower()}_pct", c("bal_seg") == s) for s in segments]


# States shown one by one.
SHOWN_STATES = ("CA", "AZ", "UT", "CO", "NV", "ID", "FL", "WY", "TX", "MI", "NY", "NJ")


def state_shares(states: tuple[str, ...] = SHOWN_STATES) -> list[Measure]:
    return [share(f"state_{s.lower()}_pct", c("state") == s) for s in states]


def characteristic_shares() -> list[Measure]:
    conditions = {
        "hbal_pct": c("high_balance_loan_indicator") == "Y",
        "second_home_pct": c("occ_stat") == "S",
        "insured_pct": c("mi_type") == 1,
        "cashout_pct": c("purpose") == "C",
        "first_buyer_pct": c("first_flag") == "Y",
        "condo_pct": c("prop") == "CO",
        "multi_unit_pct": c("no_units") >= 2,
        "multi_borrower_pct": c("num_bo") >= 2,
    }
    return [share(name, holds, empty_is_zero=True) for name, holds in conditions.items()]


def credit_averages() -> list[Measure]:
    names = {
        "wa_oltv": "oltv",
        "wa_ocltv": "ocltv",
        "wa_cscore_b": "cscore_b",
        "wa_cscore_c": "cscore_c",
        "wa_qfico": "qfico",
        "wa_dti": "dti",
    }
    return [weighted_average(name, c(column)) for name, column in names.items()]


def ineligible_share() -> Measure:
    return share("inel_pct", c("eligible") == "N", empty_is_zero=True)


def eligibility_breakdown() -> list[Measure]:
    conditions = {
        "investor_pct": c("occ_stat") == "I",
        "score_lt_640_pct": c("qfico") < 640,
        "ltv_gt_95_pct": combined_ltv() > 95,
        "dti_gt_45_pct": c("dti") > 45,
        "mh_pct": c("prop") == "MH",
        "pr_vi_pct": c("state").isin(*TERRITORIES),
        "appr_not_full_pct": appraisal() != FULL_APPRAISAL,
        "appr_waiver_pct": appraisal() == "W",
        "inel_b3_pct": c("inel_b3") == "Y",
        "inel_b5_pct": c("inel_b5") == "Y",
        "inel_b6_pct": c("inel_b6") == "Y",
    }
    return [share(name, holds) for name, holds in conditions.items()]


def interest_only_share() -> Measure:
    return share("io_pct", F.coalesce(c("io"), F.lit("N")) == "Y")


def sublimit_shares() -> list[Measure]:
    return [
        share(f"sublimit_{which}_pct", c(f"sublimit_{which}") == "Y", empty_is_zero=True)
        for which in ("a", "b")
    ]


# --- performance blocks ----------------------------------------------------------------------


def age_amounts() -> list[Measure]:
    """Sums of one age; needs the columns made by `operators.history.loan_months`."""
    named = ("current_bal", "sched_bal", "unsched_prin")
    return [
        *[amount(name, c(name)) for name in named],
        plain("unsched_cnt", "sum", c("unsched_cnt")),
    ]


def prepayment_speed() -> list[Measure]:
    parts = {"p_unsched_prin": ("sum", c("unsched_prin")), "p_sched_bal": ("sum", c("sched_bal"))}
    smm = F.when(c("p_sched_bal") > 0, ratio(c("p_unsched_prin"), c("p_sched_bal")))
    return [
        Measure("smm", parts, smm),
        Measure("cpr", parts, performance.cpr_from_smm(smm)),
    ]


def _of_current(name: str, part: str, column: Column, empty_is_zero: bool = False) -> Measure:
    top = c(part)
    if empty_is_zero:
        top = F.coalesce(top, F.lit(0).cast("decimal(18,2)"))
    return Measure(
        name,
        {part: ("sum", column), "p_current_bal": ("sum", c("current_bal"))},
        F.when(c("p_current_bal") > 0, ratio(top, c("p_current_bal"))),
    )


def delinquency_rates() -> list[Measure]:
    return [
        _of_current("dlq_30_pct", "p_dlq_30", c("dlq_30")),
        _of_current("dlq_60_pct", "p_dlq_60", c("dlq_60")),
        _of_current("dlq_90_pct", "p_dlq_90", c("dlq_90")),
        _of_current("fc_pct", "p_mo_default_upb", c("defaulted_upb"), empty_is_zero=True),
    ]


def monthly_credit() -> list[Measure]:
    return [
        amount("mo_default_upb", c("defaulted_upb"), empty_is_zero=True),
        plain("mo_default_cnt", "count", c("defaulted_upb")),
        amount("mo_net_loss", c("mo_net_loss"), empty_is_zero=True),
        plain("mo_loss_cnt", "count", F.when(c("mo_net_loss") > 0, 1)),
    ]


def to_date_credit() -> list[Measure]:
    """Defaults and losses up to the last period; severity is loss over defaulted balance.

    Needs the columns made by `operators.history.with_terminal_amounts`.
    """
    parts = {
        "p_default_upb": ("sum", c("default_bal")),
        "p_net_loss": ("sum", c("net_loss")),
    }
    severity = F.when(
        c("p_default_upb") > 0,
        ratio(F.coalesce(c("p_net_loss"), F.lit(0).cast("decimal(18,2)")), c("p_default_upb")),
    ).otherwise(F.lit(0.0))
    return [
        amount("default_upb", c("default_bal"), empty_is_zero=True),
        plain("default_cnt", "count", c("default_bal")),
        amount("net_loss", c("net_loss")),
        plain("loss_cnt", "count", F.when(c("net_loss") > 0, 1)),
        Measure("severity", parts, severity),
    ]


def horizon_prepayment(months: int) -> list[Measure]:
    """Actual against scheduled balance at the horizon."""
    parts = {
        "p_horizon_bal": ("sum", c("horizon_bal")),
        "p_horizon_sched": ("sum", c("horizon_sched")),
    }
    actual = F.coalesce(c("p_horizon_bal").cast("double"), F.lit(0.0))
    return [
        Measure("horizon_act", parts, actual),
        amount("horizon_sched", c("horizon_sched")),
        Measure(
            "horizon_cpr", parts, performance.horizon_cpr(actual, c("p_horizon_sched"), months)
        ),
    ]


def ever_delinquent() -> list[Measure]:
    return [
        amount("ever_60_horizon_upb", F.when(c("ever_60_horizon") == 1, c("orig_upb"))),
        amount("ever_60_upb", F.when(c("ever_60") == 1, c("orig_upb"))),
        amount("ever_120_horizon_upb", F.when(c("ever_120_horizon") == 1, c("orig_upb"))),
    ]


def income_averages() -> list[Measure]:
    """Needs the columns `monthly_pi` and `annual_income`."""
    income = c("annual_income")
    ends = {"income_min": ("min", income), "income_max": ("max", income)}
    text = F.concat(
        grouped_digits(c("income_min"), 0), F.lit(" - "), grouped_digits(c("income_max"), 0)
    )
    parts = {"income_upb": ("sum", income * c("orig_upb")), **upb_part()}
    return [
        Measure("wa_income", parts, ratio(c("income_upb"), c("upb"))),
        Measure("income_range", ends, text),
    ]
