"""Presentation of report frames: labels, order, text, and the shapes charts and tables use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions import text
from loanlens.functions.numeric import ratio
from loanlens.functions.segments import CONFORMING, NAMED_ORDER, SUPER, order_of
from loanlens.operators.positions import with_row_numbers
from loanlens.operators.summary import bit, bits
from loanlens.spec import DIMENSION_COLUMNS, CohortSpec

c = F.col

# Order in which dimensions sort the report.
SORT_ORDER = (
    "vintage",
    "state",
    "hbal",
    "first",
    "second_home",
    "seller",
    "servicer",
    "mi",
    "channel",
    "balance",
    "age",
)

# Decimal places of report columns: fractions shown as percentages, and plain numbers.
PERCENT_PLACES = {
    "cpr": 2,
    "smm": 6,
    "dlq_30_pct": 2,
    "dlq_60_pct": 2,
    "dlq_90_pct": 2,
    "fc_pct": 2,
    "cum_default_pct": 6,
    "cum_loss_pct": 6,
    "cum_lgd": 1,
    "horizon_cpr": 2,
    "ever_60_horizon_pct": 6,
    "ever_60_pct": 6,
    "default_pct": 6,
    "loss_pct": 6,
    "severity": 3,
}
OTHER_PERCENT_PLACES = 2
NUMBER_PLACES = {
    "wa_rate": 3,
    "wa_rate_8ths": 3,
    "wa_oltv": 1,
    "wa_ocltv": 1,
    "wa_cscore_b": 1,
    "wa_cscore_c": 1,
    "wa_qfico": 1,
    "wa_dti": 1,
}


def sort_columns(spec: CohortSpec) -> list[Column]:
    """Term descending, then each dimension with its subtotal after its values."""
    order = [c("loan_term").desc_nulls_last()]
    for name in SORT_ORDER:
        if name not in spec.by:
            continue
        key = DIMENSION_COLUMNS[name]
        order.append(c(bit(key)).asc())
        if name == "balance":
            steps = spec.segments.steps if spec.segments else ()
            names = [*(f"{s}K" for s in steps), CONFORMING, SUPER] if steps else NAMED_ORDER
            order.append(order_of(c(key), names).asc())
        order.append(c(key).asc_nulls_last())
    return order


def labels(spec: CohortSpec) -> dict[str, Column]:
    """Label column per dimension: subtotal names, occupancy names, keys as text."""
    named = {"cohort_term": ("loan_term", "loan_term")}
    named |= {f"cohort_{d}": (d, DIMENSION_COLUMNS[d]) for d in spec.dimensions}
    return {
        label: text.dimension_label(name, c(key), c(bit(key)))
        for label, (name, key) in named.items()
    }


def filter_echo(spec: CohortSpec) -> dict[str, Column]:
    """Columns that repeat which filters and cutoffs were applied."""
    echo: dict[str, Column] = {}
    if not spec.single_vintage:
        echo["cohort_vintages"] = c("vintages")
    if spec.eligible_only:
        echo["cohort_eligible"] = c("eligible")
    if spec.purpose is not None:
        echo["cohort_purpose"] = F.lit(spec.purpose)
    if spec.units is not None:
        echo["cohort_units"] = F.lit(spec.units)
    if spec.min_ltv is not None:
        echo["cohort_min_ltv"] = F.lit(spec.min_ltv)
    if spec.max_ltv is not None:
        echo["cohort_max_ltv"] = F.lit(spec.max_ltv)
    if "mi" in spec.by:
        echo["cohort_has_mi"] = F.lit("Y")
    if "balance" in spec.by and spec.segments is not None:
        if spec.segments.low_k is not None:
            echo["segment_criteria"] = F.lit(f"{spec.segments.low_k}k - {spec.segments.medium_k}k")
        elif spec.segments.percentile:
            _, low, medium = spec.segments.edges
            echo["segment_criteria"] = F.lit(f"{low:.2f} - {medium:.2f}")
    if "history" in spec.display:
        echo["prepay_horizon"] = F.lit(spec.prepay_horizon)
        echo["delinquency_horizon"] = F.lit(spec.delinquency_horizon)
    return echo


def present(report: DataFrame, spec: CohortSpec) -> DataFrame:
    """Sorted report with labels and filter echo in front of the measures."""
    measured = [
        name
        for name in report.columns
        if name not in {*spec.group_keys, *bits(spec.group_keys)} or name == "loan_age"
    ]
    return report.sort(*sort_columns(spec)).select(
        *[column.alias(name) for name, column in {**labels(spec), **filter_echo(spec)}.items()],
        *measured,
    )


def numbered(report: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add the row's position in report order. The report is computed once, into the shared folder."""
    return with_row_numbers(report, sort_columns(spec), "row_num")


def render(report: DataFrame, human: bool) -> DataFrame:
    """Fractions and numbers formatted for people, or rounded for programs."""

    def shown(name: str, kind: str) -> Column:
        if kind not in ("double", "bigint"):
            return c(name)
        if name in PERCENT_PLACES or name.endswith("_pct"):
            places = PERCENT_PLACES.get(name, OTHER_PERCENT_PLACES)
            rendered = text.percent(c(name), places, human)
            return F.coalesce(rendered, F.lit("")) if human and name == "cum_lgd" else rendered
        return text.number(c(name), NUMBER_PLACES.get(name, 0), human)

    return report.select(*[shown(name, kind).alias(name) for name, kind in report.dtypes])


def sample_check(report: DataFrame) -> DataFrame:
    """Short table to compare a cohort with an outside sample; needs strat, geo, channel, elig."""
    percentages = {
        "state_ca_pct": c("state_ca_pct"),
        "state_tx_pct": c("state_tx_pct"),
        "state_ny_pct": c("state_ny_pct"),
        "tpo_pct": 1 - c("retail_pct"),
        "second_home_pct": c("second_home_pct"),
        "first_buyer_pct": c("first_buyer_pct"),
        "insured_pct": c("insured_pct"),
        "condo_pct": c("condo_pct"),
        "multi_borrower_pct": c("multi_borrower_pct"),
        "multi_unit_pct": c("multi_unit_pct"),
        "appr_not_full_pct": c("appr_not_full_pct"),
        "eligible_pct": 1 - c("inel_pct"),
    }
    return report.select(
        F.substring("vintages", 1, 4).alias("vintage"),
        text.dimension_label("loan_term", c("loan_term"), c(bit("loan_term"))).alias("term"),
        c("cohort_loans"),
        c("cohort_upb"),
        c("rate_range"),
        c("als"),
        *[c(name) for name in ("wa_oltv", "wa_ocltv", "wa_qfico", "wa_dti")],
        *[column.alias(name) for name, column in percentages.items()],
    )


def chart_frame(curve: DataFrame) -> DataFrame:
    """Series for the curves: speed and total delinquency per age, channel and occupancy."""
    return curve.select(
        "loan_term",
        "channel",
        "second_home",
        "loan_age",
        "cpr",
        (c("dlq_30_pct") + c("dlq_60_pct") + c("dlq_90_pct")).alias("total_dlq_pct"),
    )


def perf_table(curve: DataFrame, spec: CohortSpec) -> DataFrame:
    """Printed per-age table: cohort size, average loan size and formatted rates."""
    occupancy = text.dimension_label(
        "second_home", c("second_home"), c(bit("second_home"))
    )
    rates = {
        "CPR %": "cpr",
        "D30 %": "dlq_30_pct",
        "D60 %": "dlq_60_pct",
        "D90+ %": "dlq_90_pct",
    }
    whole = {
        "Orig. Loan Count": c("cohort_loans"),
        "Orig. UPB": c("cohort_upb"),
        "Orig. ALS": ratio(c("cohort_upb"), c("cohort_loans")),
    }
    return curve.select(
        c("loan_age").alias("Loan Age"),
        c("loan_term").cast("string").alias("Term"),
        occupancy.alias("Occ"),
        c("eligible").alias("MAP Elig."),
        *[text.number(x.cast("double"), 0, human=True).alias(name) for name, x in whole.items()],
        *[text.percent(c(x), 2, human=True).alias(name) for name, x in rates.items()],
        text.number(c("wa_rate"), 3, human=True).alias("Rate"),
    )
