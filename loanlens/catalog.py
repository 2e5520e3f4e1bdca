"""Named queries over loans derived from the star schema: one per operator of the engine.

Every query runs over the whole derived tables. Amounts leave as doubles rounded to cents, ratios
as doubles rounded to six places, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions import amortization, performance, segments, text
from loanlens.functions import measures as m
from loanlens.operators import history
from loanlens.operators.ranking import NAME_COLUMNS, party_ranks
from loanlens.operators.summary import aggregate, bits, cohort_summary
from loanlens.operators.universe import build_universe, with_attributes
from loanlens.plans import legacy, shapes, sweep
from loanlens.plans.cohort import age_curve, cohort_report, horizon_report, strat_report
from loanlens.session import tune
from loanlens.sources.shared import new_folder
from loanlens.sources.tables import LoanTables
from loanlens.spec import BalanceSegments, CohortSpec

c = F.col

Query = Callable[[LoanTables], DataFrame]
QUERIES: dict[str, Query] = {}

ALL = CohortSpec()
CUTOFFS = BalanceSegments(low_k=150, medium_k=300, very_low_k=80)
STEPS = BalanceSegments(steps=(
    "085", "110", "125", "150", "175", "200", "225", "250", "275", "500",
))
PERCENTILES = BalanceSegments(percentile=True)

# Doubles that hold amounts of money.
AMOUNT_SUFFIXES = ("_upb", "_bal", "_prin", "_loss", "_costs", "_credits", "_property", "_proceeds")
AMOUNTS = {
    "dlq_30",
    "dlq_60",
    "dlq_90",
    "horizon_act",
    "horizon_sched",
    "monthly_pi",
    "sched_0",
    "sched_12",
    "sched_24",
    "sched_at_term",
    "volume",
    "wa_income",
    "wa_pi",
}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def query_named(name: str) -> Callable[[Query], Query]:
    """For names that an imported function already has."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def finished(frame: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns with the output types of this module."""

    def output(name: str, kind: str) -> Column:
        column = c(name)
        if kind.startswith("decimal") or kind == "double":
            money = name in AMOUNTS or name.endswith(AMOUNT_SUFFIXES)
            column = F.round(column.cast("double"), 2 if money else 6)
        elif kind == "int":
            column = column.cast("bigint")
        return column.alias(name)

    kinds = dict(frame.dtypes)
    return frame.select(*[output(name, kinds[name]) for name in names or frame.columns])


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(LoanTables.from_star(tune(spark), sf_dir))

    return {name: bound(build) for name, build in QUERIES.items()}


# --- sources and intermediate stages -------------------------------------------------------------


@query
def scan_orig(t: LoanTables) -> DataFrame:
    return finished(t.orig)


@query
def scan_month(t: LoanTables) -> DataFrame:
    return finished(t.month)


@query
def scan_term(t: LoanTables) -> DataFrame:
    return finished(t.term)


@query
def wide_history(t: LoanTables) -> DataFrame:
    return finished(t.wide_history())


@query_named("max_period")
def max_period_rows(t: LoanTables) -> DataFrame:
    return t.latest_period()


UNIVERSE_COLUMNS = (
    "loan_id", "orig_rate", "orig_rate_pctile", "channel", "orig_upb", "orig_upb_pctile",
    "loan_term", "orig_date", "first_flag", "second_home", "mi_flag", "state",
    "high_balance_loan_indicator", "eligible", "vintage", "bal_seg",
)


@query
def universe(t: LoanTables) -> DataFrame:
    spec = ALL.but(segments=PERCENTILES)
    return finished(build_universe(t, spec, ("balance", "rate")), UNIVERSE_COLUMNS)


@query
def upb_pctile(t: LoanTables) -> DataFrame:
    loans = build_universe(t, ALL, ("balance",))
    return finished(loans, ["loan_id", "orig_upb_pctile"])


@query
def rate_pctile(t: LoanTables) -> DataFrame:
    loans = build_universe(t, ALL, ("rate",))
    return finished(loans, ["loan_id", "orig_rate_pctile"])


@query_named("cohort_summary")
def cohort_summary_rows(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("channel", "vintage"))
    return finished(cohort_summary(build_universe(t, spec), spec))



# --- loan attributes -----------------------------------------------------------------------------


def _attributes(t: LoanTables, *names: str, **options: bool) -> DataFrame:
    return finished(with_attributes(t.orig, **options), ["loan_id", *names])


@query
def vintage_term(t: LoanTables) -> DataFrame:
    return _attributes(t, "vintage", "loan_term")


@query
def legacy_term(t: LoanTables) -> DataFrame:
    return _attributes(t, "loan_term", legacy_terms=True)


@query
def flags(t: LoanTables) -> DataFrame:
    return _attributes(t, "second_home", "mi_flag")


@query
def qfico(t: LoanTables) -> DataFrame:
    return _attributes(t, "qfico")


@query
def eligibility(t: LoanTables) -> DataFrame:
    return _attributes(t, "eligible")


@query
def eligibility_legacy(t: LoanTables) -> DataFrame:
    return _attributes(t, "eligible", legacy_eligibility=True)


@query
def inel_reasons(t: LoanTables) -> DataFrame:
    return _attributes(t, "inel_b3", "inel_b5", "inel_b6")


@query
def sublimits(t: LoanTables) -> DataFrame:
    return _attributes(t, "sublimit_a", "sublimit_b")


SEGMENT_COLUMNS = [
    "bal_seg",
    "seg_order",
    "loans",
    "orig_upb",
    "segment_range",
    "segment_pctiles",
    "cohort_loans",
]


def _by_segment(t: LoanTables, chosen: BalanceSegments, order: Sequence[str]) -> DataFrame:
    spec = ALL.but(by=("balance",), segments=chosen)
    report = cohort_report(t, spec).withColumn(
        "seg_order", segments.order_of(c("bal_seg"), order).cast("bigint")
    )
    return finished(report, ["loan_term", *SEGMENT_COLUMNS])


@query
def bal_fixed(t: LoanTables) -> DataFrame:
    return _by_segment(t, CUTOFFS, segments.NAMED_ORDER)


@query
def bal_steps(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("balance",), segments=STEPS)
    summary = cohort_summary(build_universe(t, spec), spec)
    order = [*(f"{s}K" for s in STEPS.steps), segments.CONFORMING, segments.SUPER]
    ranked = summary.withColumn(
        "seg_order", segments.order_of(c("bal_seg"), order).cast("bigint")
    )
    return finished(
        ranked,
        ["loan_term", "g_loan_term", "bal_seg", "g_bal_seg", "seg_order", "loan_cnt", "max_bal"],
    )


@query
def bal_pctile(t: LoanTables) -> DataFrame:
    return finished(build_universe(t, ALL.but(segments=PERCENTILES)), ["loan_id", "bal_seg"])


@query
def monthly_pi(t: LoanTables) -> DataFrame:
    return finished(history.with_payment(t.orig), ["loan_id", "monthly_pi"])


@query
def annual_income(t: LoanTables) -> DataFrame:
    loans = history.with_payment(build_universe(t, ALL)).withColumn(
        "annual_income", amortization.annual_income(c("monthly_pi"), c("dti"))
    )
    return finished(
        aggregate(loans, ["loan_term", "vintage"], [m.payment(), *m.income_averages()], False),
        ["loan_term", "vintage", "wa_pi", "wa_income", "income_range"],
    )


@query
def sched_balance(t: LoanTables) -> DataFrame:
    ages = {"sched_0": F.lit(0), "sched_12": F.lit(12), "sched_24": F.lit(24)}
    ages["sched_at_term"] = c("orig_term")
    return finished(
        t.orig.select(
            "loan_id",
            *[
                F.abs(
                    amortization.scheduled_balance(
                        c("orig_upb"), c("orig_rate"), c("orig_term"), age
                    )
                ).alias(name)
                for name, age in ages.items()
            ],
        )
    )


# --- loan-months ---------------------------------------------------------------------------------


def _months(t: LoanTables, *names: str) -> DataFrame:
    rows = history.loan_months(build_universe(t, ALL), t.month)
    return finished(rows, ["loan_id", "act_period", *names])


@query
def current_balance(t: LoanTables) -> DataFrame:
    return _months(t, "current_bal")


@query
def loan_age(t: LoanTables) -> DataFrame:
    return _months(t, "loan_age")


@query
def dlq_buckets(t: LoanTables) -> DataFrame:
    return _months(t, "dlq_30", "dlq_60", "dlq_90")


@query
def default_upb(t: LoanTables) -> DataFrame:
    return _months(t, "defaulted_upb")


@query
def prepay_fields(t: LoanTables) -> DataFrame:
    return _months(t, "sched_bal", "unsched_prin", "unsched_cnt")


@query
def net_loss(t: LoanTables) -> DataFrame:
    return finished(
        t.term.select(
            "loan_id",
            performance.net_loss().alias("net_loss"),
            performance.monthly_net_loss().alias("mo_net_loss"),
        )
    )


@query
def net_loss_legacy(t: LoanTables) -> DataFrame:
    return finished(t.term.select("loan_id", performance.legacy_net_loss().alias("net_loss")))


# --- filters -------------------------------------------------------------------------------------


def _selected(t: LoanTables, **variants: CohortSpec) -> DataFrame:
    """What each variant of a filter selects, per vintage and term."""
    frames = [
        build_universe(t, spec)
        .groupBy("vintage", "loan_term")
        .agg(
            F.count(F.lit(1)).alias("loans"),
            F.sum("orig_upb").alias("orig_upb"),
            F.sum("loan_id").alias("loan_id_sum"),
        )
        .withColumn("variant", F.lit(name))
        for name, spec in variants.items()
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return finished(result)


@query
def filter_vintage(t: LoanTables) -> DataFrame:
    return _selected(t, single=CohortSpec.vintage(1996), range=CohortSpec(1997, 1999))


@query
def filter_origmo(t: LoanTables) -> DataFrame:
    return _selected(t, months=ALL.but(orig_months=("199601", "199602", "199806")))


@query
def filter_term(t: LoanTables) -> DataFrame:
    return _selected(
        t,
        t180=ALL.but(term=180),
        t240=ALL.but(term=240),
        t360=ALL.but(term=360),
        t480=ALL.but(term=480),
        only30=ALL.but(only_30_year=True),
    )


@query
def filter_balance(t: LoanTables) -> DataFrame:
    return _selected(
        t,
        thousands=ALL.but(min_balance_k=150, max_balance_k=200),
        units=ALL.but(min_balance=150000.0, max_balance=417000.0),
        below=ALL.but(max_balance=250000.0),
    )


@query
def filter_state(t: LoanTables) -> DataFrame:
    return _selected(
        t,
        only=ALL.but(state="NY"),
        without=ALL.but(exclude_state="NY"),
        listed=ALL.but(states=("CA", "UT", "PR")),
    )


@query
def filter_rate(t: LoanTables) -> DataFrame:
    return _selected(t, rate=ALL.but(note_rate="4.125"))


@query
def filter_channel(t: LoanTables) -> DataFrame:
    return _selected(t, **{code: ALL.but(channel=code) for code in ("R", "B", "C")})


@query
def filter_topstates(t: LoanTables) -> DataFrame:
    return _selected(t, **{f"top{n}": ALL.but(top_states=n) for n in (12, 17, 25)})


@query
def filter_seller(t: LoanTables) -> DataFrame:
    return _selected(t, prefix=ALL.but(seller_prefix="BUILD"))


@query
def filter_purpose(t: LoanTables) -> DataFrame:
    return _selected(t, purchase=ALL.but(purpose="P"), cashout=ALL.but(purpose="C"))


@query
def filter_units(t: LoanTables) -> DataFrame:
    return _selected(t, one=ALL.but(units=1), two=ALL.but(units=2))


@query
def filter_ltv(t: LoanTables) -> DataFrame:
    return _selected(t, least=ALL.but(min_ltv=80), most=ALL.but(max_ltv=70))


@query
def filter_custom(t: LoanTables) -> DataFrame:
    wide_couple = (c("num_bo") >= 2) & (c("orig_upb") > c("dti") * 5000)
    return _selected(t, custom=ALL.but(where=wide_couple))


@query
def filter_seller_rank(t: LoanTables) -> DataFrame:
    return _selected(t, ranks=ALL.but(seller_rank=(1, 2)))


@query
def filter_elig(t: LoanTables) -> DataFrame:
    return _selected(t, eligible=ALL.but(eligible_only=True))


@query
def filter_ranges(t: LoanTables) -> DataFrame:
    return _selected(
        t,
        score=ALL.but(scores=(660, 720)),
        ltv=ALL.but(ltvs=(60, 80)),
        cltv=ALL.but(cltvs=(70, 95)),
        dti=ALL.but(dtis=(20, 43)),
    )


@query
def filter_occupancy(t: LoanTables) -> DataFrame:
    return _selected(t, primary=ALL.but(primary_only=True))


@query
def filter_appraisal(t: LoanTables) -> DataFrame:
    return _selected(t, full=ALL.but(full_appraisal_only=True))


@query
def filter_first(t: LoanTables) -> DataFrame:
    return _selected(t, first=ALL.but(first_buyer="Y"), repeat=ALL.but(first_buyer="N"))


@query
def early_payoff(t: LoanTables) -> DataFrame:
    return _selected(t, kept=ALL, all=ALL.but(drop_early_payoffs=False))


@query
def avg_coupon(t: LoanTables) -> DataFrame:
    return _selected(
        t,
        by_term=ALL.but(average_coupon_only=True),
        by_channel=ALL.but(average_coupon_only=True, by=("channel", "vintage", "first")),
    )


@query
def limit_loans(t: LoanTables) -> DataFrame:
    return _selected(t, limited=ALL.but(limit=1000))


@query
def min_count(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("state", "channel"), min_count=100, rollup=True)
    return finished(cohort_report(t, spec), [*_keyed(spec), "loans", "orig_upb"])


# --- groups and subtotals ------------------------------------------------------------------------


def _keyed(spec: CohortSpec) -> list[str]:
    return [*spec.group_keys, *bits(spec.group_keys)]


GROUP_COLUMNS = [
    "loans",
    "orig_upb",
    "als",
    "wa_rate",
    "wa_pi",
    "eligible",
    "vintages",
    "cohort_loans",
    "cohort_upb",
]


def _by(t: LoanTables, dimension: str, **options: object) -> DataFrame:
    spec = ALL.but(by=(dimension,), rollup=True, **options)
    named = [NAME_COLUMNS[dimension]] if dimension in NAME_COLUMNS else []
    return finished(cohort_report(t, spec), [*_keyed(spec), *named, *GROUP_COLUMNS])


@query
def by_vintage(t: LoanTables) -> DataFrame:
    return _by(t, "vintage")


@query
def by_state(t: LoanTables) -> DataFrame:
    return _by(t, "state")


@query
def by_hbal(t: LoanTables) -> DataFrame:
    return _by(t, "hbal")


@query
def by_first(t: LoanTables) -> DataFrame:
    return _by(t, "first")


@query
def by_second_home(t: LoanTables) -> DataFrame:
    return _by(t, "second_home")


@query
def by_mi(t: LoanTables) -> DataFrame:
    return _by(t, "mi")


@query
def by_channel(t: LoanTables) -> DataFrame:
    return _by(t, "channel")


@query
def by_balance(t: LoanTables) -> DataFrame:
    return _by(t, "balance", segments=PERCENTILES)


@query
def by_seller(t: LoanTables) -> DataFrame:
    return _by(t, "seller")


@query
def by_servicer(t: LoanTables) -> DataFrame:
    return _by(t, "servicer")


@query
def seller_rank(t: LoanTables) -> DataFrame:
    sellers = party_ranks(t.orig, ALL, "seller").withColumnRenamed("seller", "party")
    servicers = party_ranks(t.orig, ALL, "servicer").withColumnRenamed("servicer", "party")
    named = sellers.withColumnRenamed("seller_rank", "rank").withColumn("kind", F.lit("seller"))
    return finished(
        named.unionByName(
            servicers.withColumnRenamed("servicer_rank", "rank").withColumn(
                "kind", F.lit("servicer")
            )
        )
    )


@query
def rollup_summary(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage", "channel", "second_home"))
    return finished(cohort_summary(build_universe(t, spec), spec))


@query
def cohort_totals(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("age", "channel", "first"), rollup=True)
    columns = ["loans", "orig_upb", "cohort_loans", "cohort_upb", "cohort_als"]
    return finished(cohort_report(t, spec), [*_keyed(spec), *columns])


@query
def report_rownum(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage", "channel"), rollup=True)
    report = shapes.numbered(cohort_report(t, spec), spec)
    return finished(report, ["row_num", *_keyed(spec), "loans"])


@query
def report_by_rank(t: LoanTables) -> DataFrame:
    """Sellers in the order of their rank as a number, all of them together after them."""
    spec = ALL.but(by=("seller", "channel"), rollup=True)
    report = shapes.numbered(cohort_report(t, spec), spec)
    return finished(report, ["row_num", *_keyed(spec), "loans"])


@query
def report_by_age(t: LoanTables) -> DataFrame:
    """Ages as numbers, inside their channel."""
    spec = ALL.but(by=("age", "channel"))
    report = shapes.numbered(cohort_report(t, spec), spec)
    return finished(report, ["row_num", "loan_term", "channel", "loan_age", "loans"])


@query
def originator_of_prefix(t: LoanTables) -> DataFrame:
    """A run over the sellers of one prefix shows the first of their names."""
    spec = ALL.but(seller_prefix="BUILD", by=("channel",))
    return finished(cohort_report(t, spec), ["loan_term", "channel", "originator", "loans"])


@query
def filter_echo(t: LoanTables) -> DataFrame:
    spec = ALL.but(purpose="P", units=1, max_ltv=90, by=("mi",), rollup=True)
    report = shapes.present(cohort_report(t, spec), spec)
    echo = ["cohort_purpose", "cohort_units", "cohort_max_ltv", "cohort_has_mi"]
    return finished(report, ["cohort_term", "cohort_mi", *echo, "loans", "orig_upb"])


@query
def stored_age_curve(t: LoanTables) -> DataFrame:
    """Age curves and horizon speeds of two vintages over tables stored by vintage."""
    spark = t.orig.sparkSession
    root = new_folder(spark, "loans")
    t.write(root)
    stored = LoanTables.from_parquet(spark, root)
    curve = age_curve(stored, CohortSpec(1996, 1997, by=("vintage",)))
    names = ["loan_term", "vintage", "loan_age", "loans", "orig_upb", "cohort_loans"]
    speeds = horizon_report(stored, CohortSpec(1996, 1997, by=("vintage",)))
    speeds = speeds.withColumn("loan_age", F.lit(None).cast("int"))
    horizon = finished(speeds, [*names, "horizon_act"])
    none = F.lit(None).cast("double")
    return finished(curve.withColumn("horizon_act", none), [*names, "horizon_act"]).unionByName(horizon)


@query
def labels(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage", "state", "channel", "second_home", "first"), rollup=True)
    spec = spec.but(eligible_only=True, min_ltv=60)
    report = shapes.present(cohort_report(t, spec), spec)
    echo = ["cohort_vintages", "cohort_eligible", "cohort_min_ltv"]
    dimensions = ["term", "channel", "vintage", "state", "first", "second_home"]
    return finished(report, [*(f"cohort_{d}" for d in dimensions), *echo, "loans"])


# --- shares and averages -------------------------------------------------------------------------


def _measured(t: LoanTables, measures: list[m.Measure], spec: CohortSpec = ALL) -> DataFrame:
    report = aggregate(build_universe(t, spec), ["loan_term", "vintage"], measures, rollup=True)
    keys = ["loan_term", "vintage"]
    return finished(report, [*keys, *bits(keys), *[x.name for x in measures]])


@query
def share_channel(t: LoanTables) -> DataFrame:
    return _measured(t, m.channel_shares())


@query
def share_balance(t: LoanTables) -> DataFrame:
    return _measured(t, m.balance_shares(segments.NAMED_ORDER), ALL.but(segments=PERCENTILES))


@query
def share_state(t: LoanTables) -> DataFrame:
    return _measured(t, m.state_shares())


@query
def share_char(t: LoanTables) -> DataFrame:
    return _measured(t, m.characteristic_shares())


@query
def wavg_credit(t: LoanTables) -> DataFrame:
    return _measured(t, m.credit_averages())


@query
def share_elig(t: LoanTables) -> DataFrame:
    return _measured(t, [m.ineligible_share(), *m.eligibility_breakdown()])


@query
def share_elig_legacy(t: LoanTables) -> DataFrame:
    spec = ALL.but(legacy_terms=True, legacy_eligibility=True, drop_early_payoffs=False)
    return _measured(t, [m.ineligible_share(), m.interest_only_share()], spec)


@query
def share_sublimit(t: LoanTables) -> DataFrame:
    return _measured(t, m.sublimit_shares())


@query
def strats(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), rollup=True)
    measured = [
        *["loans", "orig_upb", "als", "size_range", "wa_rate", "wa_rate_8ths", "rate_range"],
        *["wa_pi", "eligible", "vintages"],
        *[x.name for x in m.characteristic_shares()],
        *[x.name for x in m.credit_averages()],
        *["inel_pct", "sublimit_a_pct", "sublimit_b_pct"],
        *["default_pct", "loss_pct", "severity"],
    ]
    return finished(strat_report(t, spec), [*_keyed(spec), *measured])


@query
def default_to_date(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), rollup=True)
    measured = ["default_upb", "default_cnt", "default_pct"]
    measured += ["net_loss", "loss_cnt", "loss_pct", "severity"]
    return finished(strat_report(t, spec), [*_keyed(spec), *measured])


@query
def income_report(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), display=("income",))
    return finished(cohort_report(t, spec), ["loan_term", "vintage", "loans", "wa_income", "income_range"])


@query
def horizon_echo(t: LoanTables) -> DataFrame:
    """A horizon report that repeats the months it used, and other edges of the segments."""
    parts = BalanceSegments(percentile=True, edges=(0.2, 0.5, 0.9))
    spec = ALL.but(
        by=("balance",), segments=parts, display=("history",), prepay_horizon=12,
        delinquency_horizon=36,
    )
    report = shapes.present(cohort_report(t, spec), spec)
    shown = ["cohort_term", "cohort_balance", "segment_criteria", "prepay_horizon"]
    return finished(report, [*shown, "delinquency_horizon", "loans"])


@query
def strats_by_age(t: LoanTables) -> DataFrame:
    """To-date credit by loan age: each loan's amounts fall on its terminal month."""
    spec = ALL.but(by=("vintage", "age"))
    report = strat_report(t, spec).withColumn("net_loss", F.coalesce("net_loss", F.lit(0.0)))
    measured = ["loans", "default_upb", "default_cnt", "default_pct"]
    measured += ["net_loss", "loss_cnt", "loss_pct", "severity"]
    return finished(report, [*spec.group_keys, *measured])


@query
def sweep_strat(t: LoanTables) -> DataFrame:
    """Shares of the cohort and ranked parties' names in a sweep."""
    spec = ALL.but(by=("seller",), display=("strat",))
    curves = sweep.exclusive_age_curves(t, spec, sweep.channel_runs())
    shown = ["run_id", "loan_term", "loan_age", "seller_rank", "originator"]
    return finished(curves, [*shown, "loans", "default_upb", "default_pct"])


# --- performance ---------------------------------------------------------------------------------

CURVE_COLUMNS = [
    *["cohort_loans", "cohort_upb", "cohort_als", "cpr", "smm"],
    *["dlq_30_pct", "dlq_60_pct", "dlq_90_pct", "fc_pct"],
    *["cum_default_pct", "cum_loss_pct", "cum_lgd"],
    *["loans", "orig_upb", "current_bal", "sched_bal", "unsched_prin", "unsched_cnt"],
    *["mo_default_upb", "mo_default_cnt", "mo_net_loss", "mo_loss_cnt"],
    *["cum_default_upb", "cum_net_loss", "wa_rate", "wa_rate_8ths", "rate_range", "wa_pi"],
]


def _curve(t: LoanTables, spec: CohortSpec, columns: Sequence[str]) -> DataFrame:
    spec = spec.but(by=(*spec.by, "age"))
    return finished(age_curve(t, spec), [*spec.group_keys, *columns])


@query_named("age_curve")
def age_curve_rows(t: LoanTables) -> DataFrame:
    return _curve(t, ALL, CURVE_COLUMNS)



@query
def age_curve_1996(t: LoanTables) -> DataFrame:
    return _curve(t, CohortSpec.vintage(1996), CURVE_COLUMNS)


@query
def age_curve_by_vintage(t: LoanTables) -> DataFrame:
    return _curve(t, ALL.but(by=("vintage",)), CURVE_COLUMNS)


@query
def dlq_curve(t: LoanTables) -> DataFrame:
    columns = ["dlq_30_pct", "dlq_60_pct", "dlq_90_pct", "fc_pct", "current_bal"]
    return _curve(t, ALL.but(by=("channel",)), columns)


@query
def loss_curve(t: LoanTables) -> DataFrame:
    columns = ["mo_default_upb", "mo_default_cnt", "mo_net_loss", "mo_loss_cnt"]
    return _curve(t, ALL.but(by=("vintage",)), columns)


@query
def cum_default(t: LoanTables) -> DataFrame:
    return _curve(t, ALL.but(by=("vintage",)), ["cum_default_upb", "cum_default_pct"])


@query
def cum_loss(t: LoanTables) -> DataFrame:
    return _curve(t, ALL.but(by=("second_home",)), ["cum_net_loss", "cum_loss_pct"])


@query
def cum_lgd(t: LoanTables) -> DataFrame:
    return _curve(t, ALL.but(by=("seller",)), ["cum_default_upb", "cum_net_loss", "cum_lgd"])


@query
def horizon_cpr(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), rollup=True)
    columns = ["horizon_act", "horizon_sched", "horizon_cpr"]
    literal = horizon_report(t, spec).withColumn("variant", F.lit("started"))
    strict = horizon_report(t, spec.but(seasoned_only=True)).withColumn(
        "variant", F.lit("seasoned")
    )
    return finished(literal.unionByName(strict), ["variant", *_keyed(spec), *columns])


@query
def ever_60(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), rollup=True)
    columns = ["ever_60_horizon_upb", "ever_60_upb", "ever_60_horizon_pct", "ever_60_pct"]
    return finished(horizon_report(t, spec), [*_keyed(spec), *columns])


@query
def ever_120(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("channel",), rollup=True)
    columns = ["ever_120_horizon_upb", "ever_120_horizon_pct"]
    return finished(horizon_report(t, spec), [*_keyed(spec), *columns])


# --- sweeps --------------------------------------------------------------------------------------

SWEEP_COLUMNS = ["cohort_loans", "cohort_upb", "loans", "cpr", "dlq_90_pct", "cum_loss_pct"]


@query
def sweep_channel(t: LoanTables) -> DataFrame:
    _, curves = sweep.channel_sweep(t, ALL.but(term=360, eligible_only=True))
    return finished(curves, ["run_id", "loan_term", "channel", "loan_age", *SWEEP_COLUMNS])


@query
def sweep_loansize(t: LoanTables) -> DataFrame:
    curves = sweep.loan_size_sweep(t, ALL.but(eligible_only=True, units=1), (360, 240))
    return finished(curves, ["run_id", "loan_term", "loan_age", *SWEEP_COLUMNS])


SPEC_SETS = {
    "steps": ALL.but(term=360, eligible_only=True, by=("age", "balance"), segments=STEPS),
    "occupancy": ALL.but(term=360, eligible_only=True, by=("age", "channel", "second_home")),
    "months": CohortSpec.vintage(
        1996,
        term=360,
        orig_months=("199601", "199602", "199603", "199604", "199605", "199606"),
        by=("age", "second_home"),
    ),
    "states": ALL.but(term=180, eligible_only=True, by=("age", "state"), min_count=2),
}


@query
def sweep_specs(t: LoanTables) -> DataFrame:
    keys = ["run_id", "loan_term", "loan_age", "bal_seg", "channel", "second_home", "state"]
    return finished(sweep.spec_sweep(t, SPEC_SETS), [*keys, *SWEEP_COLUMNS])


@query
def batch_index(t: LoanTables) -> DataFrame:
    spec = ALL.but(term=360, eligible_only=True)
    summary, curves = sweep.channel_sweep(t, spec)
    shown = ["loan_term", "eligible", "cohort_loans"]
    whole = summary.withColumn("run_id", F.lit("cohort"))
    index = sweep.batch_index(curves, [c("loan_term").desc(), c("loan_age").asc()], shown)
    first = sweep.batch_index(whole, [c("loan_term").desc()], shown)
    return finished(first.unionByName(index))


# --- presentation --------------------------------------------------------------------------------

HUMAN_COLUMNS = ["loans", "orig_upb", "als", "wa_rate", "cpr", "smm", "dlq_30_pct", "cum_loss_pct"]


@query
def format_human(t: LoanTables) -> DataFrame:
    return shapes.render(_text_keyed_curve(t), human=True)


@query
def format_plain(t: LoanTables) -> DataFrame:
    return shapes.render(_text_keyed_curve(t), human=False)


def _text_keyed_curve(t: LoanTables) -> DataFrame:
    keys = [c("loan_term").cast("string").alias("term"), c("loan_age").cast("string").alias("age")]
    return age_curve(t, ALL).select(*keys, *HUMAN_COLUMNS)


@query
def sample_check(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage",), rollup=True, display=("strat", "geo", "channel", "elig"))
    return finished(shapes.sample_check(cohort_report(t, spec)))


def _occupancy_curve(t: LoanTables) -> tuple[CohortSpec, DataFrame]:
    spec = ALL.but(term=360, eligible_only=True, by=("age", "channel", "second_home"))
    return spec, cohort_report(t, spec)


@query
def chart_frame(t: LoanTables) -> DataFrame:
    return finished(shapes.chart_frame(_occupancy_curve(t)[1]))


@query
def perf_table(t: LoanTables) -> DataFrame:
    spec, curve = _occupancy_curve(t)
    table = shapes.perf_table(curve, spec)
    plain = {
        "Loan Age": "loan_age",
        "Term": "term",
        "Occ": "occ",
        "MAP Elig.": "eligible",
        "Orig. Loan Count": "orig_loan_count",
        "Orig. UPB": "orig_upb_text",
        "Orig. ALS": "orig_als_text",
        "CPR %": "cpr_text",
        "D30 %": "d30_text",
        "D60 %": "d60_text",
        "D90+ %": "d90_text",
        "Rate": "rate_text",
    }
    return finished(table.withColumnsRenamed(plain))


# --- older reports -------------------------------------------------------------------------------


@query
def legacy_report(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("vintage", "channel"), display=("geo", "elig", "vintage"))
    keys = ["loan_term", "vintage", "channel"]
    report = legacy.vintage_report(t, spec)
    labelled = report.withColumns(
        {f"{key}_label": text.total_or(c(key), c(f"g_{key}")) for key in keys}
    ).drop(*keys)
    return finished(labelled)


@query
def legacy_report_b(t: LoanTables) -> DataFrame:
    spec = ALL.but(
        by=("vintage", "hbal"),
        display=("strat", "geo", "channel", "elig", "vintage", "history"),
    )
    return finished(legacy.combined_report(t, spec))


@query
def grand_total(t: LoanTables) -> DataFrame:
    spec = ALL.but(by=("state",), display=("strat",))
    report = legacy.combined_report(t, spec)
    keys = ["loan_term", "state"]
    return finished(report, [*keys, *bits(keys), "loans", "orig_upb", "total_orig_upb"])


@query
def legacy_age_curve(t: LoanTables) -> DataFrame:
    return finished(legacy.combined_age_curve(t, ALL.but(by=("channel",))))
