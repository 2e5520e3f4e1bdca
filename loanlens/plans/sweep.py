"""Several runs at once.

Runs become one more group key, so loans and history are read once for all of them: runs that differ
in one choice of loans (a channel, a balance band), and age curves of any specs. Other reports are
concatenated.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.functions import amortization
from loanlens.functions import measures as m
from loanlens.functions import performance
from loanlens.functions.loan import in_term_bucket
from loanlens.operators.cumulative import with_cumulative_credit
from loanlens.operators.history import loans_and_months, with_payment
from loanlens.operators.ranking import with_party_names
from loanlens.operators.summary import aggregate, bit, cohort_totals, with_cohort_totals
from loanlens.operators.universe import (
    build_universe,
    in_cohort,
    is_of_loan,
    segment_of,
    with_attributes,
    with_terminal,
)
from loanlens.plans.cohort import cohort_report, report_measures, with_cohort_shares
from loanlens.sources.tables import LoanTables
from loanlens.spec import DIMENSION_COLUMNS, DIMENSIONS, CohortSpec

c = F.col

RUN = "run_id"

# Upper ends of the loan-size bands, in thousands; each band starts above the last.
LOAN_SIZES_K = (150, 200, 250, 500, 9999)
CHANNELS = ("R", "B", "C")


def balance_bands(tops_k: Sequence[int] = LOAN_SIZES_K) -> dict[str, Column]:
    """Named predicates of adjoining balance bands, open below and closed above."""
    bands = {}
    for low, high in zip((0, *tops_k), tops_k):
        inside = (c("orig_upb") > low * 1000) & (c("orig_upb") <= high * 1000)
        bands[f"{low:04d}-{high:04d}K"] = inside
    return bands


def channel_runs(channels: Sequence[str] = CHANNELS) -> dict[str, Column]:
    return {f"channel-{code}": c("channel") == code for code in channels}


def _curves(
    tagged: DataFrame,
    keys: Sequence[str],
    measures: Sequence[m.Measure],
    min_counts: Mapping[str, int],
    month: DataFrame,
) -> DataFrame:
    """Age curves of loans tagged with their run, grouped by run, term, age and `keys`."""
    loan_keys = [RUN, "loan_term", *keys]
    group_keys = [RUN, "loan_term", "loan_age", *keys]
    paid = with_payment(tagged)
    if "dti" in paid.columns:
        paid = paid.withColumn("annual_income", amortization.annual_income(c("monthly_pi"), c("dti")))
    rows = loans_and_months(paid, month)
    curve = aggregate(rows, group_keys, [*measures, *cohort_totals()], rollup=False)
    curve = with_cohort_totals(curve, loan_keys).filter(c("loan_age").isNotNull())
    for run, least in min_counts.items():
        curve = curve.filter((c(RUN) != run) | (c("loans") >= least))
    return with_cumulative_credit(curve, group_keys).drop(bit(RUN))


def exclusive_age_curves(
    tables: LoanTables, spec: CohortSpec, runs: Mapping[str, Column]
) -> DataFrame:
    """Age curve of every run from one pass. A loan counts in each run that it is in; loans in no
    run are left out."""
    if spec.rollup:
        raise ValueError("runs have no subtotals across them; use one report per run")
    inside = [F.when(chosen, F.lit(run)) for run, chosen in runs.items()]
    aged = spec.but(by=(*spec.dimensions, "age"))
    loans = build_universe(tables, aged)
    tagged = loans.withColumn(RUN, F.explode(F.array_compact(F.array(*inside))))
    least = {} if spec.min_count is None else {run: spec.min_count for run in runs}
    month = tables.of_vintages("month", spec)
    curves = _curves(tagged, spec.loan_keys[1:], report_measures(aged), least, month)
    return with_cohort_shares(with_party_names(curves, tables.orig, spec), spec)


def channel_sweep(tables: LoanTables, spec: CohortSpec) -> tuple[DataFrame, DataFrame]:
    """Summary of the whole cohort, and one age curve per channel."""
    by = tuple(dict.fromkeys((*spec.dimensions, "channel")))
    curves = exclusive_age_curves(tables, spec.but(by=by), channel_runs())
    return cohort_report(tables, spec), curves


def loan_size_sweep(
    tables: LoanTables, spec: CohortSpec, terms: Sequence[int] = (360,)
) -> DataFrame:
    """One age curve per loan-size band and term."""
    chosen = spec.but(where=_both(spec.where, _term_in(terms)))
    return exclusive_age_curves(tables, chosen, balance_bands())


def _term_in(terms: Sequence[int]) -> Column:
    return reduce(lambda a, b: a | b, [in_term_bucket(term) for term in terms])


def _both(first: Column | None, second: Column) -> Column:
    return second if first is None else first & second


# Loan columns the plain age measures read, and those that a run decides.
CURVE_INPUTS = (
    "loan_id",
    "vintage",
    "eligible",
    "orig_rate",
    "orig_upb",
    "orig_term",
    "first_pay",
    "term_period",
    "zero_bal_code",
    "last_upb",
    "disposition_date",
    *performance.COSTS,
    *performance.PROCEEDS,
)


def _plain_curve(spec: CohortSpec) -> bool:
    named = {"seller", "servicer"} & set(spec.by)  # their names depend on the run's vintages
    return spec.by_age and not spec.rollup and not spec.display and not named


def _run(run: str, spec: CohortSpec, keys: Sequence[str]) -> Column:
    """What a run says of a loan: its name, the term, and its group keys; other runs' keys are NULL."""
    own = set(spec.loan_keys)
    columns = {"bal_seg": segment_of(spec)}

    def key(name: str) -> Column:
        value = columns.get(name, c(name)) if name in own else F.lit(None)
        return value.cast("string").alias(f"key_{name}")

    return F.struct(F.lit(run).alias(RUN), c("loan_term"), *[key(name) for name in keys])


def envelope(specs: Iterable[CohortSpec]) -> CohortSpec:
    """The vintages that some of the specs ask for, and all between."""
    first = [s.first_vintage for s in specs]
    last = [s.last_vintage for s in specs]
    return CohortSpec(
        None if None in first else min(first), None if None in last else max(last)
    )


def _tagged_once(
    tables: LoanTables, specs: Mapping[str, CohortSpec], keys: Sequence[str]
) -> DataFrame:
    """The loans of all runs from one scan, once for each run that they are in."""
    loans = with_attributes(with_terminal(tables, envelope(list(specs.values())), specs.values()))
    chosen = [F.when(in_cohort(s), _run(run, s, keys)) for run, s in specs.items()]
    runs = F.explode(F.array_compact(F.array(*chosen))).alias("_run")
    return loans.select(*CURVE_INPUTS, runs).select("_run.*", *CURVE_INPUTS)


def _tagged(tables: LoanTables, run: str, spec: CohortSpec, keys: Sequence[str]) -> DataFrame:
    """The loans of a run whose choice needs more than the loan itself."""
    runs = _run(run, spec, keys).alias("_run")
    return build_universe(tables, spec).select(*CURVE_INPUTS, runs).select("_run.*", *CURVE_INPUTS)


def plain_age_curves(tables: LoanTables, specs: Mapping[str, CohortSpec]) -> DataFrame:
    """Age curves of several specs from one pass over loans and history; keys come out as text.

    Runs that choose loans by what the loan itself says are told apart while the loans are scanned
    once. Runs with a percentile, a ranking, a limit or an average coupon are loans of their own
    universe. The history is read for the vintages that any run asks for, shuffled and joined once.
    """
    columns = [DIMENSION_COLUMNS[d] for d in DIMENSIONS if any(d in s.by for s in specs.values())]
    once = {run: spec for run, spec in specs.items() if is_of_loan(spec)}
    loans = [_tagged_once(tables, once, columns)] if once else []
    loans += [
        _tagged(tables, run, spec, columns) for run, spec in specs.items() if run not in once
    ]
    tagged = reduce(lambda a, b: a.unionByName(b), loans)
    least = {run: s.min_count for run, s in specs.items() if s.min_count is not None}
    measures = report_measures(next(iter(specs.values())).but(by=("age",), segments=None))
    keys = [f"key_{name}" for name in columns]
    month = tables.of_vintages("month", envelope(list(specs.values())))
    curves = _curves(tagged, keys, measures, least, month)
    return curves.withColumnsRenamed(
        {
            **{f"key_{name}": name for name in columns},
            **{bit(f"key_{name}"): bit(name) for name in columns},
        }
    )


def spec_sweep(tables: LoanTables, specs: Mapping[str, CohortSpec]) -> DataFrame:
    """Reports of several specs below each other, told apart by `run_id`.

    Plain age curves share one pass; every other spec is a report of its own.
    """
    plain = {run: spec for run, spec in specs.items() if _plain_curve(spec)}
    reports = [plain_age_curves(tables, plain)] if plain else []
    reports += [
        _text_keys(cohort_report(tables, spec), spec).withColumn(RUN, F.lit(run))
        for run, spec in specs.items()
        if run not in plain
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def _text_keys(report: DataFrame, spec: CohortSpec) -> DataFrame:
    return report.withColumns({key: c(key).cast("string") for key in spec.loan_keys[1:]})


def batch_index(
    report: DataFrame, order: Sequence[Column], shown: Sequence[str], run: str = RUN
) -> DataFrame:
    """First row of every run: a few leading columns and the run's name."""
    position = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return (
        report.withColumn("_position", position)
        .filter(c("_position") == 1)
        .select(*shown, run)
    )
