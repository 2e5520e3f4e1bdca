"""Physical plans: what is pushed down, shuffled, broadcast and split."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.catalog import registered
from loanlens.operators.positions import with_row_numbers
from loanlens.operators.ranking import party_ranks
from loanlens.operators.universe import build_universe, first_loans
from loanlens.plans.cohort import age_curve, cohort_report, horizon_report
from loanlens.plans.legacy import combined_report
from loanlens.plans.shapes import numbered
from loanlens.plans.sweep import spec_sweep
from loanlens.session import tune
from loanlens.sources.tables import LoanTables
from loanlens.spec import BalanceSegments, CohortSpec
from tests.conftest import SMALL

c = F.col
ALL = CohortSpec(1995, 2001)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def plan_of(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__enabled="false",
        spark__sql__maxMetadataStringLength="10000",
    ):
        yield


def scans(plan: str, column: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and column in line]


def test_history_is_scanned_and_shuffled_once(spark, stored, large):
    plan = plan_of(age_curve(stored, ALL.but(by=("vintage",))))
    assert len(scans(plan, "dlq_status")) == 1
    by_loan = re.findall(r"Exchange hashpartitioning\(loan_id#\d+L, \d+\)", plan)
    # History, plus originations and terminal records for the rows and for the totals.
    assert len(by_loan) <= 5
    assert "SortAggregate(key=[loan" not in plan


def test_filters_and_columns_reach_the_scans(spark, stored, large):
    plan = plan_of(age_curve(stored, CohortSpec.vintage(1996, state="NY")))
    for scan in scans(plan, "orig_upb"):
        assert "GreaterThanOrEqual(orig_date,1996)" in scan
        assert "EqualTo(state,NY)" in scan
        assert "seller" not in scan
    horizon = plan_of(horizon_report(stored, ALL))
    assert any("EqualTo(loan_age,24)" in scan for scan in scans(horizon, "dlq_status"))


def test_horizon_flags_take_one_pass(spark, stored, large):
    plan = plan_of(horizon_report(stored, ALL.but(by=("vintage",), rollup=True)))
    assert len(scans(plan, "dlq_status")) == 1
    assert "SortAggregate(key=[loan" not in plan


def test_percentile_segments_join_only_their_cutoffs(spark, stored, large):
    spec = ALL.but(by=("balance", "age"), segments=BalanceSegments(percentile=True))
    plan = plan_of(cohort_report(stored, spec))
    assert "BroadcastHashJoin" not in plan  # nothing is hinted: AQE measures the cutoffs
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # No window partitioned by the whole (indicator, vintage) group runs over loans.
    assert not any("percent_rank" in line for line in windows)


def test_history_of_one_vintage_reads_its_folder_alone(spark, stored, large):
    plan = plan_of(age_curve(stored, CohortSpec.vintage(1996)))
    [month] = scans(plan, "dlq_status")
    assert re.search(r"PartitionFilters: \[[^]]*vintage#\d+ >= 1996", month)
    for scan in scans(plan, "zero_bal_code"):
        assert "vintage" in scan.split("PartitionFilters: ")[1].split("]")[0]


def test_reports_without_age_scan_loans_once(spark, stored, large):
    for spec in (ALL.but(display=("strat",)), ALL.but(by=("vintage",))):
        plan = plan_of(cohort_report(stored, spec))
        assert len(scans(plan, "orig_upb")) == 1 and len(scans(plan, "zero_bal_code")) <= 1


def test_balance_and_term_filters_are_pushed(spark, stored, large):
    spec = ALL.but(term=360, min_balance=424.1, max_balance_k=417)
    [scan] = scans(plan_of(cohort_report(stored, spec)), "orig_upb")
    pushed = scan.split("PushedFilters: ")[1]
    for part in ("GreaterThan(orig_upb,424.10)", "LessThanOrEqual(orig_upb,417000.00)"):
        assert part in pushed
    assert "GreaterThan(orig_term,240)" in pushed and "LessThanOrEqual(orig_term,360)" in pushed


def test_a_heavy_order_is_split(spark, tmp_path):
    """One order with most of the lines: AQE splits its join partition, history stays whole."""
    for name in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    heavy = lines.filter(c("l_orderkey") == 1).crossJoin(spark.range(20000)).drop("id")
    shifted = heavy.withColumn("l_quantity", F.rand(7) * 49)
    lines.unionByName(shifted).repartition(16).write.parquet(f"{tmp_path}/lineitem.parquet")
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        month = LoanTables.from_star(spark, str(tmp_path)).month
        found = {(r["loan_id"], r["act_period"]) for r in month.collect()}
        assert "skew=true" in plan_of(month)
    plain = LoanTables.from_star(spark, SMALL).month
    assert found == {(r["loan_id"], r["act_period"]) for r in plain.collect()}


@pytest.mark.parametrize(
    "name", ["universe", "by_seller", "avg_coupon", "legacy_report_b", "sweep_specs", "batch_index"]
)
def test_no_cross_joins_or_python(spark, name):
    plan = plan_of(registered()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_a_sweep_scans_each_table_once(spark, stored, large):
    """Specs of several vintages: one scan of loans, terminal records and history, and of the
    history only the vintages that some spec asks for."""
    specs = {
        "steps": ALL.but(first_vintage=1996, last_vintage=1997, by=("age", "channel")),
        "late": CohortSpec.vintage(1999, term=360, eligible_only=True, by=("age", "state")),
        "bands": CohortSpec.vintage(
            1998, by=("age", "balance"), segments=BalanceSegments(low_k=150, medium_k=300)
        ),
    }
    plan = plan_of(spec_sweep(stored, specs))
    [month] = scans(plan, "dlq_status")
    assert len(scans(plan, "orig_upb")) == 1 and len(scans(plan, "zero_bal_code")) == 1
    filters = month.split("PartitionFilters: ")[1].split("]")[0]
    assert ">= 1996" in filters and "<= 1999" in filters
    assert "GreaterThanOrEqual(orig_date,1996)" in scans(plan, "orig_upb")[0]


def test_a_curve_scans_loans_once(spark, stored, large):
    """Cohort totals come from the join that the months come from."""
    for spec in (ALL, ALL.but(by=("vintage", "channel"), rollup=True, min_count=2)):
        plan = plan_of(age_curve(stored, spec))
        assert len(scans(plan, "orig_upb")) == 1 and len(scans(plan, "zero_bal_code")) == 1
        assert len(scans(plan, "dlq_status")) == 1


def single_partition(plan: str) -> list[str]:
    """What feeds each exchange to one partition."""
    lines = plan.splitlines()
    return [
        lines[k + 1] for k, line in enumerate(lines) if "Exchange SinglePartition" in line
    ]


def test_positions_see_no_task_with_all_rows(spark, stored, large):
    """Row numbers, ranks and the grand total: only partial aggregates go to one partition."""
    ranks = party_ranks(stored.orig, ALL, "seller")
    spec = ALL.but(by=("vintage", "channel"), rollup=True)
    report = numbered(cohort_report(stored, spec), spec)
    combined = combined_report(stored, ALL.but(by=("seller",), display=("strat",)))
    for frame in (ranks, report, combined):
        assert all("Aggregate" in line for line in single_partition(plan_of(frame)))
    assert party_ranks(stored.orig, ALL, "seller") is ranks


def test_row_numbers_of_many_ranges(spark):
    rows = spark.range(5000).select((c("id") * 7919 % 5000).alias("x"), (c("id") % 3).alias("k"))
    order = [c("k").desc(), c("x").asc_nulls_last()]
    with settings(spark, spark__sql__adaptive__enabled="false"):
        found = with_row_numbers(rows.repartition(6), order, "n")
    window = Window.orderBy(*order)
    expected = rows.withColumn("n", F.row_number().over(window))
    assert found.exceptAll(expected).isEmpty() and found.count() == 5000
    nothing = with_row_numbers(rows.where("x < 0"), order, "n")
    assert nothing.collect() == []


@pytest.mark.parametrize("n", [1, 7, 1000, 10**6])
def test_limit_is_a_bound_on_the_id(spark, stored, large, n):
    chosen = build_universe(stored, CohortSpec(limit=n))
    plan = plan_of(chosen)
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    first = build_universe(stored, CohortSpec()).select("loan_id").orderBy("loan_id").limit(n)
    assert chosen.select("loan_id").exceptAll(first).isEmpty()
    assert chosen.count() == first.count()


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5, 6], list(range(50)) + [2**62]])
def test_limit_on_spread_ids(spark, ids):
    loans = spark.createDataFrame([(i,) for i in ids], "loan_id long")
    for n in (1, 3, 4, len(ids), len(ids) + 3):
        found = sorted(r["loan_id"] for r in first_loans(loans, n).collect())
        assert found == sorted(ids)[:n]
    assert first_loans(loans.where("false"), 3).count() == 0


def test_terminal_records_join_one_line_an_order(spark, large):
    """Lines are aggregated before their shuffle, and one sort serves equal orders and the next join."""
    plan = plan_of(LoanTables.from_star(spark, SMALL).term)
    joined, _, below = plan.partition("SortMergeJoin")
    assert "Aggregate" not in joined
    lines = below[: below.index("lineitem.parquet")]
    assert len(re.findall(r"HashAggregate\(keys=\[l_orderkey", lines)) == 2
    assert lines.index("Exchange") < lines.rindex("HashAggregate")
    assert len(re.findall(r"Sort \[(?:loan_id|l_orderkey)#", plan)) == 3


def test_merged_partitions_stay_small(spark):
    """A task of a derived history sorts several tables: it gets 16 MB of exchanged rows, not 64."""
    tables = LoanTables.from_star(tune(spark), SMALL)
    tables.orig.limit(1).count()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("16m", "16777216b")


def test_repeated_orders_and_lines_of_a_derived_history(spark, tmp_path):
    """Equal orders are one loan, orders of one key that differ are loans of their own; a loan's last
    month is that of all its rows."""
    day = datetime.datetime
    orders = [
        (9, 1, "O", 1000.0, day(1996, 1, 10), "1-URGENT"),
        (9, 1, "O", 1000.0, day(1996, 1, 20), "1-URGENT"),
        (9, 1, "O", 2000.0, day(1996, 3, 1), "1-URGENT"),
        (13, 1, "O", 3000.0, day(1996, 1, 10), "1-URGENT"),
        (None, 1, "O", 4000.0, day(1996, 1, 10), "1-URGENT"),
    ]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    names += ", o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [
        (9, 1, 10.0, day(1996, 1, 5)),
        (9, 5, 10.0, day(1996, 1, 15)),
        (9, 6, 10.0, day(1996, 1, 25)),
        (9, 1, 50.0, day(1996, 4, 2)),
        (9, 1, 50.0, day(1996, 4, 2)),
        (13, 7, 10.0, day(1996, 2, 2)),
        (13, 1, 10.0, None),
        (None, 1, 10.0, day(1996, 2, 2)),
    ]
    names = "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = LoanTables.from_star(spark, str(tmp_path))
    months = tables.month.select("loan_id", "act_period", "loan_age", "dlq_status").collect()
    assert sorted(map(tuple, months), key=str) == sorted(
        [
            (9, "199601", -1, "02"),
            (9, "199604", None, "XX"),
            (9, "199604", None, "XX"),
            (13, "199602", 0, "03"),
        ],
        key=str,
    )
    term = tables.term.select("loan_id", "act_period", "zero_bal_code", "last_upb").collect()
    assert sorted((r[0], r[1], r[2]) for r in term) == [(9, "199604", "03"), (9, "199604", "03")]
