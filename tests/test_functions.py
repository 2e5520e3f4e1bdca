"""Column functions against closed-form answers and NULL rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loanlens.functions import amortization, loan, performance, periods, segments, text
from loanlens.operators.history import loan_months, with_payment
from loanlens.operators.universe import with_attributes

c = F.col


def one(frame, column):
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("age", "balance"),
    [(0, 100000.00), (1, 99900.45), (24, 97468.24), (48, 94614.53), (359, 596.57), (360, 0.0)],
)
def test_scheduled_balance(micro, age, balance):
    due = amortization.scheduled_balance(
        c("orig_upb"), c("orig_rate"), c("orig_term"), F.lit(age)
    )
    assert one(micro([{}]).orig, due) == pytest.approx(balance, abs=0.005)


def test_zero_rate_has_no_schedule(micro):
    orig = micro([{"orig_rate": "0.000"}]).orig
    due = amortization.scheduled_balance(c("orig_upb"), c("orig_rate"), c("orig_term"), F.lit(5))
    assert one(orig, due) is None
    assert one(with_payment(orig), c("monthly_pi")) is None


def test_payment_and_income(micro):
    orig = with_payment(micro([{}, {"loan_id": 2, "dti": None}]).orig)
    income = amortization.annual_income(c("monthly_pi"), c("dti"))
    rows = orig.orderBy("loan_id").select("monthly_pi", income.alias("income")).collect()
    assert float(rows[0]["monthly_pi"]) == 599.55
    assert float(rows[0]["income"]) == 19985.00
    assert rows[1]["income"] is None


def test_speeds(spark):
    frame = spark.range(1)
    assert one(frame, performance.cpr_from_smm(F.lit(0.01))) == pytest.approx(0.113615, abs=1e-6)
    cpr = performance.horizon_cpr(F.lit(90000.0), F.lit(97468.24), 24)
    assert one(frame, cpr) == pytest.approx(0.039075, abs=1e-6)


def test_qualifying_score_null_rules(micro):
    rows = [
        {"loan_id": 1, "cscore_b": 700, "cscore_c": None},
        {"loan_id": 2, "cscore_b": 700, "cscore_c": 650},
        {"loan_id": 3, "cscore_b": None, "cscore_c": 700},
    ]
    found = with_attributes(micro(rows).orig).orderBy("loan_id").collect()
    assert [row["qfico"] for row in found] == [700, 650, None]
    assert [row["eligible"] for row in found] == ["Y", "Y", "N"]


@pytest.mark.parametrize(
    ("change", "eligible"),
    [
        ({}, "Y"),
        ({"occ_stat": "I"}, "N"),
        ({"occ_stat": None}, "N"),
        ({"dti": 46}, "N"),
        ({"dti": None}, "N"),
        ({"prop": "MH"}, "N"),
        ({"state": "PR"}, "N"),
        ({"property_inspection_waiver_indicator": None}, "Y"),
        ({"property_inspection_waiver_indicator": "W"}, "N"),
        ({"oltv": 66, "ocltv": None, "cscore_b": 659}, "N"),
        ({"oltv": 66, "ocltv": None, "cscore_b": 660}, "Y"),
        ({"prop": "CO", "oltv": 80, "ocltv": None, "cscore_b": 699}, "N"),
        ({"prop": "CO", "oltv": 80, "ocltv": None, "cscore_b": 700}, "Y"),
        ({"purpose": "C", "oltv": 80, "ocltv": 80, "orig_term": 180, "cscore_b": 700}, "Y"),
        ({"oltv": 80, "ocltv": 92, "cscore_b": 719}, "N"),
        ({"oltv": 80, "ocltv": 92, "cscore_b": 720, "dti": 44}, "N"),
        ({"oltv": 80, "ocltv": 92, "cscore_b": 720, "dti": 43}, "Y"),
    ],
)
def test_eligibility(micro, change, eligible):
    assert with_attributes(micro([change]).orig).first()["eligible"] == eligible


def test_legacy_eligibility_bars_interest_only(micro):
    orig = micro([{"io": "Y"}]).orig
    assert with_attributes(orig).first()["eligible"] == "Y"
    assert with_attributes(orig, legacy_eligibility=True).first()["eligible"] == "N"


@pytest.mark.parametrize(
    ("term", "bucket", "old"),
    [(120, 180, 180), (180, 180, 180), (181, 240, 240), (241, 360, 360), (361, 480, 360)],
)
def test_term_buckets(micro, term, bucket, old):
    orig = micro([{"orig_term": term}]).orig
    assert one(orig, loan.term_bucket()) == bucket
    assert one(orig, loan.term_bucket(legacy=True)) == old


def test_segments(micro):
    rows = [
        {"loan_id": 1, "orig_upb": 85000},
        {"loan_id": 2, "orig_upb": 85000.01},
        {"loan_id": 3, "orig_upb": 600000},
        {"loan_id": 4, "orig_upb": 600000, "high_balance_loan_indicator": "Y"},
    ]
    frame = micro(rows).orig.orderBy("loan_id")
    steps = frame.select(segments.by_steps(("085", "110")).alias("s")).collect()
    assert [r["s"] for r in steps] == ["085K", "110K", "CONF", "SUPER"]
    cuts = frame.select(segments.by_cutoffs(100, 300, 85).alias("s")).collect()
    assert [r["s"] for r in cuts] == ["VLOW", "LOW", "HIGH", "SUPER"]
    without_low = frame.select(segments.by_cutoffs(100, 300).alias("s")).collect()
    assert [r["s"] for r in without_low] == ["VLOW", "VLOW", "HIGH", "SUPER"]


def test_month_arithmetic(spark):
    frame = spark.createDataFrame([("202201",), ("202212",)], "p string")
    shifted = frame.select(
        periods.add_months(c("p"), -23).alias("back"), periods.add_months(c("p"), 1).alias("on")
    ).collect()
    assert [tuple(r) for r in shifted] == [("202002", "202202"), ("202101", "202301")]


TERMINAL = {
    "loan_id": 1,
    "act_period": "202403",
    "zb_dte": "202403",
    "zero_bal_code": "09",
    "last_upb": 90000,
    "disposition_date": "202403",
    **{name: 0 for name in (*performance.COSTS, *performance.PROCEEDS)},
}


def test_net_loss_null_and_sign(micro):
    rows = [
        {**TERMINAL, "net_sales_proceeds": 80000},
        {**TERMINAL, "loan_id": 2, "net_sales_proceeds": 95000},
        {**TERMINAL, "loan_id": 3, "asset_recovery_costs": None},
        {**TERMINAL, "loan_id": 4, "zero_bal_code": "01"},
        {**TERMINAL, "loan_id": 5, "zero_bal_code": "XX"},
    ]
    term = micro([{}], term=rows).term.orderBy("loan_id")
    found = term.select(
        performance.net_loss().cast("double").alias("loss"),
        performance.legacy_net_loss().cast("double").alias("old"),
        performance.monthly_net_loss().cast("double").alias("month"),
    ).collect()
    assert [r["loss"] for r in found] == [10000.0, 0.0, None, 90000.0, 90000.0]
    assert [r["old"] for r in found] == [-10000.0, 0.0, None, -90000.0, -90000.0]
    assert [r["month"] for r in found] == [10000.0, 0.0, None, None, None]


def test_every_cost_and_proceeds_counts_with_its_sign(micro):
    costs = {name: 2 ** (k + 1) for k, name in enumerate(performance.COSTS)}
    proceeds = {name: 2 ** (k + 7) for k, name in enumerate(performance.PROCEEDS)}
    term = micro([{}], term=[{**TERMINAL, **costs, **proceeds}]).term
    [row] = term.select(performance.net_loss().cast("double").alias("loss")).collect()
    assert row["loss"] == 90000 + sum(costs.values()) - sum(proceeds.values())


def test_term_buckets_as_ranges_equal_the_bucket(spark):
    frame = spark.createDataFrame([(n,) for n in [*range(0, 600, 20), None]], "orig_term int")
    for legacy in (False, True):
        for label in (180, 240, 360, 480, 100):
            bucket = F.coalesce(loan.term_bucket(legacy) == label, F.lit(False))
            same = F.coalesce(loan.in_term_bucket(label, legacy), F.lit(False)) == bucket
            assert frame.filter(~same).isEmpty()


def test_loan_months(micro):
    months = [
        {"act_period": "202207", "loan_age": 1, "current_upb": 0, "dlq_status": "01"},
        {"act_period": "202301", "loan_age": 7, "current_upb": 98000, "dlq_status": "XX"},
        {"act_period": "202403", "loan_age": None, "current_upb": 0, "dlq_status": "02"},
        {"act_period": "202205", "loan_age": -1, "current_upb": 0, "dlq_status": "00"},
    ]
    tables = micro([{}], [{"loan_id": 1, **m} for m in months], [TERMINAL])
    loans = tables.orig.join(tables.term.withColumnRenamed("act_period", "term_period"), "loan_id")
    rows = loan_months(loans, tables.month).orderBy("act_period").collect()
    assert [r["loan_age"] for r in rows] == [1, 7, 21]
    assert [float(r["current_bal"]) for r in rows] == [99900.45, 98000.0, 0.0]
    assert [float(r["sched_bal"]) for r in rows] == [99900.45, 98000.0, 90000.0]
    assert [float(r["dlq_30"]) for r in rows] == [99900.45, 0.0, 0.0]
    assert [float(r["dlq_60"]) for r in rows] == [0.0, 0.0, 0.0]
    assert [float(r["dlq_90"]) for r in rows] == [0.0, 98000.0, 0.0]
    assert [r["defaulted_upb"] and float(r["defaulted_upb"]) for r in rows] == [None, None, 90000]


def test_number_text(spark):
    frame = spark.range(1)
    assert one(frame, text.number(F.lit(2.5), 0, human=True)) == "3"
    assert one(frame, text.number(F.lit(1234567.5), 1, human=True)) == "1,234,567.5"
    assert one(frame, text.percent(F.lit(0.123456), 2, human=True)) == "12.35%"
    assert one(frame, text.percent(F.lit(0.123456789), 2)) == pytest.approx(0.123457)
    assert one(frame, text.thousands_range(F.lit(85000), F.lit(417000))) == "85k-417k"
