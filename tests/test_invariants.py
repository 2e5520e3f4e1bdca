"""Properties every report must have, on the small derived tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loanlens.operators.universe import build_universe
from loanlens.plans import shapes, sweep
from loanlens.plans.cohort import age_curve, cohort_report, horizon_report, strat_report
from loanlens.plans.legacy import combined_age_curve, combined_report, vintage_report
from loanlens.spec import BalanceSegments, CohortSpec

c = F.col
ALL = CohortSpec(1995, 2001)


def test_leaf_groups_add_up_to_every_subtotal(stored):
    spec = ALL.but(by=("channel", "vintage"), rollup=True)
    rows = cohort_report(stored, spec).collect()
    leaves = [r for r in rows if r["g_vintage"] == 0]
    for total in (r for r in rows if r["g_vintage"] == 1):
        inside = [
            r
            for r in leaves
            if (total["g_loan_term"] or r["loan_term"] == total["loan_term"])
            and (total["g_channel"] or r["channel"] == total["channel"])
        ]
        assert sum(r["loans"] for r in inside) == total["loans"] == total["cohort_loans"]
        assert sum(r["orig_upb"] for r in inside) == pytest.approx(total["orig_upb"])


def test_shares(stored):
    spec = ALL.but(
        by=("vintage",),
        rollup=True,
        display=("strat", "channel", "geo", "elig", "balance"),
        segments=BalanceSegments(percentile=True),
    )
    for row in cohort_report(stored, spec).collect():
        shares = {k: v for k, v in row.asDict().items() if k.endswith("_pct")}
        assert all(v is None or 0 <= v <= 1.000001 for k, v in shares.items() if k != "loss_pct")
        channels = [row[k] or 0 for k in ("broker_pct", "correspondent_pct", "retail_pct")]
        assert sum(channels) == pytest.approx(1)
        segments = [v or 0 for k, v in shares.items() if k.startswith("bal_")]
        assert sum(segments) == pytest.approx(1)


def test_null_key_and_subtotal_stay_apart(micro):
    rows = [
        {"loan_id": 1, "first_flag": None},
        {"loan_id": 2, "first_flag": "Y"},
        {"loan_id": 3, "first_flag": None},
    ]
    spec = CohortSpec.vintage(2022, by=("first",), rollup=True)
    found = cohort_report(micro(rows), spec).filter(c("g_loan_term") == 0).collect()
    cells = {(r["first_flag"], r["g_first_flag"]): (r["loans"], r["cohort_loans"]) for r in found}
    assert cells == {(None, 0): (2, 2), ("Y", 0): (1, 1), (None, 1): (3, 3)}


def test_curves(stored):
    spec = ALL.but(by=("age", "channel"))
    rows = age_curve(stored, spec).orderBy("loan_term", "channel", "loan_age").collect()
    last: dict[tuple, tuple] = {}
    for row in rows:
        if row["smm"] is not None:
            assert row["cpr"] == pytest.approx(1 - (1 - row["smm"]) ** 12)
        key = (row["loan_term"], row["channel"])
        now = (row["cum_default_upb"], row["cum_net_loss"])
        before = last.get(key, (0.0, 0.0))
        assert now[0] >= before[0] and now[1] >= before[1]
        last[key] = now
    totals = strat_report(stored, ALL.but(by=("channel",)))
    defaults = {
        (r["loan_term"], r["channel"]): r["default_upb"] for r in totals.collect()
    }
    for key, (defaulted, _) in last.items():
        assert defaulted == pytest.approx(defaults[key])


def test_rollup_of_a_curve_keeps_ages(stored):
    spec = ALL.but(by=("age", "channel"), rollup=True)
    rolled = cohort_report(stored, spec)
    whole = rolled.filter(c("g_channel") == 1).select("loan_term", "loan_age", "loans", "cpr")
    plain = age_curve(stored, ALL).select("loan_term", "loan_age", "loans", "cpr")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, plain.collect()))


def test_size_sweep_equals_single_runs(stored):
    names = ["loan_term", "loan_age", "loans", "orig_upb", "cohort_loans", "cum_net_loss"]
    swept = sweep.loan_size_sweep(stored, ALL, (360,))
    low = 0
    for high in sweep.LOAN_SIZES_K:
        run = f"{low:04d}-{high:04d}K"
        single = age_curve(stored, ALL.but(term=360, min_balance_k=low, max_balance_k=high))
        mine = swept.filter(c("run_id") == run).select(*names)
        assert sorted(map(tuple, mine.collect())) == sorted(
            map(tuple, single.select(*names).collect())
        )
        low = high


def test_spec_sweep_equals_single_runs(spark, stored):
    specs = {
        "occupancy": ALL.but(by=("age", "channel", "second_home"), eligible_only=True),
        "state": ALL.but(by=("age", "state"), term=360, min_count=3),
        "subtotals": ALL.but(by=("age", "vintage"), rollup=True),
        "strat": ALL.but(by=("vintage",), display=("strat",)),
    }
    swept = sweep.spec_sweep(stored, specs).collect()
    for run, spec in specs.items():
        names = [*spec.group_keys, "loans", "cohort_loans", "orig_upb"]
        names += ["cpr", "cum_net_loss"] if spec.by_age else ["net_loss"]
        single = cohort_report(stored, spec).select(*names).collect()
        mine = [tuple(row[n] for n in names) for row in swept if row["run_id"] == run]
        assert len(mine) == len(single) > 0
        assert sorted(map(str, mine)) == sorted(str(tuple(row)) for row in single)


def test_persisted_universe_gives_the_same_report(stored):
    spec = ALL.but(by=("age", "vintage"))
    names = ["loan_term", "vintage", "loan_age", "loans", "cum_default_upb"]
    shared = build_universe(stored, spec).persist()
    try:
        mine = cohort_report(stored, spec, universe=shared).select(*names)
        other = cohort_report(stored, spec).select(*names)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, other.collect()))
    finally:
        shared.unpersist()


def test_loan_without_history_is_counted_in_totals_only(micro):
    tables = micro(
        [{"loan_id": 1}, {"loan_id": 2}],
        [{"loan_id": 1, "act_period": "202208", "loan_age": 2, "current_upb": 5}],
    )
    row = age_curve(tables, CohortSpec.vintage(2022)).first()
    assert (row["loans"], row["cohort_loans"]) == (1, 2)


def test_early_payoff_boundary(micro):
    ends = {1: "202207", 2: "202208"}
    tables = micro(
        [{"loan_id": i} for i in (1, 2, 3)],
        term=[
            {"loan_id": i, "act_period": p, "zb_dte": p, "zero_bal_code": "01"}
            for i, p in ends.items()
        ],
    )
    kept = build_universe(tables, CohortSpec.vintage(2022)).select("loan_id").collect()
    assert sorted(r["loan_id"] for r in kept) == [2, 3]


def test_balance_band_is_open_below_and_closed_above(micro):
    tables = micro([{"orig_upb": 150000}])
    inside = build_universe(tables, CohortSpec.vintage(2022, min_balance_k=0, max_balance_k=150))
    above = build_universe(tables, CohortSpec.vintage(2022, min_balance_k=150, max_balance_k=200))
    assert inside.count() == 1 and above.count() == 0


def test_seasoned_only_needs_the_whole_horizon(micro):
    months = [{"loan_id": 1, "act_period": "202405", "loan_age": 23, "current_upb": 1}]
    spec = CohortSpec.vintage(2022)
    tables = micro([{}], months)
    assert horizon_report(tables, spec).first()["horizon_sched"] == 97468.24
    strict = horizon_report(tables, spec.but(seasoned_only=True)).first()
    assert strict["horizon_sched"] is None and strict["horizon_cpr"] is None


def test_average_coupon_keeps_loans_without_a_coupon(micro):
    rows = [
        {"loan_id": 1, "orig_rate": "4.000"},
        {"loan_id": 2, "orig_rate": "4.125"},
        {"loan_id": 3, "orig_rate": "4.000"},
        {"loan_id": 4, "state": None, "orig_rate": "7.000"},
    ]
    spec = CohortSpec.vintage(2022, by=("state",), average_coupon_only=True)
    kept = build_universe(micro(rows), spec).select("loan_id").collect()
    assert sorted(r["loan_id"] for r in kept) == [1, 3, 4]


def test_presented_report_is_ordered_and_labelled(stored):
    spec = ALL.but(by=("channel", "second_home"), rollup=True)
    shown = shapes.present(cohort_report(stored, spec), spec).collect()
    assert shown[0]["cohort_term"] == "480" and shown[-1]["cohort_term"] == "All Terms"
    assert shown[-1]["cohort_channel"] == "All Orig. Channels"
    names = {r["cohort_second_home"] for r in shown}
    assert names == {"Primary Occ.", "Second Home", "All Occ."}


def test_unnamed_servicer_uses_up_a_rank(micro):
    rows = [
        {"loan_id": 1, "servicer": "Big", "orig_upb": 300000},
        {"loan_id": 2, "servicer": None, "orig_upb": 200000},
        {"loan_id": 3, "servicer": "Small", "orig_upb": 100000},
    ]
    for party, expected in (("servicer", {1: 1, 2: None, 3: 3}), ("seller", {1: 1, 3: 2})):
        named = [{**r, "seller": r["servicer"]} for r in rows]
        loans = build_universe(micro(named), CohortSpec.vintage(2022, by=(party,)))
        ranks = {r["loan_id"]: r[f"{party}_rank"] for r in loans.collect()}
        assert ranks == expected


def test_names_stand_beside_ranks(micro):
    rows = [
        {"loan_id": 1, "servicer": "Big", "orig_upb": 300000},
        {"loan_id": 2, "servicer": None, "orig_upb": 200000},
    ]
    spec = CohortSpec.vintage(2022, by=("servicer",), rollup=True)
    report = cohort_report(micro(rows), spec).filter(c("g_loan_term") == 0).collect()
    found = {(r["servicer_rank"], r["g_servicer_rank"], r["servicer_name"]) for r in report}
    assert found == {(1, 0, "Big"), (None, 0, "Other"), (None, 1, "Total")}
    legacy = vintage_report(micro(rows), spec).collect()
    assert {r["servicer_name"] for r in legacy} == {"Big", "Other", "Total"}


def test_legacy_reports_show_subtotals_and_grand_total(stored):
    report = combined_report(stored, ALL.but(by=("vintage",), display=("strat",))).collect()
    grand = next(r for r in report if r["g_loan_term"] == 1)
    assert {r["total_orig_upb"] for r in report} == {grand["orig_upb"]}
    assert {r["loan_term"] for r in report} == {180, 240, 360, None}
    with pytest.raises(ValueError, match="cannot group"):
        vintage_report(stored, ALL.but(by=("mi",)))


@pytest.mark.parametrize(
    "options",
    [
        {"by": ("age",), "display": ("history",)},
        {"by": ("colour",)},
        {"display": ("colour",)},
        {"by": ("balance",)},
        {"top_states": 9},
    ],
)
def test_impossible_specs_are_refused(options):
    with pytest.raises(ValueError):
        CohortSpec(1995, 2001, **options)


def test_to_date_credit_by_age_adds_up_to_the_report_without_age(stored):
    spec = CohortSpec(by=("vintage",))
    whole = strat_report(stored, spec).agg(F.sum("default_upb"), F.sum("default_cnt")).first()
    by_age = strat_report(stored, spec.but(by=("vintage", "age")))
    placed = by_age.agg(F.sum("default_upb"), F.sum("default_cnt"), F.sum("mo_default_upb")).first()
    assert placed[1] == whole[1]
    assert placed[0] == pytest.approx(whole[0]) == pytest.approx(placed[2])


def test_open_vintages_hold_every_loan(stored):
    assert build_universe(stored, CohortSpec(drop_early_payoffs=False)).count() == (
        stored.orig.count()
    )
    late = build_universe(stored, CohortSpec(1998)).agg(F.min("vintage")).first()[0]
    early = build_universe(stored, CohortSpec(last_vintage=1997)).agg(F.max("vintage")).first()[0]
    assert (late, early) == ("1998", "1997")


def test_a_universe_may_be_shared_by_a_report_by_balance(stored):
    spec = ALL.but(by=("balance",), segments=BalanceSegments(percentile=True))
    shared = cohort_report(stored, spec, universe=build_universe(stored, spec))
    own = cohort_report(stored, spec)
    assert shared.columns == own.columns and shared.exceptAll(own).isEmpty()


def test_older_reports_honour_or_refuse_options(stored):
    spec = ALL.but(by=("vintage",), min_count=50)
    for report in (vintage_report, combined_report, combined_age_curve):
        found = report(stored, spec)
        assert found.agg(F.min("loans")).first()[0] >= 50
        assert found.count() < report(stored, spec.but(min_count=None)).count()
    with pytest.raises(ValueError, match="cannot show"):
        combined_age_curve(stored, spec.but(display=("strat",)))


def test_overlapping_runs_count_in_each(stored):
    runs = {"all": F.lit(True), "big": c("orig_upb") > 200000, "none": F.lit(None).cast("boolean")}
    curves = sweep.exclusive_age_curves(stored, ALL, runs)
    loans = {r["run_id"]: r["n"] for r in curves.groupBy("run_id").agg(
        F.max("cohort_loans").alias("n")).collect()}
    assert set(loans) == {"all", "big"} and loans["all"] > loans["big"] > 0


def test_many_balance_steps(stored):
    steps = tuple(f"{k:03d}" for k in range(50, 500, 25))
    spec = ALL.but(by=("balance",), segments=BalanceSegments(steps=steps))
    found = cohort_report(stored, spec)
    assert found.agg(F.sum("loans")).first()[0] == build_universe(stored, ALL).count()
