"""The distributed percent rank equals Spark's window, whatever the key and value skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlens.operators.percentile import with_percent_rank
from loanlens.operators.universe import build_universe
from loanlens.spec import BalanceSegments, CohortSpec

c = F.col


def _rows(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        key = "N" if rng.random() < 0.7 else rng.choice(["Y", None])
        shape = rng.random()
        value = 417000.0 if shape < 0.35 else round(rng.uniform(-5000, 900000), 2)
        rows.append((i, key, rng.choice(["1996", "1997"]), None if shape > 0.98 else value))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 2), (3, 500), (4, 3000)])
def test_equals_window(spark, seed, size):
    frame = spark.createDataFrame(_rows(seed, size), "id long, k string, y string, v double")
    window = Window.partitionBy("k", "y").orderBy(c("v").asc_nulls_first())
    expected = frame.select("id", F.percent_rank().over(window).alias("p"))
    found = with_percent_rank(frame, ["k", "y"], "v", 1000.0, "p").select("id", "p")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_cutoffs_give_the_same_segments_as_ranks(stored):
    spec = CohortSpec(1995, 2001, segments=BalanceSegments(percentile=True))
    by_cutoff = build_universe(stored, spec).select("loan_id", "bal_seg")
    by_rank = build_universe(stored, spec, ("balance",)).select("loan_id", "bal_seg")
    assert by_cutoff.exceptAll(by_rank).isEmpty()
    assert by_rank.exceptAll(by_cutoff).isEmpty()


def test_late_filters_do_not_move_percentiles(stored):
    spec = CohortSpec(1995, 2001)
    every = build_universe(stored, spec, ("balance", "rate"))
    some = build_universe(stored, spec.but(eligible_only=True, top_states=17), ("balance", "rate"))
    names = ["loan_id", "orig_upb_pctile", "orig_rate_pctile"]
    assert not some.isEmpty()
    assert some.select(*names).exceptAll(every.select(*names)).isEmpty()


def test_a_heavy_rate_is_dealt_over_tasks(spark, monkeypatch):
    """One rate on half the loans, dozens of rates on the rest: every task joins as many rows."""
    from loanlens.operators import joins

    monkeypatch.setattr(joins, "SPLIT", 200)
    rate = F.when(c("id") % 2 == 0, 4.5).otherwise(3 + c("id") % 37 / 8)
    loans = spark.range(20000).select(
        c("id").alias("loan_id"), F.lit("1996").alias("vintage"), rate.alias("orig_rate")
    )
    before = {
        name: spark.conf.get(name)
        for name in (
            "spark.sql.adaptive.enabled",
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.shuffle.partitions",
        )
    }
    try:
        for name, value in zip(before, ("false", "-1", "8"), strict=True):
            spark.conf.set(name, value)
        found = with_percent_rank(loans, ["vintage"], "orig_rate", 1.0, "p")
        tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        sizes = sorted(row["count"] for row in tasks)
        assert len(sizes) == 8 and sizes[-1] < 1.5 * sizes[4]
        window = Window.partitionBy("vintage").orderBy("orig_rate")
        expected = loans.select("loan_id", F.percent_rank().over(window).alias("p"))
        assert found.select("loan_id", "p").exceptAll(expected).isEmpty()
        assert found.count() == loans.count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_both_percentiles_count_the_loans_once(spark, stored):
    """One scan for the counts, one for the loans."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = build_universe(stored, CohortSpec(1995, 2001), ("balance", "rate"))
        plan = both._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x and "orig_upb" in x]
        assert len(scans) <= 2
        assert "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
