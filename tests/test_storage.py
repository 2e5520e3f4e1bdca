"""Report sinks, kept stages, and stored tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from loanlens.operators.summary import cohort_summary
from loanlens.operators.universe import build_universe
from loanlens.plans import shapes
from loanlens.plans.cohort import age_curve
from loanlens.sources import sinks
from loanlens.sources.tables import LoanTables, _periods
from loanlens.spec import CohortSpec

SPEC = CohortSpec.vintage(1996, term=360)


def test_report_is_written_once_and_read_back(spark, stored, tmp_path):
    report = shapes.present(age_curve(stored, SPEC), SPEC.but(by=("age",)))
    parameters = ["F_VINT=1996", "F_TERM=360", "BY_AGE"]
    path = sinks.write_report(report, str(tmp_path), parameters)
    assert path.endswith("F_VINT=1996-F_TERM=360-BY_AGE.tsv")
    back = sinks.read_report(spark, path)
    assert back.columns == report.columns and back.count() == report.count()
    before = sorted(p.name for p in Path(path).iterdir())
    assert sinks.write_report(report.limit(1), str(tmp_path), parameters) == path
    assert sorted(p.name for p in Path(path).iterdir()) == before
    files = back.select(sinks.source_file().alias("f")).distinct().collect()
    assert all("F_VINT=1996" in row["f"] for row in files)


def test_kept_stages(spark, stored, tmp_path):
    universe = build_universe(stored, SPEC)
    sinks.keep({"universe": universe, "summary": cohort_summary(universe, SPEC)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/universe").count() == universe.count()
    total = spark.read.parquet(f"{tmp_path}/summary").filter(F.col("g_loan_term") == 1).first()
    assert total["loan_cnt"] == universe.count()


def test_stored_tables_equal_the_derived_ones(spark, stored):
    derived = LoanTables.from_star(spark, "/root/testdata/sf0.001")
    for name in ("orig", "month", "term"):
        mine, other = getattr(stored, name), getattr(derived, name)
        assert mine.count() == other.count()
        assert mine.exceptAll(other.select(*mine.columns)).isEmpty()


def test_bucketed_tables_join_without_shuffling_history(spark, stored, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    stored.save("bucketed.", 4)
    tables = LoanTables.from_catalog(spark, "bucketed.")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        curve = age_curve(tables, SPEC)
        plan = curve._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("loan_id" in line for line in shuffles)
        assert curve.count() == age_curve(stored, SPEC).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_last_period_is_known_without_a_scan(spark, stored, tmp_path):
    """Written and saved tables know it; months that come later are found in their files alone."""
    root = str(tmp_path / "loans")
    stored.write(root)
    last = stored.month.agg(F.max("act_period")).first()[0]

    def asked() -> tuple[str, str]:
        latest = LoanTables.from_parquet(spark, root).latest_period()
        return latest.first()[0], latest._jdf.queryExecution().executedPlan().toString()

    period, plan = asked()
    assert period == last and "FileScan" not in plan
    more = stored.month.limit(5).withColumn("act_period", F.lit("203001"))
    LoanTables.append_months(spark, root, more)
    period, plan = asked()
    assert period == "203001" and "FileScan" not in plan
    late = more.limit(2).withColumn("act_period", F.lit("203102"))
    late.write.mode("append").parquet(f"{root}/month/vintage=1996")  # in another way
    period, plan = asked()
    assert period == "203102" and plan.count("FileScan") == 1
    assert LoanTables.from_parquet(spark, root).month.count() == stored.month.count() + 7
    spark.sql(f"CREATE DATABASE kept LOCATION '{tmp_path}/db'")
    try:
        stored.save("kept.", 2)
        latest = LoanTables.from_catalog(spark, "kept.").latest_period()
        assert latest.first()[0] == last
        assert "FileScan" not in latest._jdf.queryExecution().executedPlan().toString()
        more.select(*spark.table("kept.month").columns).write.insertInto("kept.month")
        assert LoanTables.from_catalog(spark, "kept.").latest_period().first()[0] == "203001"
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def test_paths_are_cut_once_a_file(spark, stored):
    """Months are grouped by their whole path before the shuffle; only the groups' paths are cut."""
    periods = _periods(stored.month)
    plan = periods._jdf.queryExecution().executedPlan().toString()
    below = plan.rpartition("Exchange hashpartitioning")[2]
    assert "input_file_name()" in below and "regexp_extract" not in below
    months = {"/".join(r["path"].split("/")[-2:]): r["last"] for r in (
        stored.month.groupBy(F.input_file_name().alias("path"))
        .agg(F.max("act_period").alias("last")).collect()
    )}
    assert dict(periods.select("file", "max_period").collect()) == months
