"""The three loan tables and where they come from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions import loan
from loanlens.sources import star
from loanlens.sources.schemas import SCHEMAS
from loanlens.spec import CohortSpec

Source = DataFrame | Callable[[], DataFrame | None]


# Partition column of stored history and terminal records.
VINTAGE = "vintage"


def _frame(source: Source) -> DataFrame | None:
    return source() if callable(source) else source


def _file(path: Column) -> Column:
    """A file by its last folder and name, whatever the way to it is called."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def _periods(month: DataFrame) -> DataFrame:
    """The last reporting month of each file of a stored history. Rows are grouped by their whole path,
    so that a path is cut once for each file and task, not for each row."""
    last = F.max("act_period").alias("act_period")
    paths = month.groupBy(F.input_file_name().alias("path")).agg(last)
    return paths.groupBy(_file(F.col("path")).alias("file")).agg(
        F.max("act_period").alias("max_period")
    )


def _new_files(month: DataFrame, stored: DataFrame | None) -> tuple[list[str], str | None]:
    """Files that the stored months do not know, and the last month of those that they know and that
    are still there. File names are metadata, which Spark's own listing holds on the driver."""
    there = {"/".join(path.split("/")[-2:]): path for path in month.inputFiles()}
    known = {} if stored is None else dict(stored.select("file", "max_period").collect())
    new = [path for name, path in there.items() if name not in known]
    last = max((known[n] for n in there if known.get(n) is not None), default=None)
    return new, last


def _latest(month: DataFrame, stored: DataFrame | None) -> DataFrame | None:
    """One row: the last month as stored, and as found in files that came later; None if nothing is
    stored."""
    if stored is None:
        return None
    spark = month.sparkSession
    new, last = _new_files(month, stored)
    row = spark.createDataFrame([(last,)], "max_period string")
    if not new:
        return row
    found = spark.read.schema("act_period string").parquet(*new)
    found = found.agg(F.max("act_period").alias("max_period"))
    return row.unionByName(found).agg(F.max("max_period").alias("max_period"))


def _stored(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The stored last months; tables from elsewhere have none."""
    try:
        frame = read()
    except AnalysisException:
        return None
    return frame if set(frame.columns) >= {"file", "max_period"} else None


class LoanTables:
    """`orig` has one row per loan, `month` one per (loan, period), `term` at most one per loan.

    A table may be given as a function; its plan is then only built when a report needs it.
    """

    def __init__(
        self, orig: Source, month: Source, term: Source, latest: Source | None = None
    ) -> None:
        self._sources = {"orig": orig, "month": month, "term": term}
        self._latest = latest
        self._stored: dict[str, DataFrame] = {}

    def _frame(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = _frame(self._sources[name])
        return self._stored[name]

    @cached_property
    def orig(self) -> DataFrame:
        return self._frame("orig")

    @cached_property
    def month(self) -> DataFrame:
        return self._frame("month").drop(VINTAGE)

    @cached_property
    def term(self) -> DataFrame:
        return self._frame("term").drop(VINTAGE)

    def of_vintages(self, name: str, spec: CohortSpec) -> DataFrame:
        """`month` or `term`; where it is stored by vintage, only the spec's vintages of it."""
        frame = self._frame(name)
        if VINTAGE not in frame.columns:
            return frame
        if spec.first_vintage is not None:
            frame = frame.filter(F.col(VINTAGE) >= spec.first_vintage)
        if spec.last_vintage is not None:
            frame = frame.filter(F.col(VINTAGE) <= spec.last_vintage)
        return frame.drop(VINTAGE)

    @staticmethod
    def from_parquet(spark: SparkSession, root: str) -> LoanTables:
        """Tables written by `write`, or any parquet folders `orig`, `month`, `term`."""
        root = root.rstrip("/")
        frames = {
            name: spark.read.schema(schema).parquet(f"{root}/{name}")
            for name, schema in SCHEMAS.items()
        }
        stored = _stored(lambda: spark.read.parquet(f"{root}/latest"))
        return LoanTables(**frames, latest=lambda: _latest(frames["month"], stored))

    @staticmethod
    def from_catalog(spark: SparkSession, prefix: str) -> LoanTables:
        """Tables saved by `save`."""
        frames = {name: spark.table(f"{prefix}{name}") for name in SCHEMAS}
        stored = _stored(lambda: spark.table(f"{prefix}latest"))
        return LoanTables(**frames, latest=lambda: _latest(frames["month"], stored))

    @staticmethod
    def from_star(spark: SparkSession, root: str) -> LoanTables:
        """Loans derived from a retail star schema (orders as loans, order lines as months)."""
        source = star.StarSchema(spark, root)
        return LoanTables(
            orig=lambda: star.orig(source),
            month=lambda: star.month(source),
            term=lambda: star.term(source),
        )

    def write(self, root: str) -> None:
        """Parquet files sorted so that a vintage range or a loan range skips row groups, and the
        last reporting month of each file of the history.

        The history and the terminal records are kept in a folder for each vintage of their loans,
        so that a cohort reads no other vintage's. Range partitioning spreads a heavy vintage over
        as many files as its rows need.
        """
        root = root.rstrip("/")
        self.orig.repartitionByRange("orig_date", "loan_id").sortWithinPartitions(
            "orig_date", "loan_id"
        ).write.mode("overwrite").parquet(f"{root}/orig")
        vintages = self.orig.select("loan_id", loan.vintage().cast("int").alias(VINTAGE))
        order = (VINTAGE, "loan_id", "act_period")
        for name in ("month", "term"):
            frame: DataFrame = getattr(self, name).join(vintages, "loan_id", "left")
            frame.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(
                VINTAGE
            ).mode("overwrite").parquet(f"{root}/{name}")
        month = self.month.sparkSession.read.schema(SCHEMAS["month"]).parquet(f"{root}/month")
        _periods(month).coalesce(1).write.mode("overwrite").parquet(f"{root}/latest")

    @staticmethod
    def append_months(spark: SparkSession, root: str, months: DataFrame) -> None:
        """Add reporting months to tables written by `write`, and their last month to what is stored.

        Rows go into the folder of their loan's vintage. Months that were added in another way are
        found by their files when the last month is asked for.
        """
        root = root.rstrip("/")
        orig = spark.read.schema(SCHEMAS["orig"]).parquet(f"{root}/orig")
        vintages = orig.select("loan_id", loan.vintage().cast("int").alias(VINTAGE))
        order = (VINTAGE, "loan_id", "act_period")
        rows = months.select(*SCHEMAS["month"].names).join(vintages, "loan_id", "left")
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.partitionBy(VINTAGE).mode("append").parquet(f"{root}/month")
        stored = _stored(lambda: spark.read.parquet(f"{root}/latest"))
        month = spark.read.schema(SCHEMAS["month"]).parquet(f"{root}/month")
        new, _ = _new_files(month, stored)
        if new:
            found = _periods(spark.read.schema(SCHEMAS["month"]).parquet(*new))
            found.coalesce(1).write.mode("append").parquet(f"{root}/latest")

    def save(self, prefix: str, buckets: int) -> None:
        """Catalog tables bucketed by loan, so that the joins on loan_id need no shuffle."""
        for name in SCHEMAS:
            frame: DataFrame = getattr(self, name)
            (
                frame.repartition(buckets, "loan_id")
                .write.mode("overwrite")
                .bucketBy(buckets, "loan_id")
                .sortBy("loan_id")
                .format("parquet")
                .saveAsTable(f"{prefix}{name}")
            )
        month = self.month.sparkSession.table(f"{prefix}month")
        latest = _periods(month).coalesce(1).write.mode("overwrite").format("parquet")
        latest.saveAsTable(f"{prefix}latest")

    def wide_history(self) -> DataFrame:
        """Monthly rows that also carry the terminal fields of their loan's terminal month."""
        return self.month.join(self.term, ["loan_id", "act_period"], "left")

    def latest_period(self) -> DataFrame:
        """One row: the last reporting month of the history, as stored or else found in it."""
        stored = None if self._latest is None else _frame(self._latest)
        if stored is not None:
            return stored
        return self.month.agg(F.max("act_period").alias("max_period"))
