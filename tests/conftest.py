from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, Row, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loanlens.session import tune  # noqa: E402
from loanlens.sources.schemas import MONTH, ORIG, TERM  # noqa: E402
from loanlens.sources.tables import LoanTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("loanlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def stored(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> LoanTables:
    """The small loan tables, derived once and read back from parquet."""
    root = str(tmp_path_factory.mktemp("loans"))
    LoanTables.from_star(spark, SMALL).write(root)
    return LoanTables.from_parquet(spark, root)


LOAN = {
    "loan_id": 1,
    "orig_date": "202205",
    "first_pay": "202207",
    "orig_term": 360,
    "orig_rate": "6.000",
    "orig_upb": "100000.00",
    "channel": "R",
    "high_balance_loan_indicator": "N",
    "first_flag": "N",
    "seller": "A",
    "servicer": "S",
    "state": "CA",
    "dti": 36,
    "oltv": 60,
    "ocltv": 60,
    "cscore_b": 740,
    "cscore_c": None,
    "no_units": 1,
    "num_bo": 1,
    "prop": "SF",
    "occ_stat": "P",
    "purpose": "P",
    "mi_type": None,
    "mi_pct": None,
    "property_inspection_waiver_indicator": "A",
    "ppmt_flg": "N",
    "io": "N",
}


def _typed(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    from decimal import Decimal

    from pyspark.sql.types import DecimalType

    money = {f.name for f in schema.fields if isinstance(f.dataType, DecimalType)}
    shaped = []
    for row in rows:
        values = {f.name: row.get(f.name) for f in schema.fields}
        for name in money:
            if values[name] is not None:
                values[name] = Decimal(str(values[name]))
        shaped.append(Row(**values))
    return spark.createDataFrame(shaped, schema)


@pytest.fixture(scope="session")
def micro(spark: SparkSession):
    """Build loan tables from partial rows; loans start from a plain default loan."""

    def build(
        orig: list[dict], month: list[dict] | None = None, term: list[dict] | None = None
    ) -> LoanTables:
        return LoanTables(
            _typed(spark, [{**LOAN, **row} for row in orig], ORIG),
            _typed(spark, month or [], MONTH),
            _typed(spark, term or [], TERM),
        )

    return build
