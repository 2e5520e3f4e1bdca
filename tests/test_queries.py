"""Named queries against their SQL answers.

The default run covers one query per part of the engine; `LOANLENS_ALL=1` runs all of them, as
does `tools/check.py` on a folder of choice.
"""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from loanlens.catalog import registered
from tests.conftest import SMALL
from tools.check import connect, difference

CORE = (
    "scan_orig scan_month scan_term universe eligibility_legacy bal_steps annual_income "
    "filter_ranges avg_coupon by_mi by_servicer cohort_totals labels strats age_curve_by_vintage "
    "cum_lgd horizon_cpr ever_120 sweep_specs batch_index format_human sample_check legacy_report "
    "legacy_report_b legacy_age_curve"
).split()
NAMES = sorted(registered()) if os.environ.get("LOANLENS_ALL") else CORE


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    assert difference(queries()[name](spark, SMALL), database, oracle_sql()[name]) is None


def test_every_query_has_an_answer():
    assert set(registered()) == set(oracle_sql()) & set(registered())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert not entry(spark).isEmpty()
