"""Every registered query against its SQL counterpart on the smallest test set."""

import os

import pytest
from oracle import ROOT, compare, duck

from tidelight.plans.registry import all_oracles, all_queries

SF = os.environ.get("TEST_SF", "sf0.001")
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    fn = all_queries()[name]
    if name in ORACLES:
        ok, message = compare(spark, con, fn, ORACLES[name], SF)
        assert ok, message
    else:
        df = fn(spark, f"{ROOT}/{SF}")
        assert df.columns and len(df.collect()) > 0


def test_only_random_and_fitted_queries_lack_sql():
    assert set(all_queries()) - set(ORACLES) == {"outburst_report", "null_draws", "pulse_fit", "event_fit", "event_residuals", "event_curves"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
