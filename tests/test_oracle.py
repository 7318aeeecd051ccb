"""Every registered query against its DuckDB oracle on the smallest test data."""

import pytest

import __spark_entry__ as E
from encore.plans.checker import compare
from encore.plans.registry import QUERIES, SQL

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, names=list(QUERIES), verbose=False)


def test_every_oracle_query_matches(results):
    bad = {k: v for k, v in results.items() if v.get("ok") is False}
    assert not bad, bad


def test_every_query_has_an_oracle():
    assert not set(QUERIES) - set(SQL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "play_hours", "rolling_7d", "cumulative_hours"]
