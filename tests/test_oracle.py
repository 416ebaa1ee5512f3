"""Every registered query against its DuckDB oracle on the driver's tables."""

import re

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

# The training-data queries have their own tests beside their subpackage.
NAMES = sorted(n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def con(sf001):
    return duck(sf001)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, sf001, con, name):
    ok, msg = compare(spark, sf001, name, con)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows
    assert df.columns == ["TARGET_ICAO", "dir_bin", "speed_range", "n_obs", "frequency"]
