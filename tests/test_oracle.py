"""Every registered query equals its DuckDB oracle on the test tables
(sf0.001 by default; set EPIWATCH_ORACLE_SF to another folder, e.g. the sf0.01
tables the correctness gate uses)."""

import os

import pytest

from oracle_harness import compare, duck

SF = os.environ.get("EPIWATCH_ORACLE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    import __spark_entry__ as e
    return sorted(set(e.queries()) & set(e.oracle_sql()))


def test_every_query_of_the_catalog_has_sql():
    import __spark_entry__ as e
    from epiwatch.plans.catalog import QUERIES
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as e
    res = compare(e.queries()[name](spark, SF), con, e.oracle_sql()[name])
    assert res["match"], res


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "peak_rate" in df.columns
