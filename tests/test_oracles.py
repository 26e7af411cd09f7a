"""Every registered query against its SQL text on the same tables."""

import pytest

from tests.oracle import SF, connect, differences
from wellgrid import catalog

catalog.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_is_flagship(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"perturbation", "n_query_wells", "recall_at_1", "recall_at_10"} <= set(e.entry(spark).columns)


def test_comparison_notices_a_wrong_value(spark, con):
    df = spark.sql("select 1 as a, 2.5 as b")
    assert differences(df, con, "select 1 as a, 2.5 as b") == []
    assert differences(df, con, "select 1 as a, 2.6 as b")
