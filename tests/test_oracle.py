"""Every registered query against its SQL counterpart, and on the sparse tables."""

import __spark_entry__ as entry_module
import pytest
from oracle_compare import connect, differences

#: Queries of the optional subpackage have their own tests.
QUERIES = {k: v for k, v in entry_module.queries().items() if v.__module__.startswith("panelcast.plans")}
SQL = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, medium, name):
    assert differences(QUERIES[name](spark, medium), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_sparse_tables(spark, small, name):
    """Cells are missing at the smallest scale, so NULL paths are taken."""
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry_forecasts_every_unit_of_the_last_period(spark, small):
    units = connect(small).sql(
        """SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE year(o_orderdate) = 2001"""
    )
    rows = entry_module.entry(spark).collect()
    assert len(rows) == len({r["unit"] for r in rows}) == units.fetchall()[0][0]
