"""Layer 1: every query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from oracle_util import compare, duck

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["prediction", "rows", "u_sum"]
    assert sum(r["rows"] for r in rows) > 0
