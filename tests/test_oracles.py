"""Every registered query of the library against its SQL counterpart, on whole small tables."""

import oracle
import pytest

from glosswork import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, con, name):
    assert oracle.compare(spark, con, small, QUERIES[name], ORACLES[name]) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
