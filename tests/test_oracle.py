"""Every registered core query against its SQL; those without SQL must run and keep their schema."""

import pytest

from spanloom.plans import load_all
from tests.oracle import SF, same

QUERIES, SQL = load_all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
