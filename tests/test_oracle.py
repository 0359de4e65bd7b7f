"""Every query with a SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, folder, duck, name):
    problem = compare(entry.queries()[name](spark, folder), duck, entry.oracle_sql()[name])
    # The smallest tables leave a few of the thresholds without any row; both sides agree then too.
    assert problem in (None, "no rows")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 22
