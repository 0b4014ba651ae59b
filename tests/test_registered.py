"""Every registered query against its SQL on the supplied tables."""

import pytest

import __spark_entry__ as entry
from checks import oracle
from checks import queries as registered
from checks.compare import compare, connect
from checks.spec import SPEC
from samples import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql()) == set(SPEC)
    assert set(SPEC) <= set(entry.queries()) and set(SPEC) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(registered.queries()))
def test_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["query_id", "rank", "id", "score"]
    assert df.count() > 0

