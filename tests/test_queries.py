import os

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
OWN = [f.__name__ for f in entry.QUERIES]  # the pipeline operators have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


def test_every_query_has_its_sql():
    assert set(OWN) <= set(entry.queries())
    assert set(OWN) == set(entry.oracle_queries.statements())


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    _, _, verdict = check_queries.compare(spark, con, SF, name)
    assert verdict == "ok"


def test_flagship(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "h1", "h2", "h3", "h4"]
