"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import connection, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    with connection(FOLDER) as c:
        yield c


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name], exact=False) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = {r["name"]: r["value"] for r in entry(spark).collect()}
    assert rows["Units"] * 7 == rows["Observations"]
