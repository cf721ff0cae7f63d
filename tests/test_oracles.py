"""Every query with SQL against DuckDB; every other one must answer rows, with a value in each column."""

import os

import pytest

from causeway.plans import all_queries
from tests.compare import connect, expected, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, con, name):
    df = all_queries.QUERIES[name](spark, SF)
    if name in all_queries.ORACLES:
        assert rows_of(df) == expected(con, all_queries.ORACLES[name])
    else:
        cols, rows = rows_of(df)
        assert rows and all(any(r[i] is not None for r in rows) for i in range(len(cols))), name
