"""Every registered query with SQL gives the same rows in DuckDB; the others run and return rows."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare, duck
from tidemark.plans.catalog import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_rows(spark, tables, con, name):
    q = QUERIES[name]
    assert compare(spark, con, lambda: q.build(tables), q.sql) == ""


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_rows_only(tables, name):
    assert QUERIES[name].build(tables).limit(1).count() == 1
