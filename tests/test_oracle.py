"""Every core query that SQL can express against DuckDB, over whole tables."""

import os

import oracle
import pytest

from quarry import queries as core
from quarry import queries_more, queries_source  # noqa: F401  (they register their queries)

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equal(spark, con, name):
    assert oracle.difference(core.queries()[name](spark, FOLDER), con, core.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, FOLDER).count() >= 0
