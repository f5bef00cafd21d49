"""Physical plans: no cross products, columns and filters at the scan."""

import os
import re

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_product(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(entry.queries()[name](spark, FOLDER)))


def test_pushdown(spark):
    text = plan(entry.queries()["find_symbols"](spark, FOLDER))
    assert "IsNotNull(name)" in re.search(r"PushedFilters: \[([^\]]*)", text)[1]
    scan = re.search(r"ReadSchema: (\S+)", plan(entry.queries()["index_status"](spark, FOLDER)))
    assert scan[1] == "struct<filepath:string,language:string>"
