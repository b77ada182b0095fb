"""Every registered query beside its SQL in DuckDB, and guards on the physical plans."""

from __future__ import annotations

import pytest

from lakeops.checks import ORACLES, QUERIES
from tests.compare import difference, open_duckdb

SF_DIR, LARGER_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    if name in ORACLES:
        problem = difference(df, con, ORACLES[name])
        if problem == "both results are empty":  # a larger table has to show that they agree
            problem = difference(QUERIES[name](spark, LARGER_DIR), open_duckdb(LARGER_DIR), ORACLES[name])
        assert problem is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"f6_train_classifier", "f7_batch_scoring"}
