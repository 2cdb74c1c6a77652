"""Every registered query on the smallest tables against its SQL, and the plans' shape."""

import pytest

from check_oracle import compare, connect
from eventide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name in catalog.ORACLES:
        assert compare(df, con, catalog.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_scans_read_only_what_is_needed(spark):
    text = plan(catalog.QUERIES["shift_truth"](spark, SF))
    assert "embedding" not in text.split("ReadSchema")[1]
    text = plan(catalog.QUERIES["user_turns"](spark, SF))
    assert "EqualTo(role,user)" in text
