"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, rows_of

from densigrid.queries import QUERIES, SQL


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    assert (sorted(df.columns), rows_of(df.columns, df.collect())) == oracle(SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert {r.mode for r in __spark_entry__.entry(spark).collect()} == {"external", "pooled", "internal"}
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_rows_are_read_once_and_pruned(spark):
    plan = QUERIES["bin_occupancy"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "l_comment" not in plan and "l_shipdate" not in plan
    assert "Python" not in plan and "Pandas" not in plan
