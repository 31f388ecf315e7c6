"""Every query that has SQL, against DuckDB."""

import pytest
from compare import assert_same

from docplan.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert_same(df, data, ORACLE[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, data):
    """Top-level comparisons stay bare, so Parquet gets them; only the columns that are needed are read."""
    plan = QUERIES["match_group_sort"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,20" in plan
    assert "l_comment" not in plan
    assert "l_tax" not in plan
