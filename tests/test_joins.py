"""Full joins of SELECT statements against Spark's own."""

import pytest
from pyspark.sql import functions as F

from docplan.operators import joins
from docplan.plans import ansi


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE", 8)
    a = [(i, 1, f"a{i}") for i in range(100)] + [(i, 2, None) for i in range(100, 103)] + [(i, None, "n") for i in range(103, 123)] + [(i, 5, "e") for i in range(123, 143)]
    b = [(i, 1, None) for i in range(60)] + [(i, 2, "b") for i in range(60, 80)] + [(80, None, "n")] + [(i, 9, "o") for i in range(81, 100)] + [(100, 7, "s")] * 3
    return {"a": spark.createDataFrame(a, "x long, k int, s string"), "b": spark.createDataFrame(b, "y long, l int, s string")}


@pytest.mark.parametrize("kind", ["int", "long", "string", "double"])
def test_full_join_has_all_rows(spark, tables, kind):
    tables["b"] = tables["b"].withColumn("l", F.col("l").cast(kind))
    got = ansi.select(spark, "SELECT x, k, a.s AS s, y, l, b.s AS t FROM a FULL JOIN b ON k = l", tables.__getitem__, tables)
    a, b = tables["a"], tables["b"].withColumnRenamed("s", "t")
    assert rows(got) == rows(a.join(b, a["k"] == b["l"], "full").select("x", "k", "s", "y", "l", "t"))
    assert got.count() == 100 * 60 + 3 * 20 + 20 + 20 + 1 + 19 + 3


def test_full_join_cuts_large_groups(spark, tables):
    """A key's pairs are made by many tasks, and by none at once."""
    got = ansi.select(spark, "SELECT x, y FROM a FULL JOIN b ON k = l", tables.__getitem__, tables)
    assert "FullOuter" not in got._jdf.queryExecution().executedPlan().toString()
    shares = got.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 4
    assert max(r["count"] for r in shares) < 3000


def test_full_join_of_a_table_with_itself(spark, tables):
    got = ansi.select(spark, "SELECT p.x AS x, q.x AS z FROM a p FULL JOIN a q ON p.k = q.k WHERE x > 99", tables.__getitem__, tables)
    assert got.count() == 3 * 3 + 20 + 20 * 20
