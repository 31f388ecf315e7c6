"""SQL of databases: what the document dialect doesn't have, and statements that return rows."""

import pytest

from docplan.database import Database
from docplan.plans.sql import SqlError


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, str(tmp_path / "sql"))
    d.sql("INSERT INTO t (_id, a, b) VALUES ('1', 1, 'x'), ('2', 2, 'y'), ('3', NULL, 'z')")
    return d


def test_spark_sql_over_collections(db, spark):
    spark.range(3).createOrReplaceTempView("t")  # a user's view of the same name comes back
    got = db.sql("WITH c AS (SELECT b, a FROM t WHERE a IS NOT NULL) SELECT b FROM c UNION ALL SELECT 'w' ORDER BY b")
    assert [r["b"] for r in got.collect()] == ["w", "x", "y"]
    assert [r["n"] for r in db.sql("SELECT count(*) AS n FROM t WHERE CASE WHEN a > 1 THEN true END").collect()] == [1]
    assert db.sql("SELECT a + 1 AS c FROM t WHERE _id = '1'").first()["c"] == 2
    assert db.sql("SELECT upper(b) AS u FROM t WHERE a = :a", {"a": 2}).first()["u"] == "Y"
    assert spark.table("t").count() == 3
    assert spark.table("t").columns == ["id"]
    spark.catalog.dropTempView("t")
    with pytest.raises(SqlError):
        db.sql("SELECT b FROM")


def test_conflicts_and_returning(db):
    assert db.sql("INSERT INTO t (_id, a, b) VALUES ('1', 9, 'n'), ('4', 4, 'v') ON CONFLICT (_id) DO NOTHING") == 1
    got = db.sql("INSERT INTO t (_id, a, b) VALUES ('2', 20, 'q'), ('5', 5, 'r') ON CONFLICT (_id) DO UPDATE SET a = EXCLUDED.a RETURNING _id, a")
    assert [(r["_id"], r["a"]) for r in got.collect()] == [("5", 5)]
    assert {r["_id"]: (r["a"], r["b"]) for r in db["t"].find().collect()} == {"1": (1, "x"), "2": (20, "y"), "3": (None, "z"), "4": (4, "v"), "5": (5, "r")}
    assert [(r["_id"], r["a"]) for r in db.sql("UPDATE t SET a = 7 WHERE a > 4 AND a < 9 RETURNING _id, a").collect()] == [("5", 7)]
    assert sorted(r["_id"] for r in db.sql("DELETE FROM t WHERE a >= 7 RETURNING *").collect()) == ["2", "5"]
    assert db["t"].count() == 3
