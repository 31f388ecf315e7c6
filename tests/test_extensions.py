"""Plugins, geometry on the sphere, cross-type order, jobs, indexed files, the command line."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from docplan.__main__ import main
from docplan.database import Database, DatabaseError
from docplan.functions import geo, plugins
from docplan.functions.filters import FilterError, fields_of
from docplan.functions.paths import of
from docplan.operators import kv, search, stores
from docplan.operators.pipeline import run_pipeline
from docplan.operators.windows import order_by
from docplan.plans.select import find
from docplan.sources import files


def test_plugins(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    plugins.function("twice", lambda c: c * 2)
    plugins.python_function("half", lambda s: s / 2, "double")
    plugins.accumulator("squares", lambda c: F.sum(c * c))
    plugins.stage("top", lambda rows, n: rows.orderBy(F.desc("v")).limit(n))
    try:
        got = run_pipeline(df, [{"$addFields": {"w": {"$twice": "$v"}, "h": {"$half": "$v"}}}, {"$group": {"_id": "$k", "s": {"$squares": "$w"}, "h": {"$sum": "$h"}, "p": {"$accumulator": {"init": 1.0, "merge": lambda s, x: s * x, "args": ["$v"]}}}}])
        assert {r["_id"]: (r["s"], r["h"], r["p"]) for r in got.collect()} == {"a": (40.0, 2.0, 3.0), "b": (100.0, 2.5, 5.0)}
        assert [r["v"] for r in run_pipeline(df, [{"$top": 1}]).collect()] == [5.0]
        with pytest.raises(ValueError, match="already"):
            plugins.function("twice", lambda c: c)
        db = Database(spark, str(tmp_path / "v"))
        plugins.validator("named", lambda d: "name" in d)
        db.create_collection("x", validators=["named"])
        db["x"].insert({"_id": "1", "name": "n"})
        with pytest.raises(DatabaseError, match="refuses"):
            db["x"].insert({"_id": "2"})
    finally:
        assert all([plugins.drop(n) for n in ("twice", "half", "squares", "top", "named")])
    assert find(df, {"$where": "v > 2 AND k = 'a'"}, where=True).count() == 1
    with pytest.raises(FilterError):
        find(df, {"$where": "v > 2"})
    assert fields_of({"$and": [{"a.b": 1}, {"$or": [{"c": {"$gt": 2}}]}], "$expr": {"$gt": ["$d", "$e"]}, "$not": {"f": 1}}) == ["a.b", "c", "d", "e", "f"]


def test_geometry(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0]), (4, [5.0, 5.0]), (5, None)], "id int, p array<double>")
    square = {"$geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}
    holed = {"$geometry": {"type": "Polygon", "coordinates": [*square["$geometry"]["coordinates"], [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]]}}
    line = {"$geometry": {"type": "LineString", "coordinates": [[0, 0], [5, 5]]}}

    def ids(spec):
        return sorted(r["id"] for r in find(df, {"p": spec}).collect())

    assert ids({"$geoIntersects": square}) == [1, 2, 3]
    assert ids({"$geoIntersects": holed}) == [1, 3]
    assert ids({"$geoIntersects": line}) == [1, 2, 4]
    assert ids({"$geoIntersects": {"$geometry": {"type": "Point", "coordinates": [2, 0]}}}) == [3]
    assert ids({"$geoWithin": {"$centerSphere": [[0, 0], 0.03]}}) == [1, 2]
    assert ids({"$nearSphere": {"coordinates": [0, 0], "$maxDistance": 160_000}}) == [1, 2]
    got = geo.nearest(df, of(df).find("p"), {"coordinates": [1.9, 0.0], "spherical": True}, 2, "id").collect()
    assert [r["id"] for r in got] == [3, 2]
    assert got[0]["distance"] == pytest.approx(11_119.5, rel=1e-3)


def test_values_of_all_types_sort(spark):
    values = ["true", '"b"', "3", "[1]", "null", '{"a": 1}', "2.5", '"a"', "false", "-10"]
    df = spark.createDataFrame([(v,) for v in values], "j string").select("j", F.parse_json("j").alias("v"))
    got = [r["j"] for r in df.orderBy(*order_by(of(df), [("v", 1)])).collect()]
    assert got == ["null", "-10", "2.5", "3", '"a"', '"b"', '{"a": 1}', "[1]", "false", "true"]


def test_jobs(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(k, "pending", 5 - k, k, now - datetime.timedelta(hours=1), now) for k in range(5)]
    jobs = spark.createDataFrame(rows, "id long, state string, priority int, attempts int, run_at timestamp, created_at timestamp")
    ids = spark.createDataFrame([(1,), (4,), (4,)], "id long")
    got = {r["id"]: (r["state"], r["attempts"], (r["run_at"] - now).total_seconds()) for r in stores.failed(jobs, ids, now, most=5).collect()}
    assert got == {0: ("pending", 0, -3600), 1: ("pending", 2, 2), 2: ("pending", 2, -3600), 3: ("pending", 3, -3600), 4: ("dead", 5, -3600)}
    assert [r["id"] for r in stores.dead_letters(stores.failed(jobs, ids, now, most=5)).collect()] == [4]
    flow = spark.createDataFrame([(0, "done"), (1, "pending"), (2, "pending"), (3, "running")], "id long, state string")
    needs = spark.createDataFrame([(1, 0), (2, 0), (2, 3)], "id long, child long")
    assert [r["id"] for r in stores.ready(flow, needs).collect()] == [1]
    claimed = {r["id"]: (r["state"], r["owner"]) for r in stores.claim(jobs, 2, now, "w").collect()}
    assert sum(s == ("running", "w") for s in claimed.values()) == 2


def test_ids_ranks_and_buckets(spark):
    n = kv.with_ids(spark.range(0, 5_000_000, 1, 1), "snowflake")
    assert n.select(F.count_distinct("_id")).first()[0] == 5_000_000
    scored = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 != 0, (F.col("id") * 37 % 101).cast("double")).alias("score"))
    want = {r[0]: k for k, r in enumerate(sorted(scored.collect(), key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    assert {r["doc_id"]: r["rank"] for r in search.ranked(scored).collect()} == want
    events = spark.createDataFrame([("a", k, datetime.datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate((0, 0, 0, 1, 5))] + [("b", 9, datetime.datetime(2024, 1, 1)), ("a", 8, None)], "k string, id long, ts timestamp")
    assert {r["id"]: r["allowed"] for r in kv.token_bucket(events, "k", "ts", "id", 1, 2).collect()} == {8: True, 0: True, 1: False, 2: False, 3: True, 4: True, 9: True}


def test_indexed_files(spark, tmp_path):
    files.write_indexed(spark.range(1000).withColumn("s", F.col("id").cast("string")), str(tmp_path / "f"), bloom=["s"], sort=["id"])
    assert spark.read.parquet(str(tmp_path / "f")).where("s = '77'").count() == 1


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "db")
    for command in (["insert", "t", '{"_id": "1", "a": 1}', '{"_id": "2", "a": 5}'], ["find", "t", '{"a": {"$gt": 2}}'], ["count", "t"], ["sql", "SELECT a FROM t ORDER BY a LIMIT 1"], ["collections"], ["export", str(tmp_path / "out")]):
        assert main([path, *command], spark) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out == ["1", "2", {"_id": "2", "a": 5}, 2, {"a": 1}, "t"]
