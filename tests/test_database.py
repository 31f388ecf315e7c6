"""Databases: documents, transactions, views, relations, changes, export."""

import json

import pytest

from docplan.database import Conflict, Database, DatabaseError
from docplan.operators.relations import IntegrityError
from docplan.plans.builders import UpdateBuilder


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def test_documents(db):
    users = db["users"]
    ids = users.insert_many([{"_id": "1", "name": "Alice", "age": 30, "roles": ["admin"]}, {"_id": "2", "name": "Bob", "age": 25, "roles": []}, {"name": "Cy", "age": 35.5, "extra": {"a": 1}}])
    assert len(ids) == 3
    assert users.count() == 3
    assert users.count({"age": {"$gt": 28}}) == 2
    assert users.find_one({"_id": "1"})["name"] == "Alice"
    assert users.update({"_id": "1"}, UpdateBuilder().set("age", 31).push("roles", "user")) == 1
    row = users.find_one({"_id": "1"})
    assert (row["age"], row["roles"]) == (31, ["admin", "user"])
    assert users.update_many({"age": {"$gt": 0}}, {"$inc": {"age": 1}}) == 3
    assert users.update({"_id": "nobody"}, {"$set": {"age": 1}}) == 0
    assert users.update({"_id": "4"}, {"$set": {"age": 1}, "$setOnInsert": {"name": "Di"}}, upsert=True) == 0
    assert users.find_one({"_id": "4"})["name"] == "Di"
    assert users.find_one_and_update({"_id": "4"}, {"$set": {"age": 2}})["age"] == 1
    assert users.find_one_and_delete({"_id": "4"})["age"] == 2
    assert users.delete_many({"age": {"$lt": 30}}) == 1
    assert sorted(r["op"] for r in db.changes(collection="users").collect()).count("insert") == 4
    first = db.changes(collection="users").where("op = 'update'").first()
    assert (json.loads(first["before"])["age"], json.loads(first["document"])["age"]) == (30.0, 31.0)
    seqs = [r["seq"] for r in db.changes().collect()]
    assert seqs == sorted(set(seqs))
    assert users.insert_many([{"_id": "9"}], session=("s", 1)) == users.insert_many([{"_id": "9"}], session=("s", 1))
    assert users.count({"_id": "9"}) == 1
    assert Database(db.spark, db.path)["users"].count() == users.count()
    assert "winningPlan" in users.explain({"age": 1})["queryPlanner"]
    assert users.rollback(1) and users.count() == 3


def test_sql(db):
    assert db.sql("INSERT INTO t (_id, a, b) VALUES ('1', 1, 'x'), ('2', 2, 'y')") == 2
    assert [r["b"] for r in db.sql("SELECT b FROM t WHERE a > 1 AND a < 3").collect()] == ["y"]
    assert db.sql("UPDATE t SET a = 9 WHERE a > 0") == 2
    assert db.sql("SELECT COUNT(*) AS n FROM t WHERE a = ?", [9]).first()["n"] == 2
    assert db.sql("DELETE FROM t WHERE b LIKE 'x%'") == 1


def test_transactions(db):
    a = db["accounts"]
    a.insert_many([{"_id": "A", "balance": 1000}, {"_id": "B", "balance": 500}])
    with db.transaction() as t:
        a.update({"_id": "A"}, {"$inc": {"balance": -100}})
        t.savepoint("p")
        a.update({"_id": "B"}, {"$inc": {"balance": 7}})
        t.rollback_to("p")
        a.update({"_id": "B"}, {"$inc": {"balance": 100}})
        assert a.find_one({"_id": "B"})["balance"] == 600
        assert Database(db.spark, db.path)["accounts"].find_one({"_id": "B"})["balance"] == 500
    assert {r["_id"]: r["balance"] for r in a.find().collect()} == {"A": 900, "B": 600}
    with pytest.raises(ZeroDivisionError), db.transaction():
        a.delete_many()
        raise ZeroDivisionError
    assert a.count() == 2
    with pytest.raises(Conflict), db.transaction():
        a.update({"_id": "A"}, {"$set": {"balance": 0}})
        Database(db.spark, db.path)["accounts"].update({"_id": "B"}, {"$set": {"balance": 1}})
    assert db.with_transaction(lambda t: 5) == 5


def test_views_and_pipeline_writes(db):
    db["orders"].insert_many([{"_id": str(k), "status": s, "total": t} for k, (s, t) in enumerate([("a", 1), ("b", 2), ("a", 3)])])
    db.create_view("a", "orders", [{"$match": {"status": "a"}}])
    db.create_view("sums", "orders", [{"$group": {"_id": "$status", "t": {"$sum": "$total"}}}], materialized=True, refresh="on_write")
    db.create_view("still", "orders", [{"$count": "n"}], materialized=True)
    db["orders"].insert({"_id": "9", "status": "a", "total": 10})
    assert db.table("a").count() == 3
    assert {r["_id"]: r["t"] for r in db.table("sums").collect()} == {"a": 14, "b": 2}
    assert db.table("still").first()["n"] == 3
    db.refresh_view("still")
    assert db.table("still").first()["n"] == 4
    assert db["orders"].aggregate([{"$match": {"total": {"$gt": 2}}}, {"$out": "big"}]).count() == 2
    db["orders"].aggregate([{"$match": {"_id": {"$in": ["0", "9"]}}}, {"$addFields": {"total": 100}}, {"$merge": {"into": "big"}}])
    assert {r["_id"]: r["total"] for r in db.table("big").collect()} == {"0": 100, "2": 3, "9": 100}
    assert db.drop_view("still")


def test_relations_indexes_triggers(db):
    db["p"].insert_many([{"_id": "1"}, {"_id": "2"}])
    db["c"].insert_many([{"_id": "x", "p": "1"}, {"_id": "y", "p": "2"}, {"_id": "z", "p": "7"}])
    db.define_relation("parent", "c", "p", "p", on_delete="cascade", one=True)
    assert [r["_id"] for r in db.check_relation("parent").collect()] == ["z"]
    assert {r["_id"]: r["parent"] and r["parent"]["_id"] for r in db.populate("parent").collect()} == {"x": "1", "y": "2", "z": None}
    db["p"].delete({"_id": "1"})
    assert sorted(r["_id"] for r in db["c"].find().collect()) == ["y", "z"]
    db.define_relation("parent", "c", "p", "p", on_delete="restrict")
    with pytest.raises(IntegrityError):
        db["p"].delete({"_id": "2"})
    db["p"].create_index("_id", unique=True)
    with pytest.raises(DatabaseError):
        db["p"].insert({"_id": "2"})
    db["p"].hide_index("_id_1")
    assert db["p"].indexes()[0]["hidden"]
    seen = []
    db.create_trigger("t", "before", "insert", "p", lambda d: d | {"stamp": 1})
    db.create_trigger("u", "after", "insert", "p", seen.append)
    db["p"].insert({"_id": "3"})
    assert seen == [{"_id": "3", "stamp": 1}]
    assert db["p"].drop_index("_id_1")


def test_export_and_attach(db, spark, tmp_path):
    db["t"].insert_many([{"_id": "1", "a": 1}, {"_id": "2", "a": 2}])
    assert {n: sorted(r, key=str) for n, r in db.export().items()} == {"t": [{"_id": "1", "a": 1}, {"_id": "2", "a": 2}]}
    db.export_files(str(tmp_path / "out"))
    db.export_files(str(tmp_path / "array"), "json")
    other = Database(spark, str(tmp_path / "other"))
    (tmp_path / "out" / "t" / "bad.json").write_text("{nonsense\n")
    assert other.import_file("t", str(tmp_path / "out" / "t")) == 2
    text = "".join(p.read_text() for p in (tmp_path / "array" / "t").glob("part-*"))
    assert len(json.loads(text)) == 2
    m = db.backup(str(tmp_path / "backup"))
    assert m["tables"]["t"]["rows"] == 2
    other.restore(str(tmp_path / "backup"))
    assert other["t"].count() == 2
    db.attach(str(tmp_path / "other"), "o")
    assert db.table("o.t").count() == 2
    with pytest.raises(DatabaseError):
        db._attached["o"]["t"].insert({"_id": "3"})
    assert db.detach("o")
    for n in (0, 10, 600_000):
        data = bytes(range(256)) * (n // 256) + b"x" * (n % 256)
        assert db.get_blob(db.put_blob(data)) == data
    assert db.pragma("p", 5) == 5
    assert db.metrics()["collections"] == 1


def test_watch_and_streams(db, spark, tmp_path):
    from pyspark.sql import functions as F

    from docplan.streaming import changes

    db["t"].insert_many([{"_id": "1"}, {"_id": "2"}])
    db["u"].insert({"_id": "3"})
    seen = []
    db["t"].watch(seen.append, once=True).awaitTermination()
    assert [c["key"] for c in seen] == ["1", "2"]
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:30:00"), (3, "b", "2024-01-01 02:00:00"), (1, "a", "2024-01-01 00:00:00")], "id long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    once = changes.deduplicate(source, "ts", ["id"])
    counted = changes.tumbling(once, "ts", "1 hour", ["k"], [F.count("*").alias("n")], None)
    q = counted.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["k"], r["window"]["start"].hour): r["n"] for r in spark.table("counted").collect()}
    assert got.get(("a", 0)) == 2
    sums = []
    changes.keep_sum(source.withColumn("v", F.lit(1)), "k", "v", "total", str(tmp_path / "cp"), lambda b: sums.extend(b.collect())).awaitTermination()
    assert {r["k"]: r["total"] for r in sums} == {"a": 3, "b": 1}


def test_two_handles_lose_nothing(spark, tmp_path):
    a, b = (Database(spark, str(tmp_path / "two")) for _ in range(2))
    b["y"].insert({"_id": "1"})
    a["x"].insert({"_id": "1"})
    b["x"].insert({"_id": "2"})
    a["x"].insert({"_id": "3", "n": 1})
    third = Database(spark, a.path)
    assert third.collections() == ["x", "y"]
    assert sorted(r["_id"] for r in third["x"].find().collect()) == sorted(r["_id"] for r in b["x"].find().collect()) == ["1", "2", "3"]
    with a.transaction():
        a["z"].insert({"_id": "1"})
        b["x"].insert({"_id": "4"})  # another collection, so there is no conflict
    assert (third["z"].count(), third["x"].count()) == (1, 4)
    a.create_view("v", "x", [{"$count": "n"}])
    b.define_relation("r", "x", "y", "n")
    assert [v["name"] for v in b.views()] == ["v"]
    assert [r["name"] for r in a.relations()] == ["r"]
    assert [r["seq"] for r in third.changes().collect()] == list(range(1, 7))


def test_a_write_starts_again_after_another(spark, tmp_path, monkeypatch):
    a, b = (Database(spark, str(tmp_path / "again")) for _ in range(2))
    a["x"].insert_many([{"_id": "1", "n": 1}, {"_id": "2", "n": 1}])
    commit, done = Database._commit, []

    def late(self, *args):
        if not done:
            done.append(1)
            b["x"].update({"_id": "2"}, {"$set": {"n": 10}})
            b["x"].insert({"_id": "3", "n": 5})
        return commit(self, *args)

    monkeypatch.setattr(Database, "_commit", late)
    assert a["x"].update_many({}, {"$inc": {"n": 1}}) == 3  # it counts what it changed in the end
    assert {r["_id"]: r["n"] for r in b["x"].find().collect()} == {"1": 2, "2": 11, "3": 6}
    assert sorted(v["version"] for v in a["x"].versions()) == [1, 2, 3, 4]


def test_a_lost_writer_leaves_a_whole_database(spark, tmp_path, monkeypatch):
    a = Database(spark, str(tmp_path / "lost"))
    a["x"].insert({"_id": "1"})
    publish = Database._publish
    monkeypatch.setattr(Database, "_publish", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        a["x"].insert({"_id": "2"})  # committed, but its changes aren't in the log yet
    monkeypatch.setattr(Database, "_publish", publish)
    b = Database(spark, a.path)
    assert b["x"].count() == 2
    b["x"].insert({"_id": "3"})
    assert [(r["seq"], r["key"]) for r in b.changes().collect()] == [(1, "1"), (2, "2"), (3, "3")]
    monkeypatch.setattr(Database, "_try", lambda self, n, c: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        a["x"].insert({"_id": "4"})
    monkeypatch.undo()
    assert Database(spark, a.path)["x"].count() == 3
    assert len(b["x"].versions()) == 3


def test_versions_are_committed_ones(spark, tmp_path):
    db = Database(spark, str(tmp_path / "versions"))
    db["x"].insert({"_id": "1"})
    with pytest.raises(ZeroDivisionError), db.transaction():
        db["x"].insert({"_id": "2"})
        raise ZeroDivisionError
    assert [v["version"] for v in db["x"].versions()] == [1]
    with pytest.raises(DatabaseError):
        db["x"].df(2)
    with db.transaction():
        db["x"].insert({"_id": "2"})
        db["x"].insert({"_id": "3"})
    assert db["x"].rollback(1) == 3
    assert [(r["op"], r["key"]) for r in db.changes(2).collect()][:2] == [("insert", "2"), ("insert", "3")]
    assert sorted((r["op"], r["key"]) for r in db.changes(4).collect()) == [("delete", "2"), ("delete", "3")]


def test_writes_leave_other_files_alone(spark, tmp_path):
    db = Database(spark, str(tmp_path / "files"))
    x = db["x"]
    for k in range(4):
        x.insert_many([{"_id": f"{k}{j}", "n": j} for j in range(3)])
    was = {p["folder"] for p in db._parts_of("x")}
    assert x.update({"_id": "21"}, {"$set": {"n": 99}}) == 1
    now = {p["folder"] for p in db._parts_of("x")}
    assert len(was & now) == 3 + (len(now) == 5)  # one file was written anew
    assert x.count() == 12
    assert x.delete({"_id": "00"}) == 1
    assert x.delete_many({"n": 1234}) == 0
    db["c"].insert({"_id": "a", "x": "nobody"})
    db.define_relation("r", "c", "x", "x", on_delete="cascade")
    before = db["c"].versions()
    assert x.delete({"_id": "01"}) == 1
    assert db["c"].versions() == before  # no child refers to it, so none is written
    assert x.compact() > 1
    assert (len(db._parts_of("x")), x.count()) == (1, 10)


def test_every_write_is_logged(spark, tmp_path):
    db = Database(spark, str(tmp_path / "logged"))
    db["p"].insert_many([{"_id": str(k), "n": k} for k in range(4)])
    db["c"].insert_many([{"_id": "a", "p": "1"}, {"_id": "b", "p": "2"}])
    db.define_relation("r", "c", "p", "p", on_delete="set_null")
    db["p"].delete({"_id": "1"})
    db["p"].aggregate([{"$match": {"n": {"$gt": 1}}}, {"$out": "o"}])
    db["p"].aggregate([{"$addFields": {"m": 7}}, {"$merge": {"into": "o", "whenMatched": "merge", "whenNotMatched": "insert"}}])
    rows = [(r["seq"], r["ns"], r["op"], r["key"]) for r in db.changes().collect()]
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert ("c", "update", "a") in {r[1:] for r in rows}
    assert sorted(r[1:] for r in rows if r[1] == "o") == [("o", "insert", "0"), ("o", "insert", "2"), ("o", "insert", "3"), ("o", "update", "2"), ("o", "update", "3")]
    seen = []
    db.create_trigger("u", "after", "update", "p", seen.append)
    db.create_trigger("d", "before", "delete", "p", seen.append)
    db["p"].update_many({"n": {"$gte": 2}}, {"$inc": {"n": 1}})
    db["p"].delete({"_id": "0"})
    assert sorted(map(str, seen)) == sorted(map(str, [{"_id": "2", "n": 3}, {"_id": "3", "n": 4}, {"_id": "0", "n": 0}]))
    assert db["p"].insert_many([{"_id": "s"}], session=("s", 3)) == Database(spark, db.path)["p"].insert_many([{"_id": "s"}], session=("s", 3))
    assert db["p"].count({"_id": "s"}) == 1
