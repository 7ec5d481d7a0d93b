"""The SQL store over the database that ships with Spark, and its other dialect over SQLite."""

import sqlite3
import uuid

import pytest

from palimpsest.errors import Config, DimensionMismatch, NotFound
from palimpsest.sources.sql_store import SqlStore, upsert_sql


def test_round_trip(spark):
    store = SqlStore(spark, f"jdbc:derby:memory:s{uuid.uuid4().hex};create=true", "memories", 2)
    rows = lambda *r: spark.createDataFrame(r, "id string, vector array<float>, payload map<string,string>")
    store.create()
    store.create()
    assert store.load().count() == 0
    assert store.insert(rows(*((f"r{i}", [float(i), 0.5], {"user_id": "u", "content": f"it's \"{i}\" é"}) for i in range(60)))) == 60
    assert store.insert(rows(("r3", [9.0, 9.0], {"user_id": "v"}), ("new'", [1.0, 1.0], None))) == 2
    every = {r["id"]: (r["vector"], r["payload"], r["user_id"]) for r in store.load(4).collect()}
    assert len(every) == 61 and every["r3"] == ([9.0, 9.0], {"user_id": "v"}, "v") and every["r7"][1]["content"] == 'it\'s "7" é' and every["new'"][1] == {}
    assert store.load(4).rdd.getNumPartitions() == 4
    assert [r["vector"] for r in store.get("new'").collect()] == [[1.0, 1.0]] and store.get("none").count() == 0
    with pytest.raises(DimensionMismatch):
        store.insert(rows(("r1", [1.0], {})))
    with pytest.raises(NotFound):
        store.update(rows(("r1", [1.0, 2.0], {}), ("unknown", [1.0, 2.0], {})))
    assert store.get("r1").first()["vector"] == [1.0, 0.5]
    assert store.update(rows(("r1", [1.0, 2.0], {}))) == 1 and store.get("r1").first()["vector"] == [1.0, 2.0]
    assert store.delete(rows(("r1", None, None), ("r2", None, None), ("none", None, None))) == 2 and store.load().count() == 59
    assert store.reset() == 59 and store.load().count() == 0
    with pytest.raises(Config):
        SqlStore(spark, "jdbc:derby:memory:x", "bad name", 2)


def test_a_failed_change_leaves_nothing(spark):
    store = SqlStore(spark, f"jdbc:derby:memory:s{uuid.uuid4().hex};create=true", "memories", 1)
    store.create()
    rows = spark.createDataFrame([("a", [1.0], {}), ("b", [2.0], {})], "id string, vector array<float>, payload map<string,string>")
    store.insert(rows)

    def fails(link, staged):
        store._run(link, "DELETE FROM memories")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store._staged(rows.select("id"), fails)
    assert store.load().count() == 2
    assert store._connected(lambda link: [n for n in ("memories",) if store._has(link, n)]) == ["memories"]


@pytest.mark.parametrize("dialect", ["replace", "conflict"])
def test_dialects(dialect):
    db = sqlite3.connect(":memory:")
    for name in ("t", "s"):
        db.execute(f'CREATE TABLE {name} ("id" TEXT PRIMARY KEY, "bucket" INTEGER, "vector" TEXT, "payload" TEXT)')
    db.execute("INSERT INTO t VALUES ('a', 1, '[1]', '{}'), ('b', 1, '[1]', '{}')")
    db.execute("INSERT INTO s VALUES ('b', 2, '[2]', '{}'), ('c', 3, '[3]', '{}')")
    for statement in upsert_sql(dialect, "t", "s"):
        db.execute(statement)
    assert sorted(db.execute('SELECT "id", "bucket", "vector" FROM t')) == [("a", 1, "[1]"), ("b", 2, "[2]"), ("c", 3, "[3]")]
    with pytest.raises(Config):
        upsert_sql("other", "t", "s")
