"""Token buckets in a batch and in a stream against a plain loop."""

import datetime
import random

import pytest

from palimpsest.operators import entities
from palimpsest.streaming.rate_limit import limit_stream, limited

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def requests(n=600):
    pick, at, out = random.Random(4), {}, []
    for i in range(n):
        user = pick.choice([1, 1, 1, 2, 3, None])
        at[user] = at.get(user, 0) + pick.choice([0] * 8 + [50_000] * 8 + [150_000] * 4 + [400_000, 5_000_000])
        out.append((user, i, START + datetime.timedelta(microseconds=at[user])))
    return out


def brute(rows, capacity, refill):
    level, last, out = {}, {}, {}
    for user, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        now = level.get(user, capacity)
        if user in last:
            now = min(capacity, now + (at - last[user]).total_seconds() * refill)
        last[user] = at
        out[i] = (now >= 1, now - 1 if now >= 1 else now)
        level[user] = out[i][1]
    return out


@pytest.mark.parametrize(("capacity", "refill"), [(20.0, 5.0), (3.0, 1.0)])
def test_batch(spark, capacity, refill):
    rows = requests()
    df = spark.createDataFrame([*rows, (1, 9999, None)], "user_id int, event_id int, ts timestamp").repartition(5)
    got = {r["event_id"]: (r["allowed"], r["tokens"]) for r in limited(df, capacity=capacity, refill=refill).collect()}
    assert got.pop(9999) == (False, None)
    want = brute(rows, capacity, refill)
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in want.items()} and len({a for a, _ in want.values()}) == 2
    assert all(t == pytest.approx(want[i][1]) for i, (_, t) in got.items())
    assert limited(df.limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [r for r in requests(120) if r[0] is not None]
    schema = "user_id int, event_id int, ts timestamp"
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (sorted(rows, key=lambda r: r[2])[:50], sorted(rows, key=lambda r: r[2])[50:]):  # two runs, so that the state is read again
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = limit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), capacity=3.0, refill=1.0)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = {r["event_id"]: (r["allowed"], pytest.approx(r["tokens"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r["event_id"]: (r["allowed"], r["tokens"]) for r in limited(spark.createDataFrame(rows, schema), capacity=3.0, refill=1.0).collect()}
    assert {i: x for i, x in batch.items()} == got


def test_entity_lists_grow_in_order(spark):
    link = lambda *rows: spark.createDataFrame([("u", None, None, "proper", text, id_, seq) for text, id_, seq in rows], "user_id string, agent_id string, run_id string, entity_type string, entity_text string, id string, seq long")
    none = lambda schema: spark.createDataFrame([], schema)
    known, members = none(entities.ENTITIES), none(entities.MEMBERS)
    for n, rows in enumerate(([("Ada Brandt", "m9", 5), ("Ada Brandt", "m3", 7), ("Ada Brandt", "m9", 9), ("Ove Lind", "m1", 0)], [("Ada Brandt", "m3", 0), ("Ada Brandt", "m0", 1), ("Bo Ek", "m0", 1)])):
        new, added = entities.upsert(known, members, link(*rows), n)
        assert new.count() == (2 if n == 0 else 1)
        known, members = known.unionByName(new), members.unionByName(added)
    names = {r["entity_id"]: r["entity_text"] for r in known.collect()}
    assert len(names) == 3 and known.where("size(vector) = 8").count() == 3
    lists = {names[r["entity_id"]]: r["ids"] for r in entities.linked_lists(members).collect()}
    assert lists == {"Ada Brandt": ["m9", "m3", "m0"], "Ove Lind": ["m1"], "Bo Ek": ["m0"]}
    pieces = sorted((r["piece"], r["ids"]) for r in entities.linked_lists(members, 2).where("entity_id = '" + next(i for i, t in names.items() if t == "Ada Brandt") + "'").collect())
    assert pieces == [(0, ["m9", "m3"]), (1, ["m0"])]
