"""Stores and indexes that are kept up change by change, against plain scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import Conflict
from palimpsest.operators import keyword, lifecycle
from palimpsest.sources.keyword_index import KeywordIndex
from palimpsest.sources.log_store import LogStore

TODAY = "2026-08-24"


def facts(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "seq long, content string")


def contents(store):
    return sorted(r["content"] for r in store.load().memories.collect())


def test_log_store_appends_and_merges(spark, tmp_path):
    store, scope = LogStore(spark, f"file://{tmp_path}/log"), {"user_id": "u"}
    empty = store.load()
    assert (empty.version, empty.events, empty.memories.count()) == (0, 0, 0)
    store.append(lifecycle.addition(empty, facts(spark, "Bob Smith has tea.", "Milk is white."), scope), 0)
    one = store.load()
    assert one.version == 1 and one.events == 2 == one.history.count() and one.links.count() == 1
    store.append(lifecycle.addition(one, facts(spark, "Milk is white.", "Bread is brown."), scope), 1)  # the first is known
    assert contents(store) == ["Bob Smith has tea.", "Bread is brown.", "Milk is white."]
    two = store.load()
    id_ = {r["content"]: r["id"] for r in two.memories.collect()}
    store.append(lifecycle.updating(two, id_["Milk is white."], "Milk is cold.", {"k": "1"}), 2)
    store.append(lifecycle.deletion(store.load(), id_["Bread is brown."]), 3)
    now = store.load()
    assert contents(store) == ["Bob Smith has tea.", "Milk is cold."] and now.events == 4
    assert [r["event"] for r in lifecycle.history(now, id_["Bread is brown."]).collect()] == ["Added", "Deleted"]
    assert {(r["id"], r["payload"].get("k")) for r in now.memories.collect()} == {(id_["Bob Smith has tea."], None), (id_["Milk is white."], "1")}
    assert store.load(2).memories.count() == 3  # an earlier version is still there

    before = sorted(map(repr, now.memories.collect())), sorted(map(repr, now.history.collect())), sorted(map(repr, now.links.collect()))
    assert store.compact(5) is None and store.compact() == 5
    after = store.load()
    assert before == (sorted(map(repr, after.memories.collect())), sorted(map(repr, after.history.collect())), sorted(map(repr, after.links.collect()))) and after.events == 4
    store.append(lifecycle.addition(after, facts(spark, "Bread is brown."), scope), 5)
    again = {r["content"]: r["id"] for r in store.load().memories.collect()}
    assert again["Bread is brown."] != id_["Bread is brown."]  # an id isn't given twice
    store.append(lifecycle.resetting(store.load(), scope), 6)
    end = store.load()
    assert end.memories.count() == 0 and end.links.count() == 0 and end.events == 8
    store.append(lifecycle.addition(end, facts(spark, "Bob Smith is back."), scope), 7)
    assert store.load().links.count() == 1  # links after a reset count


def test_an_append_writes_its_rows_only(spark, tmp_path):
    store, scope = LogStore(spark, f"file://{tmp_path}/log"), {"user_id": "u"}
    store.append(lifecycle.addition(store.load(), facts(spark, *(f"fact {i}" for i in range(500))), scope), 0)
    seen = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    store.append(lifecycle.addition(store.load(), facts(spark, "one more"), scope), 1)
    new = [p for p in (tmp_path / "log").rglob("*.parquet") if p not in seen]
    assert all(p.stat().st_mtime_ns == t for p, t in seen.items())
    assert sum(spark.read.parquet(f"file://{p}").count() for p in new) == 2  # a memory and its entry


def test_two_writers(spark, tmp_path):
    """Changes that don't meet both stand; those that do make the later one fail, and neither is lost."""
    path, scope = f"file://{tmp_path}/log", {"user_id": "u"}
    a, b = LogStore(spark, path), LogStore(spark, path)
    a.append(lifecycle.addition(a.load(), facts(spark, "first", "second"), scope), 0)
    ids = {r["content"]: r["id"] for r in a.load().memories.collect()}
    seen_a, seen_b = a.load(), b.load()
    a.append(lifecycle.updating(seen_a, ids["first"], "first changed"), seen_a.version)
    assert b.append(lifecycle.updating(seen_b, ids["second"], "second changed"), seen_b.version) == 3
    assert contents(a) == ["first changed", "second changed"]
    seen_a, seen_b = a.load(), b.load()
    a.append(lifecycle.deletion(seen_a, ids["first"]), seen_a.version)
    with pytest.raises(Conflict):
        b.append(lifecycle.updating(seen_b, ids["first"], "lost?"), seen_b.version)
    seen_a, seen_b = a.load(), b.load()
    a.append(lifecycle.addition(seen_a, facts(spark, "third"), scope), seen_a.version)
    with pytest.raises(Conflict):  # "third" might be in both
        b.append(lifecycle.addition(seen_b, facts(spark, "third"), scope), seen_b.version)
    assert b.append(lifecycle.addition(seen_b, facts(spark, "third"), {"user_id": "v"}), seen_b.version)
    assert contents(a) == ["second changed", "third", "third"]
    seen_b = b.load()
    a.compact()
    assert b.append(lifecycle.updating(seen_b, ids["second"], "after a compaction"), seen_b.version)
    assert "after a compaction" in contents(a)
    with pytest.raises(Conflict):  # a replacement on an old version
        b.save(seen_b)


def test_a_batch_is_applied_once(spark, tmp_path):
    store, scope = LogStore(spark, f"file://{tmp_path}/log"), {"agent_id": "a"}
    change = lambda: lifecycle.addition(store.load(), facts(spark, "a procedure"), scope, plain=True)
    assert store.append(change(), store.load().version, ("s", 0)) == 1
    assert store.append(change(), store.load().version, ("s", 0)) is None
    assert store.append(change(), store.load().version, ("other", 0)) == 2
    store.compact()
    assert store.append(change(), store.load().version, ("s", 0)) is None and store.applied("s") == 0 and store.applied("none") == -1
    assert store.append(change(), store.load().version, ("s", 1)) == 4 and store.load().memories.count() == 3


def texts_of(n, seed=5):
    pick = random.Random(seed)
    common, rare = ["tea", "milk", "the", "of"], [f"rare{i}" for i in range(60)]
    return [" ".join(pick.choice(common if pick.random() < 0.8 else rare) for _ in range(pick.randrange(1, 60))) for _ in range(n)]


def by_scan(docs, query, k, where="true", require_all=False):
    rows = keyword.search(docs, query, require_all=require_all).where(where).orderBy("keyword_score", "id").limit(k).collect()
    return [(r["id"], r["keyword_score"]) for r in rows]


def test_keyword_index_equals_the_scan(spark, tmp_path):
    rows = [(f"d{i:04}", t if i % 17 else None, f"u{i % 3}") for i, t in enumerate(texts_of(600))]
    schema = "id string, content string, user_id string"
    docs = spark.createDataFrame(rows, schema)
    index = KeywordIndex.create(spark, f"file://{tmp_path}/index", docs, keep=["user_id"], blocks=90, buckets=4)
    got = lambda *a, **k: [(r["id"], r["keyword_score"]) for r in index.top_k(*a, **k).collect()]
    def check(docs):
        assert got("the rare7 absent", 10) == by_scan(docs, "the rare7 absent", 10)
        assert got("Tea, MILK; the of rare3", 10, {"user_id": "u1"}) == by_scan(docs, "Tea, MILK; the of rare3", 10, "user_id = 'u1'")

    check(docs)
    assert got("rare1 rare2 of", 700) == by_scan(docs, "rare1 rare2 of", 700)
    assert got("tea rare5", 10, require_all=True) == by_scan(docs, "tea rare5", 10, require_all=True)
    assert got("absent", 5) == got("", 5) == []
    got("the rare7", 3)
    assert 0 < index.blocks_read < index.blocks_of_last  # blocks of common words alone are left out

    new = [(f"d{i:04}", t, "u1") for i, t in zip([*range(0, 300, 7), *range(900, 950)], texts_of(93, 6), strict=True)]
    touched = {r[0] for r in new} | {f"d{i:04}" for i in range(3, 600, 50)}
    old = [r for r in rows if r[0] in touched]
    index.update(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    now = spark.createDataFrame([r for r in rows if r[0] not in touched] + new, schema)
    check(now)
    index.update(gone=spark.createDataFrame(new[:20], schema))
    now = now.where(~F.col("id").isin([r[0] for r in new[:20]]))
    check(now)
    index.compact()
    check(now)
    assert KeywordIndex(spark, f"file://{tmp_path}/index").top_k("tea", 5).count() == 5


def test_keyword_index_reads_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(200))], "id long, content string")
    index = KeywordIndex.create(spark, f"file://{tmp_path}/index", docs, buckets=8)
    plan = index._postings(index._state(), ["tea"]).select("block", "most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "term" in plan.split("PushedFilters")[1] and "positions" not in plan.split("ReadSchema")[1]
    empty = KeywordIndex.create(spark, f"file://{tmp_path}/none", docs.limit(0))
    assert empty.top_k("tea", 3).count() == 0 and empty.cover_density("tea", 3).count() == 0


def brute_covers(text, terms):
    """Over all intervals of the text."""
    words = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    has = lambda a, b: set(terms) <= set(words[a : b + 1])
    covers = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if has(a, b) and not (b > a and (has(a + 1, b) or has(a, b - 1)))]
    return -sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in covers) if covers else None


def test_cover_density(spark, tmp_path):
    rows = [(i, t if i % 13 else None) for i, t in enumerate(texts_of(150, 9))] + [(999, "milk milk tea x tea y z milk"), (1000, "")]
    docs = spark.createDataFrame(rows, "id long, content string")
    index = KeywordIndex.create(spark, f"file://{tmp_path}/index", docs, blocks=20, buckets=3)
    for query in ("tea milk", "milk", "the of rare1 tea"):
        terms = keyword.query_terms(query)
        want = sorted(((s, i) for i, t in rows if (s := brute_covers(t, terms)) is not None))
        for found in (index.cover_density(query, 500), keyword.search_covers(docs, query).orderBy("keyword_score", "id")):
            got = [(r["keyword_score"], r["id"]) for r in found.collect()]
            assert sorted(i for _, i in got) == sorted(i for _, i in want) and [s for s, _ in got] == pytest.approx([s for s, _ in want])
    assert keyword.search_covers(docs, "").count() == 0


def said(spark, *texts):
    return spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")


def test_engine_over_a_store_with_indexes(spark, tmp_path):
    """The same answers as an engine that scans, after every kind of change."""
    from palimpsest.plans.engine import Engine

    kept, plain = Engine(spark, store=LogStore(spark, f"file://{tmp_path}/log")), Engine(spark)
    scope = {"user_id": "u"}
    first = said(spark, "Rust is fun. Bob Smith likes tea.", *(f"Tea of kind {i} is {'green' if i % 2 else 'black'}." for i in range(30)))
    for e in (kept, plain):
        e.add(first, scope)
        e.add(said(spark, "Tea of another user."), {"user_id": "v"})
    kept.index(f"file://{tmp_path}/indexes")

    def same():
        got, want = ([(r["payload"]["content"], round(r["score"], 5)) for r in e.search("Does Bob Smith like black tea", 5, scope, TODAY).collect()] for e in (kept, plain))
        assert sorted(got) == sorted(want)

    same()
    for e in (kept, plain):
        ids = {r["content"]: r["id"] for r in e.tables.memories.collect()}
        e.update(ids["Tea of kind 3 is green."], "Tea of kind 3 is black tea.")
        e.delete(ids["Tea of kind 4 is black."])
        e.add(said(spark, "Black tea with milk."), scope)
    kept.tables = kept.store.load()
    same()
    assert kept.keywords.source == kept.vectors.source == kept.tables.version
    assert kept.reset({"user_id": "v"}) == plain.reset({"user_id": "v"}) == 1
    kept.refresh()
    assert kept.keywords.source == kept.tables.version and kept.keywords.top_k("another", 5).count() == 0


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """A stream dies after its batch was stored and before Spark noted it; on restart the batch comes again."""
    from palimpsest.plans.engine import Engine
    from palimpsest.streaming import ingest

    said(spark, "Step one.").write.parquet(f"{tmp_path}/in")
    path, scope = f"file://{tmp_path}/log", {"agent_id": "a", "memory_type": "procedural_memory"}
    stream = lambda: spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{tmp_path}/in")

    class Dies(Engine):
        def add(self, *args, **kwargs):
            super().add(*args, **kwargs)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.ingest_once(stream(), Dies(spark, store=LogStore(spark, path)), scope, "s", f"{tmp_path}/check").awaitTermination()
    store = LogStore(spark, path)
    assert store.load().memories.count() == 1 and store.applied("s") == 0
    ingest.ingest_once(stream(), Engine(spark, store=LogStore(spark, path)), scope, "s", f"{tmp_path}/check").awaitTermination()
    assert store.load().memories.count() == 1 and store.load().history.count() == 1
    said(spark, "Step two.").write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_once(stream(), Engine(spark, store=LogStore(spark, path)), scope, "s", f"{tmp_path}/check").awaitTermination()
    assert store.load().memories.count() == 2 and store.applied("s") == 1


def test_blocks_of_a_keyword_index_are_bounded(spark, tmp_path):
    """A block is some documents that lie together, not what a hash deals to it; a document's words are in one."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(200))], "id long, content string").coalesce(2)
    index = KeywordIndex.create(spark, f"file://{tmp_path}/index", docs, blocks=20, buckets=2)
    placed = index._postings(index._state()).select("block", F.explode("postings.id").alias("id")).distinct().collect()
    assert len({r["id"] for r in placed}) == len(placed) == 200
    blocks = [r["block"] for r in placed]
    assert max(map(blocks.count, blocks)) <= 10
