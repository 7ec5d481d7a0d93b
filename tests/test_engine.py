"""Scenarios over the whole engine."""

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import Config, DimensionMismatch, NotFound, Provider, Validation
from palimpsest.functions.embed import Embedding, embed_text
from palimpsest.operators import keyword, lifecycle, ranking
from palimpsest.operators.knn import nearest, window_size
from palimpsest.plans.engine import Engine, Settings
from palimpsest.sources import snapshots
from palimpsest.streaming import ingest

TODAY = "2026-08-24"


def said(spark, *texts):
    return spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")


def test_add_search_update_delete(spark):
    e = Engine(spark)
    assert e.health_check()
    scope = {"user_id": "alice"}
    assert e.add(said(spark, "Bob Smith lives in Berlin. Rust is fun.", "Rust is fun."), scope).count() == 2  # repeats within a call are one
    assert e.add(said(spark, "Rust is fun."), scope).count() == 0
    assert e.add(said(spark, "Rust is fun."), {"user_id": "bob"}).count() == 1
    assert e.tables.links.count() == 1
    found = e.search("Rust", 5, scope, TODAY, explain=True).collect()
    by_content = {r["payload"]["content"]: r for r in found}
    assert by_content["Rust is fun."]["score_details"]["bm25_score"] is not None and by_content["Bob Smith lives in Berlin."]["score_details"]["bm25_score"] is None
    assert len(found) == 2 and found[0]["score"] == found[1]["score"]  # the nearer one lacks the word: a tie, in which the nearer one stays first
    assert found[0]["score_details"]["semantic_score"] < found[1]["score_details"]["semantic_score"]
    boosted = {r["payload"]["content"]: r for r in e.search("Tell me about Bob Smith", 5, scope, TODAY, explain=True, rerank=True).collect()}
    assert boosted["Bob Smith lives in Berlin."]["score_details"]["entity_boost"] == pytest.approx(0.15)
    plain = [r["id"] for r in e.search("Rust", 5, scope, TODAY).collect()]
    assert plain == [r["id"] for r in found]

    id_ = by_content["Rust is fun."]["id"]
    changed = lifecycle.update(e.tables, id_, "Go is fun.", {"topic": "go"})
    row = lifecycle.get(changed.memories, id_).first()
    assert row["content"] == "Go is fun." and row["payload"]["topic"] == "go" and row["payload"]["user_id"] == "alice"
    with pytest.raises(Validation):
        lifecycle.update(e.tables, id_, metadata={"user_id": "x"})
    with pytest.raises(NotFound):
        lifecycle.update(e.tables, "none")
    gone = lifecycle.delete(e.tables, id_)
    assert [r["event"] for r in lifecycle.history(gone, id_).collect()] == ["Added", "Deleted"]
    assert lifecycle.delete(e.tables, "none").memories.count() == 3
    left, n = lifecycle.reset(e.tables, scope)
    assert n == 3 and left.memories.count() == 1 and left.links.count() == 0
    assert {(r["entity_type"], r["entity_id"], r["memory_count"]) for r in lifecycle.list_entities(e.tables.memories).collect()} == {("user_id", "alice", 2), ("user_id", "bob", 1)}


def test_expiry_filters_and_checks(spark):
    e = Engine(spark)
    scope = {"user_id": "u"}
    e.add(said(spark, "old fact"), scope, metadata={"expiration_date": "2020-01-01", "k": "1"})
    e.add(said(spark, "new fact"), scope, metadata={"k": "2"})
    assert e.search("fact", 3, scope, TODAY).count() == 1
    assert e.search("fact", 3, scope, TODAY, show_expired=True).count() == 2
    assert e.search("fact", 3, scope, TODAY, show_expired=True, spec={"k": {"lt": 2}}).count() == 1
    assert lifecycle.list_memories(e.tables.memories, scope, TODAY).count() == 1
    for bad in ({"top_k": 0}, {"top_k": 1001}, {"scope": {"x": "y"}}, {"threshold": -1.0}):
        with pytest.raises(Validation):
            e.search(**{"query": "q", "top_k": 1, "scope": scope, "today": TODAY} | bad)
    with pytest.raises(Validation):
        lifecycle.add(e.tables, spark.createDataFrame([(0, " ")], "seq long, content string"), scope)
    with pytest.raises(Config):
        Settings(temperature=3).validate()
    assert [window_size(k) for k in (1, 10, 100)] == [500, 500, 2000]


def test_procedural_memory(spark):
    e = Engine(spark)
    e.add(said(spark, "step one"), {"agent_id": "a", "memory_type": "procedural_memory"})
    assert e.tables.memories.first()["content"] == "Conversation:\nUser: step one"
    e.summarise = lambda x: F.when(~x.contains("nothing"), F.concat(F.lit("Done by Ada Brandt: "), F.length(x).cast("string"))).otherwise("")
    for n in (2, 3):  # neither compared with what is known nor linked
        assert e.add(said(spark, "step one"), {"agent_id": "a", "memory_type": "procedural_memory"}).first()["content"] == "Done by Ada Brandt: 28"
        assert e.tables.memories.count() == n and e.tables.links.count() == 0
    assert e.tables.memories.select("id").distinct().count() == 3
    with pytest.raises(Validation):
        e.add(said(spark, "nothing"), {"agent_id": "a", "memory_type": "procedural_memory"})


def test_ids_stay_apart(spark):
    e, scope = Engine(spark), {"user_id": "u"}
    first = e.add(said(spark, "Tea is hot."), scope).first()["id"]
    e.update(first, "Tea is cold.")
    second = e.add(said(spark, "Tea is hot."), scope).first()["id"]
    e.update(second, "Tea is gone.")
    third = e.add(said(spark, "Tea is hot."), scope).first()["id"]
    assert len({first, second, third}) == 3 and e.tables.memories.count() == 3
    assert lifecycle.history(e.tables, first).count() == 1


def test_providers_serve_records_and_queries(spark):
    embedding = Embedding(lambda t: [float(len(t)), 0.0], lambda c: F.array(F.length(c).cast("float"), F.lit(0).cast("float")), 2)
    with pytest.raises(Config):
        Engine(spark, embedding=embedding)
    e = Engine(spark, Settings(dimension=2), embedding=embedding, extract=lambda c: F.split(c, ";"))
    e.add(said(spark, "aa;bbbb"), {"user_id": "u"})
    assert {tuple(r["vector"]) for r in e.tables.memories.collect()} == {(2.0, 0.0), (4.0, 0.0)}
    assert e.search("zzzz", 1, {"user_id": "u"}, TODAY).first()["payload"]["content"] == "bbbb"
    raw = e.add(spark.createDataFrame([(0, 0, "assistant", "hello", [b"x"]), (0, 1, "user", "hi", [])], "conv_id long, turn long, role string, text string, images array<binary>").drop("images"), {"user_id": "v"}, infer=False)
    assert {(r["content"], r["payload"]["role"]) for r in raw.collect()} == {("hello", "assistant"), ("hi", "user")}
    pictured = spark.createDataFrame([(0, 0, "user", "see", [b"x"]), (0, 1, "user", "plain", [])], "conv_id long, turn long, role string, text string, images array<binary>")
    with pytest.raises(Provider):
        e.add(pictured, {"user_id": "w"}, infer=False)
    e.describe = lambda images: F.concat(F.lit("images: "), F.size(images).cast("string"))
    assert {r["content"] for r in e.add(pictured, {"user_id": "w"}, infer=False).collect()} == {"images: 1", "plain"}


def test_store_operations(spark):
    store = snapshots.MemoryStore(spark, 2)
    rows = lambda *r: spark.createDataFrame(r, "id string, vector array<float>, payload map<string,string>")
    store.insert(rows(("a", [1.0, 0.0], {"content": "red tea"}), ("b", [0.0, 1.0], {"content": "blue sea"})))
    store.insert(rows(("b", [3.0, 1.0], {"content": "green sea"})))
    assert [(r["id"], r["content"]) for r in store.list().collect()] == [("a", "red tea"), ("b", "green sea")]
    assert [r["id"] for r in store.search([3.0, 1.0], 1).collect()] == ["b"] and [r["id"] for r in store.keyword_search("tea", 5).collect()] == ["a"]
    for bad in (rows(("c", [1.0], {})), rows(("c", None, {}))):
        with pytest.raises(DimensionMismatch):
            store.insert(bad)
    with pytest.raises(DimensionMismatch):
        store.search([1.0], 1)
    with pytest.raises(NotFound):
        store.update(rows(("zz", [1.0, 1.0], {})))
    store.update(rows(("a", [9.0, 9.0], {"content": "tea"})))
    assert store.get("a").first()["vector"] == [9.0, 9.0]
    store.delete("a")
    assert [r["id"] for r in store.list().collect()] == ["b"]
    store.reset()
    assert store.list().count() == 0


def test_batch_search_is_each_search(spark):
    e, scope = Engine(spark), {"user_id": "u"}
    e.add(said(spark, *(f"Ada Brandt keeps {n} in the {p}" for n in ("tea", "milk", "bread") for p in ("kitchen", "cellar")), "Ove Lind sleeps", "tea tea milk"), scope, infer=False)
    e.add(said(spark, "old tea"), scope, infer=False, metadata={"expiration_date": "2020-01-01"})
    asked = [(1, "where is the tea"), (2, "Ada Brandt"), (3, "zzz"), (4, "Ove Lind and milk")]
    got = e.search_each(spark.createDataFrame(asked, "query_id int, query string"), 4, scope, TODAY).collect()
    for i, q in asked:
        own = [(r["id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        want = [(r["id"], r["score"]) for r in e.search(q, 4, scope, TODAY).collect()]
        assert [x for x, _ in own] == [x for x, _ in want] and [x for _, x in own] == pytest.approx([x for _, x in want])


def test_search_against_brute_force(spark, sf):
    """The flagship's steps in plain Python over all rows of the smallest tables."""
    import math
    import re

    from palimpsest import queries
    from palimpsest.functions.embed import embed_text

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND text <> ''").select("doc_id", "text").collect()
    every = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''").select("text").collect()]
    query = "licensed under the general public license"
    tokens = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    qv, terms = embed_text(query), list(dict.fromkeys(tokens(query)))
    near = sorted((sum(abs(a - b) for a, b in zip(embed_text(r["text"]), qv, strict=True)), r["doc_id"]) for r in docs)[:500]
    bags = [tokens(t) for t in every]
    average, df = sum(map(len, bags)) / len(bags), {t: sum(t in b for b in bags) for t in terms}

    def bm25(b):
        idf = {t: x if (x := math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5))) > 0 else 1e-6 for t in terms}
        return -sum(idf[t] * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / average)) for t in terms)

    hits = dict(sorted(((r["doc_id"], bm25(b)) for r in docs if set(b := tokens(r["text"])) & set(terms)), key=lambda x: (x[1], x[0]))[:500])
    unit = lambda x, lo, hi: (x - lo) / (hi - lo) if hi > lo else 0.0
    scores = {i: (unit(d, near[0][0], near[-1][0]) + (unit(hits[i], min(hits.values()), max(hits.values())) if i in hits else 1.0)) / 2 for d, i in near}
    best = sorted(scores, key=lambda i: (scores[i], i))[:10]
    bag = {r["doc_id"]: set(tokens(r["text"])) for r in docs}
    top = [scores[i] for i in best]
    final = sorted(((unit(scores[i], top[0], top[-1]) + 1 - len(bag[i] & set(terms)) / len(terms)) / 2, i) for i in best)
    got = [(r["score"], int(r["id"][4:])) for r in queries.flagship(spark, sf).collect()]
    assert [i for _, i in got] == [i for _, i in final] and [s for s, _ in got] == pytest.approx([s for s, _ in final], abs=1e-5)


def test_store_contract(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [5.0, 5.0]), ("far", [50.0, 50.0])], "id string, vector array<float>")
    assert [r["id"] for r in nearest(rows, [1.1, 0.0], 2).collect()] == ["a", "b"]
    assert [r["id"] for r in nearest(rows, [1.0, 0.0], 9, threshold=1.0).collect()] == ["a"]
    assert nearest(rows.limit(0), [1.0, 0.0], 9).count() == 0


def test_fusion_and_rerank(spark):
    c = spark.createDataFrame([("a", 100.0), ("b", 150.0), ("c", 200.0)], "id string, score float")
    k = spark.createDataFrame([("a", -1.0), ("b", -10.0), ("c", -3.0)], "id string, keyword_score double")
    assert ranking.fuse(c, k).orderBy("score").first()["id"] == "b"
    assert {r["score"] for r in ranking.fuse(c, k.limit(0)).collect()} == {100.0, 150.0, 200.0}
    tie = spark.createDataFrame([("a", 1.0, "cooking pasta recipes"), ("b", 1.0, "I love rust programming")], "id string, score float, content string")
    assert ranking.overlap_reranker(tie, "rust programming").orderBy("score").first()["id"] == "b"
    assert ranking.boost(c, c.where("id = 'c'").select("id")).where("id = 'c'").first()["score"] == pytest.approx(170.0)
    docs = spark.createDataFrame([("w", "rust is mentioned once here"), ("s", "rust rust rust programming in rust"), ("n", None)], "id string, content string")
    assert [r["id"] for r in keyword.search(docs, "rust").orderBy("keyword_score").collect()] == ["s", "w"]
    assert keyword.search(docs, " ").count() == 0
    index = keyword.token_table(docs)
    each = keyword.search_each(index, spark.createDataFrame([(1, "rust")], "query_id int, term string"), 3, 11 / 3).orderBy("keyword_score").collect()
    assert [r["id"] for r in each] == ["s", "w"]
    single = {r["id"]: r["keyword_score"] for r in keyword.search(docs, "rust").collect()}
    assert all(abs(single[r["id"]] - r["keyword_score"]) < 1e-9 for r in each)


def test_snapshots(spark, tmp_path):
    e = Engine(spark)
    e.add(said(spark, "Bob Smith lives here."), {"user_id": "u"})
    store = snapshots.ParquetStore(spark, f"file://{tmp_path}/store")
    assert store.load().memories.count() == 0
    store.save(e.tables)
    store.save(store.load())
    again = store.load()
    assert again.memories.first()["content"] == "Bob Smith lives here." and again.links.count() == 1
    e.add(said(spark, *(f"fact {i}" for i in range(40))), {"user_id": "u"}, infer=False)
    for files in (1, 5):
        json = snapshots.JsonStore(spark, f"file://{tmp_path}/json{files}", files)
        assert json.load().memories.count() == 0
        json.save(e.tables)
        back = json.load()
        key = lambda r: r["id"]
        assert sorted(back.memories.collect(), key=key) == sorted(e.tables.memories.collect(), key=key) and back.memories.count() == 41
        assert back.history.count() == 41 and back.links.count() == 1
    (tmp_path / "bad.json").write_text('[{"id": "a", ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        snapshots.load_json(spark, f"file://{tmp_path}/bad.json").collect()
    assert snapshots.load_json(spark, f"file://{tmp_path}/bad.json", lenient=True).count() == 0
    assert snapshots.load_json(spark, f"file://{tmp_path}/none").count() == 0
    out = snapshots.export_history(e.tables.history).first()
    (tmp_path / "history.json").write_text(f'{{"{out["id"]}": {out["entries"]}}}')
    assert snapshots.import_history(spark, f"file://{tmp_path}/history.json").first()["event"] == "Added"
    log = e.tables.history.unionByName(spark.createDataFrame([('odd "id" é', 0, "Added", 'a "quoted"\nline'), ('odd "id" é', 1, "Deleted", "x")], "id string, seq bigint, event string, content string"))
    for files in (1, 4):
        snapshots.save_history(log, f"file://{tmp_path}/log{files}", files)
        again = snapshots.import_history(spark, f"file://{tmp_path}/log{files}")
        assert sorted((r["id"], r["event"], r["content"]) for r in again.collect()) == sorted((r["id"], r["event"], r["content"]) for r in log.collect())
        assert [r["seq"] for r in again.where("id LIKE 'odd%'").orderBy("seq").collect()] == [0, 1]
    text_rows = spark.createDataFrame([("a", "[1.0, 2.0]", '{"user_id": "u"}')], "id string, vector string, payload string")
    assert snapshots.load_text_layout(text_rows).first()["vector"] == [1.0, 2.0]


def test_streamed_ingest(spark, tmp_path):
    said(spark, "A fact from a stream.").write.parquet(f"{tmp_path}/in")
    e = Engine(spark)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{tmp_path}/in")
    got = []
    ingest.ingest(stream, lambda batch: got.append([r["content"] for r in e.add(batch, {"user_id": "u"}).collect()]), f"{tmp_path}/check").awaitTermination()
    assert got == [["A fact from a stream."]]
    events = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "u int, s string, o int")
    assert ingest.session_gate(events, "u", "s", "o", 2).first()["due"]
    assert [r["o"] for r in ingest.last_requests(events, "o", 2).select(F.col("o")).collect()] == [2, 3]


def test_ties_keep_the_order_before(spark):
    e, scope = Engine(spark), {"user_id": "u"}
    e.add(said(spark, *(f"same words {i}" for i in range(6))), scope, infer=False)
    flat = lambda results, query: results.withColumn("score", F.lit(0.5).cast("float"))
    e.reranker = flat
    before = [r["id"] for r in e.search("same", 6, scope, TODAY).collect()]
    assert [r["id"] for r in e.search("same", 6, scope, TODAY, rerank=True).collect()] == before


def test_entities_take_window_slots(spark, monkeypatch):
    from palimpsest.plans import engine

    monkeypatch.setattr(engine, "window_size", lambda k: 4)
    e, scope = Engine(spark), {"user_id": "u"}
    names = ["Ada Brandt", "Ove Lind", "Bo Ek", "Eva Holm", "Ulf Dahl"]
    e.add(said(spark, *(f"{n} is here" for n in names)), scope, infer=False)
    query = "Ada Brandt"  # the entity itself is nearest, at distance 0
    plain, slots = e.search(query, 4, scope, TODAY).count(), e.search(query, 4, scope, TODAY, entity_slots=True).count()
    vectors = [(embed_text(n), False) for n in names] + [(embed_text(f"{n} is here"), True) for n in names]
    nearest_four = sorted(vectors, key=lambda v: sum(abs(a - b) for a, b in zip(v[0], embed_text(query), strict=True)))[:4]
    assert plain == 4 and slots == sum(is_memory for _, is_memory in nearest_four) < 4


def test_numbering_and_marks(spark):
    from palimpsest.functions import text

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert sorted((r["v"], r["pos"]) for r in ranking.numbered(rows, F.desc("v")).collect()) == [(v, 499 - v) for v in range(500)]
    cut = spark.createDataFrame([("Ada Brandt\x01Ove Lind met Bo Ek",)], "t string").select(text.proper_spans(F.col("t")).alias("s")).first()["s"]
    assert cut == ["Bo Ek"]  # the sign within a word ends both runs


def test_batch_search_of_registered_query(spark, sf):
    """Some of its questions, each asked alone."""
    from palimpsest import queries
    from palimpsest.operators import entities

    got = queries.search_batch(spark, sf).collect()
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text <> ''")
    asked = {r["conv_id"]: r["text"][:60] for r in c.where("turn = 0 AND conv_id % 50 = 0").collect()}
    assert asked and {r["query_id"] for r in got} == set(asked)
    payload = F.create_map(F.lit("user_id"), F.lit("u"), F.lit("agent_id"), F.col("role"), F.lit("content"), F.col("text"))
    from palimpsest.functions.embed import hash_embedding
    from palimpsest.schema import promote

    rows = promote(c.select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), hash_embedding(F.col("text")).alias("vector"), payload.alias("payload"))).cache()
    e = Engine(spark, tables=lifecycle.Tables(rows, None, entities.links(rows.withColumn("seq", F.lit(0).cast("long"))).cache()))
    q = min(asked)
    own = [(r["id"], round(r["score"], 4)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
    assert sorted(own) == sorted((r["id"], round(r["score"], 4)) for r in e.search(asked[q], 5, {"user_id": "u"}, TODAY).collect())


def test_keyword_batch_moves_the_best_only(spark, monkeypatch):
    """The k best of each question in many blocks, as the scan of each finds them, without a row for each posting and question."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"id{i:03}", " ".join(r.choice(words[: r.randrange(1, 31)]) for _ in range(r.randrange(0, 12)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id string, content string").cache()
    asked = [(q, w) for q in range(8) for w in r.sample(words, 4)] + [(9, "absent")]
    queries = spark.createDataFrame(asked, "query_id int, term string")
    average = sum(len(t.split()) for _, t in rows) / 300
    monkeypatch.setattr(keyword, "BLOCK_TOKENS", 100)
    within = docs.where("id >= 'id100'")
    for index in (keyword.token_lists(docs), keyword.token_table(docs)):
        found = keyword.search_each(index, queries, 300, average, 7, within)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroups" in plan
        found = found.collect()
        for q in range(8):
            alone = keyword.search(docs, " ".join(w for p, w in asked if p == q)).where("id >= 'id100'").orderBy("keyword_score", "id").limit(7).collect()
            got = sorted((round(x["keyword_score"], 9), x["id"]) for x in found if x["query_id"] == q)
            assert got[:7] == [(round(x["keyword_score"], 9), x["id"]) for x in alone]
        assert len(found) <= 8 * 14 and not [x for x in found if x["query_id"] == 9]
