"""Providers and remote stores against servers that answer as theirs do, in this process."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import Config
from palimpsest.functions import providers
from palimpsest.sources import remote


class Server:
    """``answer(method, path, body)`` gives a status and a JSON value; ``calls`` has what was asked."""

    def __init__(self, answer):
        self.calls = calls = []
        lock = threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def _do(self):
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
                with lock:
                    calls.append((self.command, self.path, body))
                    status, value = answer(self.command, self.path, body)
                data = json.dumps(value).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = _do

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.http.shutdown()


def qdrant(kept):
    def answer(method, path, body):
        if path == "/collections/c":
            if method == "PUT":
                kept["made"] = body
            return (200, {}) if "made" in kept else (404, {})
        points = kept.setdefault("points", {})
        if path.startswith("/collections/c/points/delete"):
            for i in body["points"]:
                points.pop(i, None)
            return 200, {}
        if method == "PUT":
            points.update({p["id"]: p for p in body["points"]})
            return 200, {}
        must = body.get("filter", {}).get("must", [])
        some = [p for i, p in sorted(points.items()) if i >= body.get("offset", "") and all(p["payload"].get(m["key"]) == m["match"]["value"] for m in must)]
        page = some[: body["limit"]]
        return 200, {"result": {"points": page, "next_page_offset": some[len(page)]["id"] if len(some) > len(page) else None}}

    return answer


def chroma(kept):
    def answer(method, path, body):
        rows = kept.setdefault("rows", {})
        if path.endswith("/collections"):
            return 200, {"id": "abc"}
        if path.endswith("/count"):
            return 200, len(rows)
        if path.endswith("/upsert"):
            rows.update({i: (e, m) for i, e, m in zip(body["ids"], body["embeddings"], body["metadatas"], strict=True)})
            return 200, {}
        if path.endswith("/delete"):
            for i in body["ids"]:
                rows.pop(i, None)
            return 200, {}
        where = body.get("where") or {}
        wanted = [(k, v["$eq"]) for c in where.get("$and", [where] if where else []) for k, v in c.items()]
        ids = [i for i, (_, m) in sorted(rows.items()) if all((m or {}).get(k) == v for k, v in wanted)][body["offset"] : body["offset"] + body["limit"]]
        return 200, {"ids": ids, "embeddings": [rows[i][0] for i in ids], "metadatas": [rows[i][1] for i in ids]}

    return answer


def milvus(kept):
    def answer(method, path, body):
        rows = kept.setdefault("rows", {})
        what = path.removeprefix("/v2/vectordb/")
        if what == "collections/has":
            return 200, {"code": 0, "data": {"has": "made" in kept}}
        if what == "collections/create":
            kept["made"] = body
            return 200, {"code": 0, "data": {}}
        if what == "entities/upsert":
            rows.update({x["id"]: x for x in body["data"]})
            return 200, {"code": 0, "data": {}}
        if what == "entities/delete":
            for i in json.loads(body["filter"].removeprefix("id in ")):
                rows.pop(i, None)
            return 200, {"code": 0, "data": {}}
        tests = [re.fullmatch(r'(\w+) (==|>=|>|<) (".*")', x).groups() for x in body["filter"].split(" and ")]
        compare = {"==": str.__eq__, ">=": str.__ge__, ">": str.__gt__, "<": str.__lt__}
        some = [x for _, x in sorted(rows.items()) if all(compare[op](x.get(k, ""), json.loads(v)) for k, op, v in tests)]
        return 200, {"code": 0, "data": some[: body["limit"]]}

    return answer


@pytest.mark.parametrize(("protocol", "stub"), [("qdrant", qdrant), ("chroma", chroma), ("milvus", milvus)])
def test_remote_round_trip(spark, protocol, stub):
    kept: dict = {}
    with Server(stub(kept)) as server:
        options = {"protocol": protocol, "url": server.url, "collection": "c", "page": "7", "parts": "3", "dimension": "2", "splits": "r15,r30"}
        rows = [(f"r{i:02}", [float(i), 0.5], {"user_id": f"u{i % 2}", "content": f"text {i}"}) for i in range(45)]
        schema = "id string, vector array<float>, payload map<string,string>"
        remote.write_remote(spark.createDataFrame(rows, schema).repartition(2), **options)
        remote.write_remote(spark.createDataFrame([("r03", [7.0, 7.0], {"user_id": "v"})], schema), **options)  # in place of the other
        want = {**{i: (v, p) for i, v, p in rows}, "r03": ([7.0, 7.0], {"user_id": "v"})}
        assert {r["id"]: (r["vector"], r["payload"]) for r in remote.read_remote(spark, **options).collect()} == want
        server.calls.clear()
        found = remote.read_remote(spark, {"user_id": "u1"}, **options)
        assert {r["id"] for r in found.collect()} == {i for i, (_, p) in want.items() if p["user_id"] == "u1"}
        reads = [b for _, p, b in server.calls if b and ("limit" in b)]
        assert len(reads) > 3 and all(b["limit"] <= 7 and ("u1" in json.dumps(b)) for b in reads)  # pages, and the scope goes along
        remote.delete_remote(spark.createDataFrame([("r01",), ("r02",)], "id string"), **options)
        assert remote.read_remote(spark, **options).count() == 43
    with pytest.raises(Config):
        remote.write_remote(spark.createDataFrame(rows[:1], schema), protocol="other", url="x", collection="c")


def test_each_text_is_asked_once(spark, tmp_path):
    def answer(method, path, body):
        if path == "/api/embed":
            return (500, {}) if "bad" in body["input"] else (200, {"embeddings": [[float(len(x)), 1.0] for x in body["input"]]})
        return 404, {}

    with Server(answer) as server:
        policy = providers.Policy(batch=4, attempts=2, pause=0.01, tasks=2)
        cache = providers.Cache(spark, f"file://{tmp_path}/cache", providers.embedder(server.url, "m"), "array<float>", policy)
        texts = [f"t{'x' * (i % 9)}" for i in range(60)] + ["bad", None, ""]
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
        got = {r["i"]: r["v"] for r in cache.answered(rows, "text", "v").collect()}
        assert got == {i: [float(len(t)), 1.0] if t and t != "bad" else None for i, t in enumerate(texts)}
        asked = [x for _, _, b in server.calls for x in b["input"]]
        assert {asked.count(t) for t in set(texts) - {"bad", None, ""}} <= {1, 2, 3, 4}  # again only with the failing one's batch
        assert max(len(b["input"]) for _, _, b in server.calls) > 1
        server.calls.clear()
        more = spark.createDataFrame([(1, "t"), (2, "new text"), (3, "txx")], "i int, text string")
        assert cache.answered(more, "text").count() == 3
        assert [b["input"] for _, _, b in server.calls] == [["new text"]]
        failed = cache.fill(spark.createDataFrame([("bad",)], "text string")).first()
        assert failed["answer"] is None and "500" in failed["error"]


def test_servers_without_batches_and_chats(spark, tmp_path):
    def answer(method, path, body):
        if path == "/api/embeddings":
            return 200, {"embedding": [float(len(body["prompt"]))]}
        if path == "/api/chat":
            said = body["messages"][-1]["content"]
            return 200, {"message": {"content": f"{0.9 if 'rust' in said.split('Document')[-1] else 0.1}"}} if "none" not in said else {"nothing": 1}
        return 404, {}

    with Server(answer) as server:
        assert providers.embedder(server.url, "m")(["a", "bb"]) == [[1.0], [2.0]]
        assert providers.chatter(server.url, "m", "Be short.", 0.2)(["rust"]) == ["0.9"]
        assert server.calls[-1][2]["options"] == {"temperature": 0.2} and server.calls[-1][2]["messages"][0]["role"] == "system"
        cache = providers.Cache(spark, f"file://{tmp_path}/chat", providers.chatter(server.url, "m"), "string", providers.Policy(attempts=1, tasks=1))
        found = spark.createDataFrame([("a", 1.0, "about pasta"), ("b", 2.0, "about rust"), ("c", 3.0, "none")], "id string, score float, content string")
        ranked = providers.relevance_reranker(cache)(found, "rust or none?".replace("none", "not")).orderBy("score").collect()
        assert [(r["id"], round(r["score"], 3)) for r in ranked] == [("b", 0.1), ("c", 0.5), ("a", 0.9)]
        facts = providers.facts_by(cache, lambda c: F.split(c, r"\."))(spark.createDataFrame([(1, "rust")], "conv_id int, text string"))
        assert [(r["conv_id"], r["pos"], r["fact"]) for r in facts.collect()] == [(1, 0, "0"), (1, 1, "9")]


def test_engine_over_a_server(spark, tmp_path):
    from palimpsest.plans.engine import Engine, Settings

    def answer(method, path, body):
        if path == "/api/embed":
            return 200, {"embeddings": [[float(x.count("tea")), float(x.count("milk")), float(len(x))] for x in body["input"]]}
        return 200, {"message": {"content": "\n".join(body["messages"][-1]["content"].split(" and "))}}

    with Server(answer) as server:
        settings = Settings(collection="c", dimension=3, model="some-model", temperature=0.5)
        e = Engine.over_server(spark, server.url, settings, f"file://{tmp_path}/kept")
        messages = spark.createDataFrame([(0, 0, "user", "tea is hot and milk is cold"), (1, 0, "user", "tea is hot")], "conv_id long, turn long, role string, text string")
        assert {r["content"] for r in e.add(messages, {"user_id": "u"}).collect()} == {"tea is hot", "milk is cold"}
        assert e.search("milk is cold", 1, {"user_id": "u"}, "2026-01-01").first()["payload"]["content"] == "milk is cold"
        chats = [b for _, p, b in server.calls if p == "/api/chat"]
        assert len(chats) == 2  # one for each message
        assert all(b["model"] == "some-model" and b["options"] == {"temperature": 0.5} for b in chats)
        assert (tmp_path / "kept" / "c" / "commits").exists()
        again = Engine.over_server(spark, server.url, settings, f"file://{tmp_path}/kept")
        assert again.tables.memories.count() == 2


def test_addresses():
    assert [providers.base_url(x) for x in (None, " ", "http://h/", "h", "h:1", "https://h:2/")] == ["http://localhost:11434", "http://localhost:11434", "http://h", "http://h:11434", "http://h:1", "https://h:2"]
