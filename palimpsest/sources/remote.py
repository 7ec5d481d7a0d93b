"""Collections of remote vector databases as Spark data sources: read by ranges of pages, filtered by scope where they lie, and written so that a repeated task changes nothing."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import Config, Provider
from ..schema import RECORDS, promote

SECONDS = 60


def _call(method: str, url: str, body: dict | None = None, missing: bool = False) -> dict | list | int | None:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=SECONDS) as answer:
            return json.loads(answer.read() or b"null")
    except urllib.error.HTTPError as e:
        if missing and e.code == 404:
            return None
        raise Provider(f"HTTP {e.code} from {url}") from e
    except (OSError, ValueError) as e:
        raise Provider(f"{type(e).__name__} from {url}: {e}") from e


def _strings(payload: dict | None, without: tuple[str, ...] = ()) -> dict[str, str]:
    """What is text in a payload; records have nothing else."""
    return {k: v for k, v in (payload or {}).items() if isinstance(v, str) and k not in without}


class Qdrant:
    """Points by UUIDs made of the ids (version 5), which are spread evenly, so a range of pages is a range of UUIDs."""

    def __init__(self, options: dict[str, str]):
        self.at = f"{options['url'].rstrip('/')}/collections/{options['collection']}"
        self.page, self.dimension = int(options.get("page", 1000)), int(options.get("dimension", 0))
        self.id_key = options.get("idkey", "record_id")
        self.space = uuid.UUID(options.get("namespace", "6ba7b812-9dad-11d1-80b4-00c04fd430c8"))

    def ensure(self) -> None:
        if _call("GET", self.at, missing=True) is None:
            _call("PUT", self.at, {"vectors": {"size": self.dimension, "distance": "Euclid"}})

    def ranges(self, parts: int) -> list[tuple]:
        edges = [None, *(str(uuid.UUID(int=(1 << 128) * i // parts)) for i in range(1, parts)), None]
        return list(zip(edges, edges[1:], strict=False))

    def rows(self, part: tuple, scope: dict[str, str]) -> Iterator[tuple]:
        at, end = part
        while True:
            body = {"limit": self.page, "with_payload": True, "with_vector": True} | ({"offset": at} if at else {})
            if scope:
                body["filter"] = {"must": [{"key": k, "match": {"value": v}} for k, v in scope.items()]}
            found = _call("POST", f"{self.at}/points/scroll", body)["result"]
            for x in found["points"]:
                if end is not None and str(x["id"]) >= end:
                    return
                yield (x["payload"] or {}).get(self.id_key, str(x["id"])), x.get("vector"), _strings(x["payload"], (self.id_key,))
            at = found.get("next_page_offset")
            if at is None or not found["points"]:
                return

    def put(self, rows: list[tuple]) -> None:
        points = [{"id": str(uuid.uuid5(self.space, i)), "vector": v, "payload": {**p, self.id_key: i}} for i, v, p in rows]
        _call("PUT", f"{self.at}/points?wait=true", {"points": points})

    def drop(self, ids: list[str]) -> None:
        _call("POST", f"{self.at}/points/delete?wait=true", {"points": [str(uuid.uuid5(self.space, i)) for i in ids]})


class Chroma:
    """Records by offset; the collection's own id is looked up by its name."""

    def __init__(self, options: dict[str, str]):
        self.top = f"{options['url'].rstrip('/')}/api/v2/tenants/{options.get('tenant', 'default_tenant')}/databases/{options.get('database', 'default_database')}/collections"
        self.page, self.name = int(options.get("page", 1000)), options["collection"]

    def ensure(self) -> None:
        self.at  # noqa: B018  made when it is looked up

    @property
    def at(self) -> str:
        found = _call("POST", self.top, {"name": self.name, "get_or_create": True, "metadata": {"hnsw:space": "l2"}})
        return f"{self.top}/{found['id']}"

    def ranges(self, parts: int) -> list[tuple]:
        n = _call("GET", f"{self.at}/count")
        edges = [n * i // parts for i in range(parts)] + [n]
        return list(zip(edges, edges[1:], strict=False))

    def rows(self, part: tuple, scope: dict[str, str]) -> Iterator[tuple]:
        at, (a, b) = self.at, part
        where = [{k: {"$eq": v}} for k, v in scope.items()]
        for offset in range(a, b, self.page):
            body = {"limit": min(self.page, b - offset), "offset": offset, "include": ["embeddings", "metadatas"]}
            if where:
                body["where"] = where[0] if len(where) == 1 else {"$and": where}
            found = _call("POST", f"{at}/get", body)
            yield from zip(found["ids"], found["embeddings"], map(_strings, found["metadatas"]), strict=True)

    def put(self, rows: list[tuple]) -> None:
        _call("POST", f"{self.at}/upsert", {"ids": [i for i, _, _ in rows], "embeddings": [v for _, v, _ in rows], "metadatas": [p or None for _, _, p in rows]})

    def drop(self, ids: list[str]) -> None:
        _call("POST", f"{self.at}/delete", {"ids": ids})


class Milvus:
    """Rows by primary key: each page begins after the last key of the one before. ``splits``, ids joined by commas, cut the keys into parts."""

    def __init__(self, options: dict[str, str]):
        self.at, self.collection = f"{options['url'].rstrip('/')}/v2/vectordb", options["collection"]
        self.page, self.dimension = int(options.get("page", 1000)), int(options.get("dimension", 0))
        self.splits = [x for x in options.get("splits", "").split(",") if x]

    def _ask(self, what: str, body: dict) -> object:
        found = _call("POST", f"{self.at}/{what}", {"collectionName": self.collection, **body})
        if found.get("code"):
            raise Provider(f"code {found['code']}: {found.get('message')}")
        return found.get("data")

    def ensure(self) -> None:
        if not self._ask("collections/has", {})["has"]:
            self._ask("collections/create", {"dimension": self.dimension, "metricType": "L2", "primaryFieldName": "id", "idType": "VarChar", "vectorFieldName": "vector", "params": {"max_length": "512"}})

    def ranges(self, parts: int) -> list[tuple]:
        edges = [None, *sorted(self.splits), None]
        return list(zip(edges, edges[1:], strict=False))

    @staticmethod
    def quoted(x: str) -> str:
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def rows(self, part: tuple, scope: dict[str, str]) -> Iterator[tuple]:
        a, b = part
        fixed = [f"{k} == {self.quoted(v)}" for k, v in scope.items()] + ([f"id < {self.quoted(b)}"] if b else [])
        after = f"id >= {self.quoted(a)}" if a else 'id >= ""'
        while True:
            found = self._ask("entities/query", {"filter": " and ".join([after, *fixed]), "outputFields": ["*"], "limit": self.page})
            for x in found:
                yield x["id"], x["vector"], _strings(x, ("id", "vector"))
            if len(found) < self.page:
                return
            after = f"id > {self.quoted(max(x['id'] for x in found))}"

    def put(self, rows: list[tuple]) -> None:
        self._ask("entities/upsert", {"data": [{**p, "id": i, "vector": v} for i, v, p in rows]})

    def drop(self, ids: list[str]) -> None:
        self._ask("entities/delete", {"filter": f"id in [{', '.join(map(self.quoted, ids))}]"})


PROTOCOLS = {"qdrant": Qdrant, "chroma": Chroma, "milvus": Milvus}


def _protocol(options: dict[str, str]):
    if options.get("protocol") not in PROTOCOLS:
        raise Config(f"protocol is one of {', '.join(PROTOCOLS)}")
    return PROTOCOLS[options["protocol"]](options)


class _Pages(InputPartition):
    def __init__(self, part: tuple):
        super().__init__(part)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.scope = options, json.loads(options.get("scope", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [_Pages(x) for x in _protocol(self.options).ranges(int(self.options.get("parts", 8)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _protocol(self.options).rows(partition.value, self.scope)


class _Writer(DataSourceWriter):
    """Upserts or deletes by id, so that a task which Spark repeats says the same again."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        to, some, size = _protocol(self.options), [], int(self.options.get("page", 1000))
        drops = self.options.get("mode") == "delete"
        say = (lambda rows: to.drop([i for i, _, _ in rows])) if drops else to.put
        for row in iterator:
            some.append((row["id"], row["vector"], dict(row["payload"] or {})))
            if len(some) == size:
                say(some)
                some = []
        if some:
            say(some)
        return WriterCommitMessage()


class RemoteVectors(DataSource):
    """Options: protocol, url, collection, page, parts, dimension, scope (a JSON object of what payloads have to hold), and those of the protocol."""

    @classmethod
    def name(cls) -> str:
        return "remote_vectors"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise Config("a collection is appended to")
        return _Writer(dict(self.options))


def read_remote(spark: SparkSession, scope: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Memories of a remote collection, those of a ``scope`` only."""
    spark.dataSource.register(RemoteVectors)
    return promote(spark.read.format("remote_vectors").options(scope=json.dumps(scope or {}), **options).load())


def write_remote(records: DataFrame, **options: str) -> None:
    """Stores ``records`` (id, vector, payload) in place of those of their ids; the collection is made if it is missing."""
    _protocol(options).ensure()
    records.sparkSession.dataSource.register(RemoteVectors)
    records.select("id", "vector", "payload").write.format("remote_vectors").mode("append").options(**options).save()


def delete_remote(ids: DataFrame, **options: str) -> None:
    """Without the records of ``ids`` (id)."""
    ids.sparkSession.dataSource.register(RemoteVectors)
    ids.selectExpr("id", "CAST(NULL AS array<float>) AS vector", "CAST(NULL AS map<string,string>) AS payload").write.format("remote_vectors").mode("append").options(mode="delete", **options).save()
