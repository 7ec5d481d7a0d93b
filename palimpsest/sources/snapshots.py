"""Stores on files: Parquet tables in versioned folders, JSON snapshots, and connectors by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Config, DimensionMismatch, NotFound
from ..operators import keyword, lifecycle
from ..operators.knn import nearest
from ..operators.lifecycle import Tables
from ..schema import ENTITY_LINKS, HISTORY, MEMORIES, RECORDS, promote


class Store(Protocol):
    """What an engine needs of a place that keeps tables."""

    def load(self) -> Tables: ...

    def save(self, tables: Tables) -> None: ...


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class ParquetStore:
    """Three tables in a folder for each version; a save writes a new one and then names it current, so readers never see half a change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int:
        pointer = f"{self.path}/current"
        return self.spark.read.schema("version int").json(pointer).agg(F.max("version")).first()[0] if _exists(self.spark, pointer) else 0

    def load(self) -> Tables:
        at = f"{self.path}/v{self._version()}"
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{at}/{name}") if _exists(self.spark, f"{at}/{name}") else self.spark.createDataFrame([], schema)
        return Tables(read("memories", MEMORIES), read("history", HISTORY), read("links", ENTITY_LINKS))

    def save(self, tables: Tables) -> None:
        version = self._version() + 1
        for name, df in (("memories", tables.memories), ("history", tables.history), ("links", tables.links)):
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{self.path}/current")


def _load_arrays(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """Rows of a file, or a folder of files, that hold a JSON array each; a missing one has none. A bad file is an error, or with ``lenient`` left out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    mode = "DROPMALFORMED" if lenient else "FAILFAST"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", mode).option("recursiveFileLookup", True).json(path)
    return rows


#: Text of a file of a JSON array, which is made in one task.
FILE_BYTES = 64 << 20


def _save_arrays(df: DataFrame, path: str, key: str, files: int) -> None:
    """``df`` as ``files`` files of a JSON array each, or as many as keep them to about FILE_BYTES, dealt by all columns, so that rows of one ``key`` spread too."""
    rows = df.select(key, F.to_json(F.struct(*df.columns)).alias("row"))
    size = rows.agg(F.sum(F.octet_length("row").cast("long") + 2)).first()[0] or 0
    files = max(files, -(-size // FILE_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64(key, "row"), F.lit(files)).cast("int").alias("file"), "row")
    arrays = dealt.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("file").text(path)


def load_json(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Records of JSON arrays of {id, vector, payload}; a missing file is an empty store."""
    return promote(_load_arrays(spark, path, RECORDS, lenient).where("id IS NOT NULL"))


def save_json(memories: DataFrame, path: str, files: int = 1) -> None:
    _save_arrays(memories.select("id", "vector", "payload"), path, "id", files)


class JsonStore:
    """The three tables as JSON arrays in a folder, links and history included."""

    def __init__(self, spark: SparkSession, path: str, files: int = 1):
        self.spark, self.path, self.files = spark, path.rstrip("/"), files

    def load(self) -> Tables:
        read = lambda name, schema: _load_arrays(self.spark, f"{self.path}/{name}", schema)
        return Tables(load_json(self.spark, f"{self.path}/memories"), read("history", HISTORY), read("links", ENTITY_LINKS))

    def save(self, tables: Tables) -> None:
        save_json(tables.memories, f"{self.path}/memories", self.files)
        _save_arrays(tables.history, f"{self.path}/history", "id", self.files)
        _save_arrays(tables.links, f"{self.path}/links", "id", self.files)


class MemoryStore:
    """The protocol of a store over tables in the session: every operation reads or replaces them."""

    def __init__(self, spark: SparkSession, dimension: int, memories: DataFrame | None = None):
        self.spark, self.dimension = spark, dimension
        self.memories = memories if memories is not None else spark.createDataFrame([], MEMORIES)

    def insert(self, records: DataFrame) -> None:
        self.memories = lifecycle.upsert(self.memories, records, self.dimension)

    def search(self, query: list[float], k: int, metric: str = "l1", threshold: float | None = None, where: Column | None = None) -> DataFrame:
        if len(query) != self.dimension:
            raise DimensionMismatch(self.dimension, len(query))
        return nearest(self.memories, query, k, metric, threshold, where)

    def keyword_search(self, query: str, k: int) -> DataFrame:
        return keyword.search(self.memories.select("id", "content"), query).orderBy("keyword_score", "id").limit(k)

    def get(self, id_: str) -> DataFrame:
        return lifecycle.get(self.memories, id_)

    def update(self, records: DataFrame) -> None:
        """Replaces known records; an unknown id is an error."""
        unknown = records.join(self.memories, "id", "left_anti").select("id").first()
        if unknown is not None:
            raise NotFound(unknown["id"])
        self.insert(records)

    def delete(self, id_: str) -> None:
        self.memories = self.memories.where(F.col("id") != id_)

    def list(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        rows = self.memories.orderBy("id").offset(offset)
        return rows if limit is None else rows.limit(limit)

    def reset(self) -> None:
        self.memories = self.memories.limit(0)


def load_text_layout(rows: DataFrame) -> DataFrame:
    """Records of rows (id, vector, payload) whose vector and payload are JSON texts, as SQL stores keep them; a bad one is an error."""
    strict = {"mode": "FAILFAST"}
    return promote(rows.select("id", F.from_json("vector", "array<float>", strict).alias("vector"), F.from_json("payload", "map<string,string>", strict).alias("payload")))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Records of a SQL store over JDBC; its driver must be on the class path."""
    if not table.replace("_", "").isalnum():
        raise Config("a table's name has letters, digits and underlines")
    return load_text_layout(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def export_history(history: DataFrame) -> DataFrame:
    """id and its entries as JSON text, in order; an id has a bounded history."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("seq", "event", "content"))), lambda e: F.struct(e["event"].alias("event"), e["content"].alias("content")))
    return history.groupBy("id").agg(F.to_json(entries).alias("entries"))


def save_history(history: DataFrame, path: str, files: int = 1) -> None:
    """The export as ``files`` files of a JSON object id -> [{event, content}] each, or as many as keep them to about FILE_BYTES."""
    entry = F.to_json(F.create_map("id", F.from_json("entries", "array<struct<event:string,content:string>>")))
    rows = export_history(history).select("id", F.substring(entry, F.lit(2), F.length(entry) - 2).alias("row"))
    size = rows.agg(F.sum(F.octet_length("row").cast("long") + 2)).first()[0] or 0
    files = max(files, -(-size // FILE_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file"), "row")
    objects = dealt.groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("row"), ",\n"), F.lit("}")).alias("value"))
    objects.write.mode("overwrite").partitionBy("file").text(path)


def import_history(spark: SparkSession, path: str) -> DataFrame:
    """Change history of a file, or a folder of files, of a JSON object id -> [{event, content}]; it replaces what was there."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,array<struct<event:string,content:string>>>")).alias("id", "entries"))
    return entries.select("id", F.posexplode("entries").alias("seq", "e")).select("id", F.col("seq").cast("bigint"), "e.event", "e.content")


