"""A stored inverted index with block maxima and positions, kept up with inserts, updates and deletes.

Documents fall into blocks where they lie, some hundreds that one task reads together, so that their words never leave it. A row of the index has a term's postings of one block, with the greatest count and
the least length among them, from which no score of the block can be higher than a bound that is read without the postings. A
query reads the bounds of its terms only, scores the blocks with the highest ones, and then those others alone whose
bound reaches the worst score found, so the postings of a common word aren't read where no rare word stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import token_list
from ..operators.keyword import bm25_weight, cover_density, query_terms
from .commits import Commits

#: Blocks that are scored first; blocks that are named one by one in a filter, beyond which they are joined.
FIRST_BLOCKS, NAMED_BLOCKS = 16, 2000
#: Documents for each block of a new index.
BLOCK_DOCUMENTS = 256


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)
        #: Blocks that hold a term of the last query, and how many of them were read.
        self.blocks_of_last, self.blocks_read = 0, 0

    # Writing

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, keep: Sequence[str] = (), blocks: int | None = None, buckets: int = 16, source: int = 0) -> KeywordIndex:
        """An index of ``docs`` (id, content, and string columns to ``keep`` for filters); terms are dealt to ``buckets`` folders. ``source`` is the version of a store that they are."""
        self = cls(spark, path)
        meta = {"per_block": -(-docs.count() // blocks) or 1 if blocks else BLOCK_DOCUMENTS, "buckets": buckets, "keep": list(keep), "id": docs.schema["id"].dataType.simpleString()}
        self._commit({"meta": meta, "parts": {}, "n": 0, "length": 0}, docs, None, source)
        return self

    @property
    def source(self) -> int:
        """The version of the store that the index stands for."""
        return self._state()["source"]

    def _state(self) -> dict:
        return self.commits.read(self.commits.latest())

    def _documents(self, docs: DataFrame, meta: dict) -> DataFrame:
        return docs.select("id", *meta["keep"], token_list(F.coalesce(F.col("content"), F.lit(""))).alias("tokens"))

    def _bucket(self, meta: dict) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(meta["buckets"])).cast("int").alias("bucket")

    def _posting(self, meta: dict) -> list[str]:
        return ["id", *meta["keep"], "length", "positions"]

    def _schema(self, kind: str, meta: dict) -> str:
        kept = "".join(f"{c}:string," for c in meta["keep"])
        return {
            "postings": f"term string, block int, n int, most int, shortest int, postings array<struct<id:{meta['id']},{kept}length:int,positions:array<int>>>, bucket int",
            "terms": "term string, df bigint, bucket int",
            "deaths": f"id {meta['id']}",
        }[kind]

    def _commit(self, state: dict, new: DataFrame | None, gone: DataFrame | None, source: int) -> None:
        """A segment with the documents ``new`` and without ``gone`` (id, content as it was)."""
        read, meta = self.commits.latest(), state["meta"]
        version, parts = read + 1, {k: dict(v) for k, v in state["parts"].items()}
        n, length, changes = state["n"], state["length"], []
        named = lambda kind, name: parts.setdefault(kind, {}).update({name: version})
        if new is not None:
            docs = self._documents(new, meta)
            schema = StructType.fromDDL(self._schema("postings", meta).removesuffix(", bucket int"))
            by_block = docs.mapInArrow(_inverted(meta.get("per_block", BLOCK_DOCUMENTS), meta["keep"], to_arrow_schema(schema)), schema)
            name = self.commits.put(by_block.withColumn("bucket", self._bucket(meta)).sortWithinPartitions("bucket", "term", "block"), "postings", ("bucket",))  # each task's part of a folder is sorted by itself
            named("postings", name)
            changes.append(self.commits.get("postings", {name: version}, self._schema("postings", meta)).groupBy("bucket", "term").agg(F.sum("n").alias("df")))
            size = docs.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
            n, length = n + size[0], length + size[1]
        if gone is not None:
            docs = self._documents(gone.select("id", "content", *(F.lit(None).cast("string").alias(c) for c in meta["keep"])), meta)
            changes.append(docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).select(self._bucket(meta), "term", "df"))
            named("deaths", self.commits.put(gone.select("id"), "deaths"))
            size = docs.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
            n, length = n - size[0], length - size[1]
        if changes:
            df = reduce(DataFrame.unionByName, changes).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
            named("terms", self.commits.put(df.repartitionByRange(meta["buckets"], "bucket", "term").sortWithinPartitions("bucket", "term"), "terms", ("bucket",)))
        self.commits.write(version, {"meta": meta, "parts": parts, "n": n, "length": length, "source": source})

    def update(self, new: DataFrame | None = None, gone: DataFrame | None = None, source: int | None = None) -> None:
        """Adds the documents ``new`` (id, content, kept columns) and takes away ``gone`` (id, content as indexed); a changed one is in both. Only their words are written."""
        state = self._state()
        self._commit(state, new, gone, state["source"] if source is None else source)

    def compact(self) -> None:
        """Merges all segments: the postings of documents that are gone go."""
        state = self._state()
        meta, version = state["meta"], self.commits.latest() + 1
        live = self._live(self._postings(state).select("bucket", "term", "block", "_v", F.explode("postings").alias("p")), state)
        merged = live.groupBy("bucket", "term", "block").agg(F.count("*").cast("int").alias("n"), F.max(F.size("p.positions")).alias("most"), F.min("p.length").alias("shortest"), F.collect_list("p").alias("postings"))
        files = max(meta["buckets"], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = self.commits.put(merged.repartitionByRange(files, "bucket", "term", "block").sortWithinPartitions("bucket", "term", "block"), "postings", ("bucket",))
        df = self.commits.get("postings", {name: version}, self._schema("postings", meta)).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        terms = self.commits.put(df.repartitionByRange(meta["buckets"], "bucket", "term").sortWithinPartitions("bucket", "term"), "terms", ("bucket",))
        self.commits.write(version, {"meta": meta, "parts": {"postings": {name: version}, "terms": {terms: version}}, "n": state["n"], "length": state["length"], "source": state["source"]})

    # Reading

    def _get(self, kind: str, state: dict) -> DataFrame:
        return self.commits.get(kind, state["parts"].get(kind, {}), self._schema(kind, state["meta"]))

    def _postings(self, state: dict, terms: Sequence[str] | None = None, kind: str = "postings") -> DataFrame:
        """Rows of ``terms`` only: their folders, and of these the files' parts whose range has them."""
        rows = self._get(kind, state)
        if terms is None:
            return rows
        of = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(state["meta"]["buckets"])).cast("int") for t in terms)).first()
        return rows.where(F.col("bucket").isin(*set(of)) & F.col("term").isin(*terms))

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """``rows`` with a posting ``p`` of a segment ``_v``, without those whose document went later."""
        if not state["parts"].get("deaths"):
            return rows
        gone = self._get("deaths", state).groupBy("id").agg(F.max("_v").alias("_until")).withColumnRenamed("id", "_gone")
        return rows.join(gone, (F.col("p.id") == F.col("_gone")) & (F.col("_v") < F.col("_until")), "left_anti")

    def statistics(self, terms: Sequence[str]) -> tuple[int, float, dict[str, int]]:
        """Documents, their mean length, and in how many each term is."""
        state = self._state()
        rows = self._postings(state, terms, "terms").groupBy("term").agg(F.sum("df").alias("df")).collect()
        return state["n"], state["length"] / state["n"] if state["n"] else 1.0, {t: 0 for t in terms} | {r["term"]: r["df"] for r in rows}

    def _exploded(self, state: dict, rows: DataFrame, scope: dict[str, str]) -> DataFrame:
        """term and the fields of each live posting in ``scope``."""
        each = rows.select("term", "_v", F.explode("postings").alias("p"))
        for k, v in scope.items():
            each = each.where(F.col(f"p.{k}") == v)
        return self._live(each, state).select("term", *(F.col(f"p.{c}").alias(c) for c in self._posting(state["meta"])))

    def top_k(self, query: str, k: int, scope: dict[str, str] | None = None, require_all: bool = False) -> DataFrame:
        """id and keyword_score of the ``k`` best documents of a ``scope`` (kept columns), exactly as a scan scores them."""
        terms, state = query_terms(query), self._state()
        none = self.spark.createDataFrame([], f"id {state['meta']['id']}, keyword_score double")
        if not terms or not state["n"]:
            return none
        n, average, df = self.statistics(terms)
        weight = lambda t, tf, length: bm25_weight(tf, F.lit(df[t]), F.lit(n), length, F.lit(average))
        rows = self._postings(state, terms)

        bound = F.lit(None).cast("double")
        for t in terms:
            bound = F.when(F.col("term") == t, weight(t, F.col("most"), F.col("shortest"))).otherwise(bound)
        heads = rows.select("block", "term", bound.alias("bound")).groupBy("block", "term").agg(F.max("bound").alias("bound")).groupBy("block").agg(F.sum("bound").alias("bound"), F.count("*").alias("n_terms"))
        if require_all:
            heads = heads.where(F.col("n_terms") == len(terms))
        heads = heads.select("block", (F.col("bound") * (1 + 1e-9)).alias("bound"))  # sums may be rounded either way

        def scored(some: DataFrame) -> DataFrame:
            each = self._exploded(state, some, scope or {})
            parts = [F.max(F.when(F.col("term") == t, weight(t, F.size("positions"), F.col("length")))).alias(f"w{i}") for i, t in enumerate(terms)]
            found = each.groupBy("id").agg(*parts)
            if require_all:
                found = found.where(" AND ".join(f"w{i} IS NOT NULL" for i in range(len(terms))))
            return found.select("id", (-reduce(add, (F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))).alias("keyword_score")).orderBy("keyword_score", "id").limit(k)

        first = [r["block"] for r in heads.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        self.blocks_of_last, self.blocks_read = heads.count(), len(first)
        if not first:
            return none
        best = scored(rows.where(F.col("block").isin(*first))).collect()
        rest = heads.where(~F.col("block").isin(*first))
        if len(best) == k:
            rest = rest.where(F.col("bound") >= -best[-1]["keyword_score"])
        found = self.spark.createDataFrame([tuple(r) for r in best], none.schema)  # k rows
        left = [r["block"] for r in rest.select("block").limit(NAMED_BLOCKS + 1).collect()]
        if not left:
            return found
        many = len(left) > NAMED_BLOCKS
        self.blocks_read += rest.count() if many else len(left)
        more = scored(rows.join(rest.select("block"), "block", "left_semi") if many else rows.where(F.col("block").isin(*left)))
        return found.unionByName(more).orderBy("keyword_score", "id").limit(k)

    def cover_density(self, query: str, k: int, scope: dict[str, str] | None = None) -> DataFrame:
        """id and keyword_score of the ``k`` best of the documents that hold every term, by ``keyword.cover_density``. Blocks that lack a term aren't read."""
        terms, state = query_terms(query), self._state()
        if not terms or not state["n"]:
            return self.spark.createDataFrame([], f"id {state['meta']['id']}, keyword_score double")
        rows = self._postings(state, terms)
        whole = rows.groupBy("block").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("block")
        each = self._exploded(state, rows.join(whole, "block", "left_semi"), scope or {})
        place = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int") - 1
        entries = F.transform("positions", lambda x: F.struct(x.alias("pos"), F.col("_k").alias("term")))
        found = each.withColumn("_k", place).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list(entries))).alias("entries"), F.count("*").alias("n")).where(F.col("n") == len(terms))
        return found.select("id", (-cover_density(F.col("entries"), len(terms))).alias("keyword_score")).orderBy("keyword_score", "id").limit(k)


def _inverted(per_block: int, keep: Sequence[str], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of documents (id, kept columns, tokens) the postings of each block of ``per_block`` of them. Blocks that get one number by chance only share a bound."""

    def block_of(docs: pa.RecordBatch, number: int) -> pa.RecordBatch | None:
        length = pc.list_value_length(docs["tokens"]).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = docs["tokens"].flatten().dictionary_encode()
        if not len(coded):
            return None
        by_word = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_word), np.int32)
        place[by_word] = np.arange(len(by_word), dtype=np.int32)
        term, doc = place[coded.indices.to_numpy()], np.repeat(np.arange(len(length), dtype=np.int32), length)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        order = np.argsort(term, kind="stable")  # then by document and position
        term, doc, pos = term[order], doc[order], pos[order]
        new = lambda *keys: np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))]))
        ends = lambda starts, n: np.append(starts, n).astype(np.int32)
        pairs = new(term, doc)
        counts, of = np.diff(ends(pairs, len(term))), doc[pairs]
        took = docs.select(["id", *keep]).take(pa.array(of))  # a row for each term and document: with its tokens it would be the square of a text
        each = [took["id"], *(took[c] for c in keep), pa.array(length[of]), pa.ListArray.from_arrays(pa.array(ends(pairs, len(term))), pa.array(pos))]
        terms = new(term[pairs])
        postings = pa.ListArray.from_arrays(pa.array(ends(terms, len(pairs))), pa.StructArray.from_arrays(each, ["id", *keep, "length", "positions"]))
        columns = [
            coded.dictionary.take(pa.array(by_word)),
            pa.array(np.full(len(terms), number, np.int32)),
            pa.array(np.diff(ends(terms, len(pairs)))),
            pa.array(np.maximum.reduceat(counts, terms)),
            pa.array(np.minimum.reduceat(length[of], terms)),
            postings,
        ]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), per_block):
                if (block := block_of(batch.slice(at, per_block), (part * 40_503 + n) % (1 << 31))) is not None:
                    yield block
                n += 1

    return inverted
