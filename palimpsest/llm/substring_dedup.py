"""Removal of repeated passages by fixed-block anchors.

Every document is cut into reference blocks of half a window that don't overlap; they are indexed by hash, and every
rolling window of a block's length of every document probes the index. A window that repeats another
one holds a block of its own, and that block occurs elsewhere; so hits extend, block after block, to the windows all of whose own
blocks are hit, and these few are compared by their whole word sequence. Covered words make maximal repeats.

The documents stand in chunks, in order. What chunks ask goes to the buckets of a hash as packed, sorted, distinct hashes
(at most one of each for a chunk, however often a passage stands in it), and what comes back is a bit for each. So a passage that all documents
share costs a bit more for each chunk, no pair of documents is ever made, and a repeat's first occurrence is that of the first chunk that asks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import U, Words, _power_tables, as_bytes, mix

#: Words of a window. Blocks have half of it, rounded up, which is the most for which every window holds a whole one.
WIDTH = 20
#: Text of a chunk, unless a single text is longer; of a range of documents; of what a bucket is asked about.
CHUNK_BYTES = 3 << 20
RANGE_BYTES = 32 << 20
BUCKET_BYTES = 8 << 20
#: Ranges at most; beyond that they grow, and chunks don't.
MAX_RANGES = 20_000

_CHUNKS = "part int, chunk int, ids array<bigint>, sizes array<int>, raw binary"
_ASKED = "part int, chunk int, bucket int, keys binary, others binary"
_REPLY = "part int, chunk int, bucket int, bits binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<from:int,to:int>>"


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, highest bytes first: those are mostly zero, and the shuffle compresses them away."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.astype(values.dtype).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64 bits of the ``width`` hashes from each place on; the last places have fewer."""
    n = len(hashes)
    up, down = _power_tables(n + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(hashes * up[:n], dtype=U)))
    to = np.minimum(np.arange(n) + width, n)
    return mix((total[to] - total[:n]) * down[:n])


def _bucket(bits: np.ndarray, buckets: int) -> np.ndarray:
    return ((bits >> U(32)) * U(buckets)) >> U(32)


class _Chunk:
    """The words of a chunk's documents, their blocks and the windows that may repeat."""

    def __init__(self, sizes: np.ndarray, raw: bytes, buckets: int, width: int):
        to = np.cumsum(sizes + 1)
        self.words = w = Words([raw[b - s - 1 : b - 1] for s, b in zip(sizes.tolist(), to.tolist(), strict=True)], lower=False)
        self.buckets, self.width, self.block = buckets, width, (width + 1) // 2
        self.left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w))  # words to the document's end
        bits = _windows(w.hash, self.block)
        self.keys = (_bucket(bits, buckets) << U(32)) | (bits & U(0xFFFFFFFF))
        fits = self.left >= self.block
        self.aligned = fits & ((np.arange(len(w)) - np.repeat(w.first[:-1], np.diff(w.first))) % self.block == 0)
        self.blocks = np.unique(self.keys[self.aligned])
        self.probes = self.keys[fits]

    def by_bucket(self, keys: np.ndarray) -> list[bytes]:
        """What each bucket is told of ascending ``keys``."""
        edges = np.searchsorted(keys, np.arange(self.buckets + 1, dtype=U) << U(32))
        return [_pack(keys[a:b].astype(np.uint32)) for a, b in zip(edges, edges[1:], strict=False)]

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows all of whose own blocks are hit; ``hit`` goes by ``blocks``."""
        missed = np.zeros(len(self.words) + 1, np.int64)
        at = np.flatnonzero(self.aligned)
        missed[at + 1] = ~hit[np.searchsorted(self.blocks, self.keys[at])]
        missed = np.cumsum(missed)
        starts = np.flatnonzero(self.left >= self.width)
        return starts[missed[starts + self.width - self.block + 1] == missed[starts]]

    def repeated_here(self) -> np.ndarray:
        """Which of ``blocks`` more than one rolling window of the chunk has."""
        probes = np.sort(self.probes)
        return np.searchsorted(probes, self.blocks, "right") - np.searchsorted(probes, self.blocks) > 1

    def sequences(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows from ``starts``: bucket and hash of each different one, ascending, which of these each start has, and which starts are not the first of theirs.

        Bucket and hash are independent, so a bucket of some million windows confuses two with a chance of 10**-7.
        """
        w = self.words.hash
        keys, buckets = _windows(w, self.width)[starts], _bucket(_windows(mix(w ^ U(0xD6E8FEB86659FD93)), self.width)[starts], self.buckets)
        order = np.lexsort((keys, buckets))  # stable: the first of equal ones starts first
        keys, buckets = keys[order], buckets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
        which, later = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        which[order], later[order] = np.cumsum(new) - 1, ~new
        return buckets[new], keys[new], which, later


def _chunks(buckets: int, width: int, batches: Iterator) -> Iterator[tuple[dict, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pydict()
            yield {k: v[0] for k, v in row.items()}, _Chunk(np.array(row["sizes"][0], np.int64), row["raw"][0], buckets, width)


def _table(rows: dict[str, list], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]))


def _cut(batches: Iterator) -> Iterator:
    """Rows of a sorted range as chunks."""
    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("raw", pa.binary())])
    ids, texts, size, n, part = [], [], 0, 0, 0

    def chunk():
        return pa.RecordBatch.from_pydict({"part": [part], "chunk": [n], "ids": [ids], "sizes": [list(map(len, texts))], "raw": [b"\n".join(texts) + b"\n"]}, schema)

    for batch in C.text_blocks(batches):
        part = batch["part"][0].as_py()
        for i, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
            if texts and size + len(text) > CHUNK_BYTES:
                yield chunk()
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(i)
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield chunk()


def _bits(replies: list | None, kind: str, buckets: np.ndarray) -> np.ndarray:
    """The bits that came back for keys whose buckets ascend; buckets without a reply have none set."""
    out = np.zeros(len(buckets), bool)
    for x in replies or ():
        if x["kind"] == kind:
            a, b = np.searchsorted(buckets, [x["bucket"], x["bucket"] + 1])
            out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return out


def _reply_rows(table, flags: np.ndarray, sizes: list[int]):
    """One reply for each asking row that has a bit set."""
    import pyarrow as pa

    ends, rows = np.cumsum([0, *sizes]), {"part": [], "chunk": [], "bucket": [], "bits": []}
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if flags[a:b].any():
            for k in ("part", "chunk", "bucket"):
                rows[k].append(table[k][i].as_py())
            rows["bits"].append(np.packbits(flags[a:b]).tobytes())
    return pa.Table.from_batches([_table(rows, _REPLY)])


def _hit_blocks(table):
    """Of a bucket's blocks, which more than one chunk has as a rolling window."""
    keys = [_unpack(x, np.uint32) for x in table["keys"].to_pylist()]
    every = np.sort(np.concatenate([*keys, *(_unpack(x, np.uint32) for x in table["others"].to_pylist())]))
    asked = np.concatenate(keys)
    many = np.searchsorted(every, asked, "right") - np.searchsorted(every, asked) > 1
    return _reply_rows(table, many, list(map(len, keys)))


def _seen_before(table):
    """Of a bucket's windows, which an earlier chunk has."""
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table, [("part", "ascending"), ("chunk", "ascending")]))
    keys = [_unpack(x, np.uint64) for x in table["keys"].to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    later = np.zeros(len(every), bool)
    later[order[1:]] = every[order[1:]] == every[order[:-1]]
    return _reply_rows(table, later, list(map(len, keys)))


def _kept(words: Words, gone: np.ndarray):
    """An Arrow column of each text's words that aren't gone, joined by single spaces."""
    import pyarrow as pa

    raw, stay = words.raw.copy(), ~gone
    raw[words.end] = 0x20  # a space or line feed stands there
    last = np.zeros(len(words) + 1, np.int64)
    last[1:] = np.where(stay, np.arange(1, len(words) + 1), 0)
    last = np.maximum.accumulate(last)[words.first[1:]]  # 1 + the last word kept up to each text's end
    has = last > words.first[:-1]
    step = np.zeros(len(raw) + 2, np.int8)
    step[words.start[stay]] += 1
    np.subtract.at(step, words.end[stay] + 1, 1)
    keep = np.cumsum(step[: len(raw)], dtype=np.int8) > 0
    keep[words.end[last[has] - 1]] = False
    total = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[words.text_start]
    if total[-1] >= 1 << 31:
        return pa.array([bytes(raw[a:b][keep[a:b]]).decode() for a, b in zip(words.text_start, words.text_start[1:], strict=False)], pa.large_string())
    return pa.StringArray.from_buffers(len(total) - 1, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(raw[keep]))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single spaces) and removed (the maximal repeats: ranges of words, from 0, end excluded) of each row of ``docs`` (doc_id, text; other columns, whatever their names, are ignored).

    A word goes if a window of ``width`` words of its document that covers it equals one that starts earlier: in a document of smaller
    id, or earlier in the same. Windows are judged on the input. Null ids come last; of rows that share an id, null
    or not, that with the smaller hash of its text comes first, and rows that repeat id and text come one after the other, so the later one
    loses what the first has. Null texts have no words. A text with fewer words than a window loses none. An empty table gives an empty one. Texts are read
    whole; one takes some 200 bytes for each of its words while it is worked on.
    """
    if width < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    C.shared_dir(spark)
    scratch, name = C.Scratch(spark), f"chunks_{uuid.uuid4().hex}"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    ranges, buckets = min(MAX_RANGES, size // RANGE_BYTES + 1), size // BUCKET_BYTES + 1

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = base.repartitionByRange(ranges, *order, F.monotonically_increasing_id().asc()).withColumn("part", F.spark_partition_id())
    cut = ranged.sortWithinPartitions(*order).mapInArrow(_cut, _CHUNKS)
    # Chunks keep their place: a table in buckets meets its replies without moving the texts again.
    scratch.paths.append(path := C.new_path(spark, "chunks"))
    cut.write.format("parquet").option("path", path).option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(ranges, "part").saveAsTable(name)
    chunks = spark.table(name)

    def ask_blocks(batches: Iterator) -> Iterator:
        for row, c in _chunks(buckets, width, batches):
            others = np.setdiff1d(c.probes, c.blocks)
            sent = [(k, x, y) for k, (x, y) in enumerate(zip(c.by_bucket(c.blocks), c.by_bucket(others), strict=True)) if x or y]
            yield _table({"part": [row["part"]] * len(sent), "chunk": [row["chunk"]] * len(sent), "bucket": [k for k, _, _ in sent], "keys": [x for _, x, _ in sent], "others": [y for _, _, y in sent]}, _ASKED)
        C._give_back()

    def ask_windows(batches: Iterator) -> Iterator:
        for row, c in _chunks(buckets, width, batches):
            starts = c.candidates(c.repeated_here() | _bits(row["replies"], "block", c.blocks >> U(32)))
            at, keys, _, _ = c.sequences(starts)
            edges = np.searchsorted(at, np.arange(buckets + 1, dtype=U))
            sent = [(k, _pack(keys[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            yield _table({"part": [row["part"]] * len(sent), "chunk": [row["chunk"]] * len(sent), "bucket": [k for k, _ in sent], "keys": [x for _, x in sent], "others": [b""] * len(sent)}, _ASKED)
        C._give_back()

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row, c in _chunks(buckets, width, batches):
            starts = c.candidates(c.repeated_here() | _bits(row["replies"], "block", c.blocks >> U(32)))
            at, _, which, later = c.sequences(starts)
            starts = starts[later | _bits(row["replies"], "window", at)[which]]
            step = np.zeros(len(c.words) + 1, np.int64)
            np.add.at(step, starts, 1)
            np.subtract.at(step, starts + width, 1)
            gone = np.cumsum(step)[:-1] > 0
            first, n = c.words.first, np.concatenate(([0], np.cumsum(gone)))
            inside = np.zeros(len(gone), bool)  # words that go on a run of their document
            inside[1:] = gone[1:] & gone[:-1] & (c.words.doc[1:] == c.words.doc[:-1])
            begin, end = np.flatnonzero(gone & ~inside), np.flatnonzero(gone & ~np.append(inside[1:], False)) + 1
            offset = first[c.words.doc[begin]] if len(begin) else begin
            spans = pa.StructArray.from_arrays([pa.array((begin - offset).astype(np.int32)), pa.array((end - offset).astype(np.int32))], ["from", "to"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(np.diff(first)), pa.array(np.diff(n[first])), _kept(c.words, gone).cast(pa.string()), pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, first).astype(np.int32)), spans)],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )
        C._give_back()

    def answered(*replies: DataFrame) -> DataFrame:
        """Chunks with what came back to them."""
        every = None
        for kind, x in zip(("block", "window"), replies, strict=False):
            x = x.withColumn("kind", F.lit(kind))
            every = x if every is None else every.unionByName(x)
        # Dealt as the table is, so that Spark moves the replies to the chunks and not the chunks.
        for_part = every.repartition(ranges, "part").groupBy("part").agg(F.collect_list(F.struct("chunk", "kind", "bucket", "bits")).alias("replies"))
        return chunks.join(for_part, "part", "left").withColumn("replies", F.filter("replies", lambda x: x["chunk"] == F.col("chunk")))

    asked = chunks.mapInArrow(ask_blocks, _ASKED)
    hits = scratch.keep(asked.groupBy("bucket").applyInArrow(_hit_blocks, _REPLY), "hits")
    windows = answered(hits).mapInArrow(ask_windows, _ASKED)
    seen = scratch.keep(windows.groupBy("bucket").applyInArrow(_seen_before, _REPLY), "seen")
    out = C.Scratch(spark).keep(answered(hits, seen).mapInArrow(remove, _RESULT), "deduplicated")  # read by the caller
    spark.sql(f"DROP TABLE {name}")
    scratch.drop()
    return out


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words or more that stand earlier."""
    found = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS words FROM documents),
win AS (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH} + 2)) AS i FROM w WHERE len(words) >= {WIDTH}),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + {WIDTH} - 1], ' ') ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM g WHERE r > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
