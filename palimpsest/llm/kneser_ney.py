"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, kept as sorted arrays, mapped by the workers.

Words go by a 64-bit hash; a word's number is its place in the sorted array of all training hashes, so a
bigram is one exact 64-bit key of two numbers. Each array is cut by key into shards and these into files of
SHARD_ROWS keys at most, in the shared folder, which executors map into memory; a file is written by one task to a name
of its own and then renamed, so a repeated task does no harm. A first word with more than a shard's part of all
tokens has its bigrams cut by the second word too, so no shard grows with one word. Nothing of the vocabulary or the
counts goes through the driver, which gets a line for each file, and the cuts, a few for each shard.

Order 3 keeps the trigrams that occur twice or more. Both bigrams of such a one occur twice too, so only those are counted,
and none is missed. What trigrams that occur once would hold of a context goes to the bigrams under it, which keep their
own counts: the counts by different predecessors, which Kneser-Ney takes there, would need all trigrams.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: The hash that stands for the end of a text.
END = 0x5851F42D4C957F2D
#: Keys of a file, which a writing task holds in memory.
SHARD_ROWS = 1_000_000
#: Bits of a file's number that tell the files of one shard apart.
FILE_BITS = 24
#: Files of one array that a worker holds mapped; a system bounds the maps of a process, often at 65,530.
MAX_MAPS = 8192
#: Distinct keys that a counting task holds before it passes them on.
HELD_KEYS = 4_000_000
OUT_ROWS = 250_000
#: Numbers of words are halves of a bigram's key, of which the higher one has a sign.
MOST_WORDS = (1 << 31) - 1


#: A map holds no file open where Python can leave that out, so the number of files has no limit of open files.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


class Arrays:
    """Sorted int64 keys with columns of values from 0 up, in files that follow each other in key order. A file holds its keys, then its values as wide as its greatest one needs."""

    def __init__(self, path: str, columns: int, files: list[tuple[int, int, int]]):
        #: files: number, first key, rows; numbers rise with the keys
        self.path, self.columns, self.files = path, columns, sorted(files)
        self._maps: dict[int, object] = {}

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.files)

    @cached_property
    def _bounds(self):
        """The first key of each file, and how many rows lie before it."""
        import numpy as np

        rows = np.array([n for _, _, n in self.files], np.int64)
        return np.array([first for _, first, _ in self.files], np.int64), np.cumsum(rows) - rows

    def part(self, i: int):
        """(rows before it, (keys, columns)) of the i-th file."""
        import numpy as np

        if i not in self._maps:
            number, _, n = self.files[i]
            with open(f"{self.path}/{number}", "rb") as file:
                whole = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED)
            if len(self._maps) >= MAX_MAPS:
                del self._maps[next(iter(self._maps))]
            wide = (len(whole) - 8 * n) // (n * self.columns)
            self._maps[i] = np.frombuffer(whole, np.int64, n), np.frombuffer(whole, f"u{wide}", offset=8 * n).reshape(self.columns, n)
        return self._bounds[1][i], self._maps[i]

    def find(self, keys):
        """(place in the whole array or -1, values or 0) of each of ``keys``, which are sorted."""
        import numpy as np

        place, values = np.full(len(keys), -1, np.int64), np.zeros((self.columns, len(keys)), np.int64)
        bounds = np.append(np.searchsorted(keys, self._bounds[0]), len(keys))
        for i in np.flatnonzero(bounds[1:] > bounds[:-1]):
            lo, hi = bounds[i], bounds[i + 1]
            before, (own, held) = self.part(i)
            at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
            hit = own[at] == keys[lo:hi]
            place[lo:hi] = np.where(hit, at + before, -1)
            values[:, lo:hi] = np.where(hit, held[:, at], 0)
        return place, values

    def look_up(self, keys):
        """As ``find``, for keys in any order."""
        import numpy as np

        distinct, back = np.unique(keys, return_inverse=True)
        place, values = self.find(distinct)
        return place[back], values[:, back]


def write_arrays(df: DataFrame, path: str, columns: list[str], extra=None, least: int = 0) -> tuple[list[tuple[int, int, int]], DataFrame | None]:
    """Writes ``df`` (shard, key, ``columns``) as Arrays, rows of one key summed, those with ``least`` in the first column, and returns the files.

    ``shard`` must not fall as ``key`` rises. A file's number is its shard's, then its place in the shard; files are cut after
    SHARD_ROWS keys whatever batches the rows come in, so a repeated task writes the same ones. ``extra(keys, values)`` may give
    record batches of further rows; these and the files come back as one table that is written beside the arrays.
    """
    import numpy as np
    import pyarrow as pa

    where = C.local_path(path)
    os.makedirs(where, exist_ok=True)
    names = list(columns)

    def write(batches: Iterator) -> Iterator:
        open_shard, piece, parts, held, last = None, 0, [], 0, None

        def flush(block):
            nonlocal open_shard, piece, held
            block = block[:, block[2] >= least] if least else block
            shards, keys = block[0], block[1]
            edges = np.append(np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)), len(shards))
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if shards[at] != open_shard:
                    yield from close()
                    open_shard, piece = shards[at], 0
                while at < to:
                    n = min(SHARD_ROWS - held, to - at)
                    parts.append(np.ascontiguousarray(block[1:, at : at + n]))
                    at, held = at + n, held + n
                    if held == SHARD_ROWS:
                        yield from close()
            if extra is not None and len(keys):
                yield from (("x", x) for x in extra(keys, block[2:]))

        def close():
            nonlocal parts, held, piece
            if parts:
                whole = np.concatenate(parts, axis=1)
                number = int(open_shard) << FILE_BITS | piece
                name = f"{where}/{uuid.uuid4().hex}.tmp"
                top = int(whole[1:].max())
                with open(name, "wb") as out:
                    out.write(whole[0].tobytes())
                    out.write(whole[1:].astype(next(t for t in ("u1", "u2", "u4", "u8") if top <= np.iinfo(t).max)).tobytes())
                os.replace(name, f"{where}/{number}")
                yield "s", (number, int(whole[0, 0]), whole.shape[1])
                parts, held, piece = [], 0, piece + 1

        def steps():
            nonlocal last
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "key", *names)])
                if last is not None:
                    block = np.concatenate((last, block), axis=1)
                new = np.flatnonzero(np.concatenate(([True], block[1, 1:] != block[1, :-1])))
                block = np.concatenate((block[:2, new], np.add.reduceat(block[2:], new, axis=1)))
                last = block[:, -1:]  # its key may go on in the next batch
                yield from flush(block[:, :-1])
            if last is not None:
                yield from flush(last)
            yield from close()

        for kind, x in steps():
            if kind == "s":
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (-1, *x)], ["kind", "id", "a", "b"])
            else:
                for at in range(0, x.num_rows, OUT_ROWS):
                    yield x.slice(at, OUT_ROWS)

    spark = df.sparkSession
    done = df.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(write, "kind long, id long, a long, b long")
    if extra is None:
        return [(r["id"], r["a"], r["b"]) for r in done.collect()], None
    # Sums go by kind and id at once; a file's line is the only one of its kind and id.
    table = done.groupBy("kind", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    table.write.parquet(f"{path}-extra")
    table = spark.read.schema(table.schema).parquet(f"{path}-extra")
    return [(r["id"], r["a"], r["b"]) for r in table.where("kind = -1").collect()], table.where("kind >= 0")


def _tokens(texts: list[bytes]):
    """(hash of each token, its text, where texts start): lower-cased words and one end for each text."""
    import numpy as np

    from ._tokens import Words

    words = Words(texts)
    n = np.diff(words.first)
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(words) + len(n), END, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words.hash.view(np.int64)
    return out, np.repeat(np.arange(len(n)), n + 1), ends - n


def _counted(keys: Iterator) -> Iterator:
    """Record batches (key, n) of the keys that come in arrays, equal ones mostly together."""
    import numpy as np
    import pyarrow as pa

    def out(k, n):
        for at in range(0, len(k), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + OUT_ROWS]), pa.array(n[at : at + OUT_ROWS])], ["key", "n"])

    def merged(parts):
        k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[new], np.add.reduceat(n, new)

    parts, size = [], 0
    for block in keys:
        if len(block):
            parts.append(np.unique(block, return_counts=True))
            size += len(parts[-1][0])
        if size > HELD_KEYS:
            parts = [merged(parts)]
            size = len(parts[0][0])
            if size > HELD_KEYS // 2:
                yield from out(*parts[0])
                parts, size = [], 0
    if parts:
        yield from out(*merged(parts))


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more, from how many keys are counted once to four times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), i + 0.99) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


@dataclass
class Model:
    """What workers need: the mapped arrays and a few sums."""

    path: str
    words: Arrays  # hash -> count
    bigrams: Arrays  # number of the first word << 32 | number of the second -> count
    contexts: Arrays  # number of a word, or of the start -> count as a first word, seconds counted once, twice, more often
    followers: Arrays  # number of a word -> different first words
    tokens: int
    types: int = 0
    discounts: tuple = ()
    low_discounts: tuple = ()
    low_types: tuple = field(default=(0, 0, 0))
    #: Of order 3: place of the first bigram * span + number of the third word -> count; place -> count of its trigrams, how many occur twice, more often.
    trigrams: Arrays | None = None
    pairs: Arrays | None = None
    top_discounts: tuple = ()

    @property
    def start(self) -> int:
        return self.words.rows

    def bigrams_of(self, texts: list[bytes]):
        """(numbers of tokens, their counts, numbers of the tokens before, places of the bigrams, their counts, text of each token, where texts start); -1 and 0 for what is unknown."""
        import numpy as np

        hashes, doc, starts = _tokens(texts)
        word, (count,) = self.words.look_up(hashes)
        previous = np.concatenate(([0], word[:-1]))
        previous[starts] = self.start
        both = (word >= 0) & (previous >= 0)
        place, (n,) = self.bigrams.look_up(np.where(both, previous << 32 | np.maximum(word, 0), -1))
        return word, count, previous, place, n, doc, starts

    @property
    def span(self) -> int:
        return self.words.rows + 1

    def score(self, texts: list[bytes]):
        """n_tokens, n_known, base_score, score of each text."""
        import numpy as np

        word, count, previous, place, n, doc, starts = self.bigrams_of(texts)
        total = lambda x: np.bincount(doc, x, len(texts))
        base = np.log10((count + 1) / (self.tokens + self.words.rows + 1))

        # The distribution of a word by its different predecessors, and one equal part for each word and one unknown.
        d = np.array([0.0, *self.low_discounts])
        spread = sum(a * b for a, b in zip(self.low_discounts, self.low_types, strict=True)) / max(self.types, 1)
        _, (kinds,) = self.followers.look_up(word)
        low = np.maximum(kinds - d[np.minimum(kinds, 3)], 0) / max(self.types, 1) + (spread if self.types else 1.0) / (self.words.rows + 1)

        d = np.array([0.0, *self.discounts])
        _, (seen, once, twice, more) = self.contexts.look_up(previous)
        left = (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(seen, 1)
        high = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(seen, 1)
        p = np.where(seen > 0, high + left * low, low)
        if self.trigrams is not None:
            d = np.array([0.0, *self.top_discounts])
            context, all_ = np.concatenate(([-1], place[:-1])), np.maximum(np.concatenate(([0], n[:-1])), 1)
            context[starts] = -1
            _, (held, twice, more) = self.pairs.look_up(context)
            _, (n,) = self.trigrams.look_up(np.where((held > 0) & (word >= 0), context * self.span + word, -1))
            p = (n - d[np.minimum(n, 3)]) / all_ + (1 - (held - d[2] * twice - d[3] * more) / all_) * p
        return total(np.ones(len(doc))).astype(np.int64), total(count > 0).astype(np.int64), total(base), total(np.log10(p))

    def delete(self) -> None:
        """Removes the arrays; tables scored by the model can't be computed after."""
        C.remove(self.path)


def _shards(spark: SparkSession, rows: int) -> int:
    """Shards for about ``rows`` keys: half a file each, but some for each task of a shuffle."""
    return max(-(-rows // SHARD_ROWS) * 2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shard_of(key, span: int, shards: int):
    """A number that rises with a key of 0 to span - 1."""
    return F.floor(key.cast("double") * shards / max(span, 1)).cast("long")


def _per_file(spark: SparkSession, arrays: Arrays, rows_of, schema: str) -> DataFrame:
    """The rows, as arrays of longs, that ``rows_of(i, rows before, keys, columns)`` gives for each file."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in b["id"].to_pylist():
                before, (keys, held) = arrays.part(i)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows_of(i, before, keys, held.astype("int64"))], [c.split()[0] for c in schema.split(", ")])

    files = len(arrays.files)
    return spark.range(0, files, 1, max(1, min(files, spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)


def _heavy(spark: SparkSession, vocabulary: Arrays, shards: int) -> tuple[int, list[tuple[int, int]]]:
    """All tokens, and (number, count) of each first word with more than one of so many parts of them, which are fewer than ``shards``."""
    tokens = _per_file(spark, vocabulary, lambda _, before, keys, held: (held[0].sum(keepdims=True),), "n long").agg(F.sum("n")).first()[0] or 0

    def above(_, before, keys, held):
        import numpy as np

        at = np.flatnonzero(held[0] > tokens // shards)
        # The end of a text is never a first word; its start, which occurs as often, is.
        return np.where(keys[at] == END, vocabulary.rows, at + before), held[0][at]

    return tokens, [(r["id"], r["n"]) for r in _per_file(spark, vocabulary, above, "id long, n long").collect()]


def _cuts(span: int, shards: int, tokens: int, heavy: list[tuple[int, int]]):
    """Sorted bigram keys at which shards begin: equal ranges of first words, and within a heavy one as many ranges of second words as its share of the tokens asks for."""
    import numpy as np

    cuts = [np.arange(1, shards, dtype=np.int64) * span // shards << 32]
    for number, count in heavy:
        parts = -(-count * shards // tokens)
        cuts.append(np.append((number << 32) + np.arange(parts, dtype=np.int64) * span // parts, (number + 1) << 32))
    return np.unique(np.concatenate(cuts))


def _trigram_cuts(spark: SparkSession, model: Model):
    """Sorted trigram keys at which shards begin: after equal parts of the tokens that follow bigrams which occur twice, and within one with more than a part of them, at as many ranges of third words."""
    import numpy as np

    end = int(model.words.look_up(np.array([END]))[0][0])

    def weights(keys, held):
        return np.where((held[0] > 1) & (keys & 0xFFFFFFFF != end), held[0], 0)

    sums = _per_file(spark, model.bigrams, lambda i, _, keys, held: (np.array([i]), weights(keys, held).sum(keepdims=True)), "i long, n long")
    n = np.zeros(len(model.bigrams.files) + 1, np.int64)
    for r in sums.collect():  # a line for each file
        n[r["i"] + 1] = r["n"]
    before, tokens = np.cumsum(n), int(n.sum())
    part = max(1, tokens // _shards(spark, tokens))

    def cuts(i, rows, keys, held):
        w = weights(keys, held)
        reached = (before[i] + np.cumsum(w)) // part
        at = rows + np.flatnonzero(np.diff(reached, prepend=before[i] // part))
        heavy = np.flatnonzero(w > part)
        within = [(rows + b) * model.span + np.arange(k, dtype=np.int64) * model.span // k for b, k in zip(heavy.tolist(), (-(-w[heavy] // part)).tolist(), strict=True)]
        return (np.concatenate([(at + 1) * model.span, *within]),)

    return np.array(sorted({r["key"] for r in _per_file(spark, model.bigrams, cuts, "key long").collect()}), np.int64)


def _add_trigrams(model: Model, path: str, texts: DataFrame) -> None:
    """Counts the trigrams of ``texts`` that occur twice or more into ``model``."""
    import numpy as np

    spark = texts.sparkSession
    if model.bigrams.rows * model.span >= 2**63:
        raise ValueError("bigrams times words pass a 64-bit key: train with order=2")
    cuts = _trigram_cuts(spark, model)

    def trigrams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ._tokens import as_bytes

        def keys():
            for b in C.text_blocks(batches):
                word, _, _, place, n, _, starts = model.bigrams_of(as_bytes(b["text"]))
                again = n > 1
                again[1:] &= n[:-1] > 1
                again[starts] = False
                at = np.flatnonzero(again)
                yield place[at - 1] * model.span + word[at]

        for b in _counted(keys()):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, b["key"].to_numpy(), "right"))], ["key", "n", "shard"])

    def sums(keys, values):
        """Rows (kind, id, a, b): 10 of a bigram, its trigrams' count and how many occur twice and, times 2**32, more often; 30 of how often a trigram occurs."""
        import pyarrow as pa

        first, n = keys // model.span, values[0]
        new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        often, times = np.unique(np.minimum(n, 5), return_counts=True)
        for kind, ids, a, b in ((10, first[new], np.add.reduceat(n, new), np.add.reduceat(np.where(n == 2, 1, 1 << 32), new)), (30, often, times, np.zeros_like(times))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind)), pa.array(ids), pa.array(a), pa.array(b)], ["kind", "id", "a", "b"])

    files, extra = write_arrays(texts.mapInArrow(trigrams, "key long, n long, shard long"), f"{path}/trigrams", ["n"], sums, least=2)
    by_pair = extra.where("kind = 10")
    shard = _shard_of(F.col("id"), model.bigrams.rows, _shards(spark, by_pair.count())).alias("shard")
    split = by_pair.select(shard, F.col("id").alias("key"), F.col("a").alias("n"), F.col("b").bitwiseAND((1 << 32) - 1).alias("twice"), F.shiftright("b", 32).alias("more"))
    pairs = Arrays(C.local_path(f"{path}/pairs"), 3, write_arrays(split, f"{path}/pairs", ["n", "twice", "more"])[0])
    counts = {r["id"]: r["a"] for r in extra.where("kind = 30").collect()}  # four rows at most
    known, n_texts = by_pair.agg(F.sum("a")).first()[0] or 0, int(model.words.look_up(np.array([END]))[1][0][0])
    counts[1] = model.tokens - n_texts - known  # every token but a text's first ends a trigram
    model.trigrams, model.pairs, model.top_discounts = Arrays(C.local_path(f"{path}/trigrams"), 1, files), pairs, _discounts(counts)
    C.remove(f"{path}/trigrams-extra")


def train(docs: DataFrame, order: int = 2) -> Model:
    """A model of the texts of ``docs`` (text; other columns are ignored). A null text counts as empty: it has an end only. Of an empty table, every word is unknown. Repeated rows count each; texts are read whole, in blocks."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    path = C.new_path(spark, "ngrams")
    texts = docs.select("text")

    def unigrams(batches: Iterator) -> Iterator:
        from ._tokens import as_bytes

        return _counted(_tokens(as_bytes(b["text"]))[0] for b in C.text_blocks(batches))

    words = texts.mapInArrow(unigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bits = _shards(spark, 0).bit_length()
    files, _ = write_arrays(words.select(F.shiftright("key", 64 - bits).alias("shard"), "key", "n"), f"{path}/words", ["n"])
    vocabulary = Arrays(C.local_path(f"{path}/words"), 1, files)
    size = vocabulary.rows
    if size >= MOST_WORDS:
        raise ValueError(f"{size} words and a place for starts pass the halves of a 64-bit key")
    shards = _shards(spark, 20 * size)
    cuts = _cuts(size + 1, shards, *_heavy(spark, vocabulary, shards))

    def bigrams(batches: Iterator) -> Iterator:
        from ._tokens import as_bytes

        def keys():
            import numpy as np

            for b in C.text_blocks(batches):
                hashes, _, starts = _tokens(as_bytes(b["text"]))
                word, _ = vocabulary.look_up(hashes)
                previous = np.concatenate(([0], word[:-1]))
                previous[starts] = size
                yield previous << 32 | word

        import numpy as np
        import pyarrow as pa

        for b in _counted(keys()):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, b["key"].to_numpy(), "right"))], ["key", "n", "shard"])

    def sums(keys, values):
        """Rows (kind, id, a, b): 10 of a first word, its count and seconds counted once, 11 those counted twice and more often, 20 of a second, 30 of how often a bigram occurs."""
        import numpy as np
        import pyarrow as pa

        first, n = keys >> 32, values[0]
        new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        by_first = [np.add.reduceat(x.astype(np.int64), new) for x in (n, n == 1, n == 2, n > 2)]
        rows = [(10, first[new], *by_first[:2])]
        several = (by_first[2] > 0) | (by_first[3] > 0)
        rows.append((11, first[new][several], by_first[2][several], by_first[3][several]))
        rows += [(kind, *np.unique(x, return_counts=True), None) for kind, x in ((20, keys & 0xFFFFFFFF), (30, np.minimum(n, 5)))]
        for kind, ids, a, b in rows:
            b = np.zeros(len(ids), np.int64) if b is None else b
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind)), pa.array(ids), pa.array(a.astype(np.int64)), pa.array(b)], ["kind", "id", "a", "b"])

    files, extra = write_arrays(texts.mapInArrow(bigrams, "key long, n long, shard long"), f"{path}/bigrams", ["n"], sums)
    model = Model(C.local_path(path), vocabulary, Arrays(C.local_path(f"{path}/bigrams"), 1, files), None, None, 0)

    shard = _shard_of(F.col("id"), size + 1, _shards(spark, size)).alias("shard")
    by_first = extra.where("kind IN (10, 11)").select(shard, F.col("id").alias("key"), *(F.when(F.col("kind") == 10 + i // 2, F.col("ab"[i % 2])).otherwise(0).alias(f"v{i}") for i in range(4)))
    model.contexts = Arrays(C.local_path(f"{path}/contexts"), 4, write_arrays(by_first, f"{path}/contexts", [f"v{i}" for i in range(4)])[0])
    by_second = extra.where("kind = 20")
    model.followers = Arrays(C.local_path(f"{path}/followers"), 1, write_arrays(by_second.select(shard, F.col("id").alias("key"), F.col("a").alias("v")), f"{path}/followers", ["v"])[0])
    of = lambda rows: {r["c"]: r["n"] for r in rows.collect()}  # noqa: E731  five rows at most
    counts = of(extra.where("kind = 30").select(F.col("id").alias("c"), F.col("a").alias("n")))
    low = of(by_second.groupBy(F.least("a", F.lit(5)).alias("c")).agg(F.count("*").alias("n")))
    model.tokens = extra.where("kind = 10").agg(F.sum("a")).first()[0] or 0
    model.types = sum(counts.values())
    model.discounts, model.low_discounts = _discounts(counts), _discounts(low)
    model.low_types = (low.get(1, 0), low.get(2, 0), sum(n for c, n in low.items() if c > 2))
    C.remove(f"{path}/bigrams-extra")  # all of it is in the arrays and sums
    if order == 3:
        _add_trigrams(model, path, texts)
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score, score of each row of ``docs`` (text).

    A null or empty text has its end only; an empty table gives no rows; rows that repeat each other score alike; a text of any
    length is scored whole; a column of ``keep`` that is named as a result is left out.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_known", "base_score", "score"))

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ._tokens import as_bytes

        for b in C.text_blocks(batches):
            out = model.score(as_bytes(b["text"]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *map(pa.array, out)], [*keep, "n_tokens", "n_known", "base_score", "score"])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_tokens long, n_known long, base_score double, score double"])
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(scored, schema)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a bigram model of those whose crc32 of the id leaves other than 2 modulo 7."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"), (C.crc32_text(F.col("doc_id")) % 7 == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return score(docs, model, "doc_id", "held_out").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
