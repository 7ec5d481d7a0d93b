"""Removal of repeated passages against all windows compared by themselves."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import substring_dedup

SCHEMA = "doc_id long, text string, part int, chunk int, kept string, bucket string"


def brute(rows, width):
    """Rows in the operator's order: id, null last, then hash of the text; equal rows one after the other."""
    seed = lambda t: np.int64(np.uint64(xxhash.xxh64((t or "").encode(), seed=42).intdigest()).astype(np.int64))
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, seed(r[1])))
    seen, out = set(), []
    for i, text in ((r[0], r[1]) for r in ordered):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        runs = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), list(zip(runs[::2], runs[1::2], strict=True))))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [(x["from"], x["to"]) for x in r["removed"]])) for r in df.collect())


def rows_of():
    pick = random.Random(3)
    word = lambda: pick.choice(["the", "of", "Öl", "你好", "a1", "b2", "c3"]) + str(pick.randrange(40))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(n) for n in (19, 20, 21, 29, 30, 60, 200)]
    texts = [None, "", " \t\n", "one", "x " * 500, "x " * 19, "x " * 20, "x " * 21, "ab cd " * 60, "\x1cx\x1c y z " * 30]
    for _ in range(60):
        parts = [fresh(pick.randrange(40)) if pick.random() < 0.5 else pick.choice(shared) for _ in range(pick.randrange(1, 7))]
        texts.append(pick.choice([" ", "\n", "  \t"]).join(x for p in parts for x in p))
    texts.append(" ".join(fresh(3000) + shared[5] + fresh(40_000) + shared[5]))
    ids = pick.sample(range(-50, 900), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[20]), (None, "no id " * 30), (ids[5], texts[30]), (ids[5], texts[31])] + [(ids[33], texts[33])] * 25
    return [(i, t, 1, 2, "k", "b") for i, t in rows]


@pytest.mark.parametrize(("width", "sizes"), [(20, (8 << 20, 8 << 20, 32 << 20)), (20, (3000, 20_000, 10_000)), (7, (5000, 9000, 30_000))])
def test_equals_brute_force(spark, monkeypatch, width, sizes):
    """In one chunk, and in many chunks, buckets and ranges."""
    for name, x in zip(("CHUNK_BYTES", "BUCKET_BYTES", "RANGE_BYTES"), sizes, strict=True):
        monkeypatch.setattr(substring_dedup, name, x)
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    import functools

    cut = substring_dedup._cut

    def small(batches, size=sizes[0]):  # the worker's own module keeps its constants
        substring_dedup.CHUNK_BYTES = size
        return cut(batches)

    monkeypatch.setattr(substring_dedup, "_cut", functools.partial(small))
    assert found(substring_dedup.dedup(docs, width)) == brute(rows, width)


def test_hot_passage_and_copies(spark):
    """A third of all rows are one text; every document shares a passage."""
    line = " ".join(f"w{k}" for k in range(25))
    rows = [(i, f"{line} own {i}" if i % 3 else line, 1, 2, "k", "b") for i in range(600)]
    out = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert found(out) == brute(rows, 20)
    assert out.agg(F.sum("n_removed")).first()[0] == 25 * 599 + 399  # "own" follows the passage in 400


def test_empty_table(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup(spark.createDataFrame([], SCHEMA), 1)


def test_packing():
    for dtype in (np.uint32, np.uint64):
        x = np.unique(np.random.default_rng(1).integers(0, np.iinfo(dtype).max, 1000, dtype))
        assert (substring_dedup._unpack(substring_dedup._pack(x), dtype) == x).all()
        assert len(substring_dedup._unpack(b"", dtype)) == 0
