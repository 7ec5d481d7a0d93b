"""Long texts in the n-gram Jaccard join: the index's second form, and what the driver plans for keys that aren't hot."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import _common as C
from palimpsest.llm import jaccard_join


def test_two_forms_of_entries_never_miss_a_pair(monkeypatch):
    """Sets on either side of ``long_from`` that link have an entry in common, whatever classes their tokens have."""
    r = np.random.default_rng(5)
    for bits in (1, 4):
        monkeypatch.setattr(jaccard_join, "LONG_BITS", bits)
        for a, b in ((4, 5), (9, 10)):
            ks = jaccard_join.combination_sizes(a, b)
            for _ in range(1000):
                x = np.unique(r.integers(1, 1 << 62, int(r.integers(1, 110)))).astype(np.uint64)
                lost = int(r.integers(0, max(1, (b - a) * len(x) // b + 1)))
                y = np.unique(np.concatenate((r.permutation(x)[lost:], r.integers(1, 1 << 62, int(r.integers(0, lost + 2))).astype(np.uint64))))
                both = len(np.intersect1d(x, y))
                if not both or b * both < a * (len(x) + len(y) - both):
                    continue
                union = np.union1d(x, y)
                level = r.choice(5, len(union), p=r.dirichlet(np.ones(5))).astype(np.int8)
                token, doc = np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)])
                one, other = jaccard_join._entries_of(doc, token, np.array([0, len(x), len(token)]), level[np.searchsorted(union, token)], a, b, ks)[1].to_pylist()
                assert set(one) & set(other) or set(x.tolist()) == set(y.tolist())


def test_long_texts_that_share_single_runs_have_no_list(spark):
    """Each two of these texts have 30 scattered runs of three words in common, and each is rare."""
    rows = []
    for i in range(12):
        text = []
        for j in range(12):
            if j != i:
                for k in range(30):
                    text += [f"s{min(i, j)}_{max(i, j)}_{k}_{x}" for x in range(3)] + [f"o{i}_{j}_{k}_{x}" for x in range(6)]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(jaccard_join.frequent_tokens(docs, 3))
    described = jaccard_join._described(docs, shared, 3, 9, 10, jaccard_join.combination_sizes(9, 10))
    lists = described.select("cls", F.explode("entries").alias("sig")).distinct().groupBy("sig").count()
    assert described.agg(F.min("n")).first()[0] > 2 * jaccard_join.long_from(9, 10)
    assert lists.where("count > 1").count() <= 5  # neighbours in hash order by chance


def test_pairs_meet_without_plans_for_hot_keys(spark, monkeypatch):
    """Keys that aren't hot need no broadcast; hot ones give the same rows."""
    C.shared_dir(spark)
    scratch = C.Scratch(spark)
    pairs = scratch.keep(spark.range(3000).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")), "pairs")
    side = lambda c, v: scratch.keep(spark.range(3001).select(F.col("id").alias(c), (F.col("id") * 2).alias(v)), "side")
    plain = jaccard_join._meet(pairs, side("x", "s"), side("y", "t"), scratch)
    assert "hot" not in plain._jdf.queryExecution().toString() and "_parts" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(jaccard_join, "SPLIT", 1 << 20)  # all are hot
    dealt = jaccard_join._meet(pairs, side("x", "s"), side("y", "t"), scratch)
    same = lambda d: sorted(map(tuple, d.select("x", "y", "s", "t").collect()))
    assert same(plain) == same(dealt) == [(i, i + 1, 2 * i, 2 * i + 2) for i in range(3000)]
    scratch.drop()


def test_small_tables_have_no_hot_keys(spark, monkeypatch):
    """A key of few rows gets no table and no broadcast of its own, also where it is a large part of all; without the lower bound, and in groups above it, hot keys give the same rows."""
    C.shared_dir(spark)
    kept, keep = [], C.Scratch.keep
    monkeypatch.setattr(C.Scratch, "keep", lambda self, df, name: (kept.append(name), keep(self, df, name))[1])

    def found(groups, size):
        kept.clear()
        rows = [(100 * g + i, " ".join(f"g{g}w{k}" for k in range(200)) + f" end{i}") for g in range(groups) for i in range(size)]
        out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in out} == {(i, i // 100 * 100) for i, _ in rows} and len(out) == len(rows)
        return kept.count("hot")

    assert found(3, 5) == 0
    assert found(2, 90) > 0
    monkeypatch.setattr(jaccard_join, "LEAST_HOT", 0)
    assert found(3, 5) > 0
    for most in (1, 20):
        monkeypatch.setattr(jaccard_join, "MAX_HOT", most)
        found(2, 12)
    pairs = C.Scratch(spark).keep(spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 50) for i in range(1, 30)], "x long, y long"), "pairs")
    side = lambda c, v: spark.range(60).select(F.col("id").alias(c), (F.col("id") * 2).alias(v))
    met = jaccard_join._meet(pairs, side("x", "s"), side("y", "t"), C.Scratch(spark)).select("x", "y", "s", "t").collect()
    assert sorted(map(tuple, met)) == sorted((r["x"], r["y"], 2 * r["x"], 2 * r["y"]) for r in pairs.collect())
