"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing names."""

import hashlib
import math
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fingerprints, jaccard_join, kneser_ney, license_scan, mixing, quality_classifier, quality_rules, sampled_pieces, secret_scan, sharding
from palimpsest.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, range string, cls string, failed string"


def words(text):
    return (text or "").encode().lower().split()


def rows_of():
    base = " ".join(f"word{i}" for i in range(120))
    texts = [
        None, "", " \t\n", "one", "one two", base, base, base.replace("word7 ", "other "), base.upper(), base + " tail", "a\nb\na\nb\n\n", "same same same same same",
        " ".join(f"w{i * i % 997}" for i in range(20_000)), "Öl é 你好 \U0001f600 ▁ x", "the quick brown fox " * 30, 'token = "0123456789abcdef0123456789abcdef01234567" end', "All rights reserved.\nLicensed under CC BY-NC 4.0.",
    ]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, base), (3, ""), (15, base)]
    return [(i, t, "en", None if k % 5 == 0 else f"s{k % 2}", None if t is None else len(t), 0.5, 1, "r", "c", "f") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]))


def test_fingerprints(spark, odd, empty):
    out = fingerprints.edits(odd).collect()
    assert len(out) == len(rows_of()) and fingerprints.edits(empty).count() == 0
    by_text = defaultdict(set)
    ordered = sorted(((i, t or "") for i, t, *_ in rows_of() if i is not None), key=lambda x: -x[0])
    assert [r["doc_id"] for r in out].count(None) == 2
    ids = Counter(i for i, _ in ordered)
    for (i, t), (j, nxt) in zip(ordered, ordered[1:], strict=False):
        if ids[i] == 1 and ids[j] == 1:
            row = next(r for r in out if r["doc_id"] == i)
            half = len(t) // 2
            assert row["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
            assert row["n_chars"] == len(t) and 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
            by_text[t].add(row["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = fingerprints.edits(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"aa").hexdigest() and row["near_next"] == 1.0


def test_fingerprints_add_up(spark):
    f = fingerprints
    a, b = F.lit("one two three\nfour five"), F.lit("six seven\none two three")
    both, turned = F.concat(a, F.lit("\n"), b), F.concat(b, F.lit("\n"), a)
    row = spark.range(1).select(
        f.render(f.fingerprint(both)), f.render(f.fingerprint(turned)), f.render(f.combine(f.fingerprint(a), f.fingerprint(b))), f.render(f.combine(f.fingerprint(both), f.fingerprint(b), -1)), f.render(f.fingerprint(a)), f.likeness(f.fingerprint(a), f.fingerprint(a))
    ).first()
    assert row[0] == row[1] == row[2] and row[3] == row[4] and row[0] != row[4] and row[5] == 1.0


def test_likeness_of_halves_and_long_texts(spark):
    f = fingerprints
    part = lambda x, n=300: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(f"{x}"), i.cast("string"))), " ")
    found = []
    for x in range(12):
        a, b = F.concat(part(f"a{x}_"), F.lit("\n"), part(f"b{x}_")), F.concat(part(f"a{x}_"), F.lit("\n"), part(f"c{x}_"))
        found.append(spark.range(1).select(f.likeness(f.fingerprint(a), f.fingerprint(b))).first()[0])
    assert abs(sum(found) / 12 - 0.5) < 0.03 and max(abs(x - 0.5) for x in found) < 0.1
    # More runs than a lane counts to, in sums near 0: a group of 2**21 runs of either sign, and twenty runs more.
    one = lambda sign: F.array(*((F.lit(sign * f._LANE_MASK) % f.PACKED_MOD).cast("long") for _ in range(f.PACKED * f.GROUPS)))
    lanes = F.struct(F.array_repeat(F.lit(0).cast("long"), f.EXACT_LANES).alias("exact"), F.transform(one(-1), lambda x: F.pmod(x * 1000, F.lit(f.PACKED_MOD))).alias("signs"), F.lit(1 << 21).cast("long").alias("runs"))
    more = f.combine(lanes, F.struct(lanes["exact"].alias("exact"), one(1).alias("signs"), F.lit(20).cast("long").alias("runs")))
    assert spark.range(1).select(f.likeness(lanes, more)).first()[0] > 0.9


def test_shards(odd, empty):
    for docs, k in ((odd, 24), (odd, 3), (odd, 1)):
        out = sharding.shard(docs, k).collect()
        assert len(out) == len(rows_of()) and {r["shard"] for r in out} <= set(range(k))
        sizes = [len((t or "").encode()) + 8 for _, t, *_ in rows_of()]
        assert sum(r["size"] for r in out) == sum(sizes)
        by = defaultdict(list)
        for r in out:
            by[r["shard"]].append(r)
        assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
        assert all(len({r["shard"] for r in out if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in out})
        groups = Counter()
        for _, t, *_ in rows_of():
            groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
        order = [groups[d] for d in sorted(groups)]

        def fits(c, order=order, k=k):
            n, at = 1, 0
            for s in order:
                n, at = (n + 1, s) if at + s > c else (n, at + s)
            return max(order) <= c and n <= k

        assert max(sum(r["size"] for r in rows) for rows in by.values()) == next(c for c in range(max(order), sum(order) + 1) if fits(c))
    assert sharding.shard(empty, 24).count() == 0


def test_shards_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    docs = spark.createDataFrame([(None, "same")] * 40 + [(5, "same")] * 9 + [(None, None)] * 3 + [(i, f"text {i % 11}") for i in range(50)], "doc_id long, text string")
    out = sharding.shard(docs, 4)
    rows = out.collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(t or "") + 8) for i, t in docs.collect())
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, sharding.shard(docs.repartition(5, F.rand(1)), 4).collect()), key=repr)


def test_shard_plans_match_brute_force():
    import random

    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice((1, 5, 9, 100)) for _ in range(r.randint(1, 40))]
        k = r.randint(1, 6)
        plan = sharding._Plan([(f"{i:04}", 1, s, s) for i, s in enumerate(sizes)], k)
        c = plan.capacity(False)
        cuts = [0, *plan.cuts(c), sum(sizes)]
        assert all(b - a <= c for a, b in zip(cuts, cuts[1:], strict=False)) and cuts == sorted(cuts)


def brute_components(rows, width, a, b):
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if sets[i] and b * n >= a * (len(sets[i]) + len(sets[j]) - n) and n:
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            groups[find(i)].append(d)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "a"), [(3, 90), (5, 80), (1, 50), (3, 100)])
def test_jaccard_join(spark, odd, empty, width, a):
    out = jaccard_join.jaccard_join(odd, width, (a, 100)).collect()
    assert Counter(tuple(r) for r in out) == brute_components([(i, t) for i, t, *_ in rows_of()], width, a, 100)
    assert jaccard_join.jaccard_join(empty, width, (a, 100)).count() == 0


def test_jaccard_join_on_near_copies(spark, monkeypatch):
    """Chains and stars of copies with frequent tokens, so that combinations of them are indexed."""
    import random

    r = random.Random(2)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            text[r.randrange(60)] = r.choice((f"n{i}", "common", f"x{r.randrange(9)}"))
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for a in (80, 90):
        assert Counter(tuple(x) for x in jaccard_join.jaccard_join(docs, 3, (a, 100)).collect()) == brute_components(rows, 3, a, 100)
    rows = [(None if i % 3 == 0 else i // 4, t) for i, t in rows]  # null and repeated ids
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 20, jaccard_join.MAX_HOT):  # no hot keys, some, all
        monkeypatch.setattr(jaccard_join, "MAX_HOT", most)
        assert Counter(tuple(x) for x in jaccard_join.jaccard_join(docs, 3, (90, 100)).collect()) == brute_components(rows, 3, 90, 100)


def test_one_of_each(spark, odd):
    kept = jaccard_join.one_of_each(odd, width=5, threshold=(80, 100))
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[15] == 1 and ids[18] == 0 and ids[0] == 1 and ids[3] == 2 and ids[None] == 1
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a), (5, a + " end"), (5, b), (5, b), (None, c), (None, c + " end"), (None, None), (7, "")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=5, threshold=(80, 100)).collect()
    assert len(kept) == 5
    counted = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in kept)
    assert counted == {(2, "a"): 1, (5, "b"): 1, (None, "c"): 1, (None, ""): 1, (7, ""): 1}


def test_licences(odd, empty):
    out = license_scan.licences(odd).collect()
    assert len(out) == len(rows_of()) and license_scan.licences(empty).count() == 0
    assert {r["doc_id"]: list(r["families"]) for r in out if r["n_notices"]} == {48: ["cc_by_nc", "unknown"]}


def test_every_template_is_recognised(spark):
    docs = spark.createDataFrame([(i, f"plain words here\n{t}\nmore") for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    assert [r["families"] for r in license_scan.licences(docs).orderBy("doc_id").collect()] == [[f] for f, _ in license_scan.TEMPLATES]


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    prose = ["The general public was free to see the work and the terms of it.", "They use a version of the file at school.", "All of this was in the water by the public house."] * 20
    texts, want = [], []
    for width in (30, 72, 80):
        for family, text in (("bsd", bsd), ("gpl", gpl), ("mit", mit)):
            lines = textwrap.wrap(text, width)
            marked = "\n".join(["/*", " * Copyright 2020 The Authors", " *", *(f" * {x}" for x in lines), " */", "int main() {"])
            texts += ["\n".join(lines), marked, "\n".join([*prose, *lines, *prose])]
            want += [family] * 3
    both = "\n".join([*textwrap.wrap(mit, 72), *textwrap.wrap(bsd, 72), *prose, *textwrap.wrap(mit, 60)])
    docs = spark.createDataFrame(list(enumerate([*texts, both])), "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.licences(docs).collect()}
    assert [[f for f in out[i]["families"] if f != "unknown"] for i in range(len(texts))] == [[f] for f in want]
    assert [n["family"] for n in out[len(texts)]["notices"] if n["family"] != "unknown"] == ["mit", "bsd", "mit"]


def test_quality_classifier(spark, sf, odd, empty):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score(odd, model)
    assert out.count() == len(rows_of()) and out.where("score BETWEEN 0 AND 1").count() == len(rows_of())
    assert quality_classifier.score(empty, model).count() == 0
    scored = quality_classifier.op5_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.9 * len(scored)
    nothing = quality_classifier.train(docs, labels.limit(0))
    assert quality_classifier.score(docs, nothing).where("score BETWEEN 0 AND 1").count() == docs.count()


def by_counting(tokens):
    """Counts of words and of bigrams, and a function that gives the bigram model's probability of a word after another."""
    uni, bi = Counter(), Counter()
    for s in tokens:
        uni.update(s)
        bi.update(zip(["<s>", *s[:-1]], s, strict=True))
    v, types = len(uni), len(bi)
    cont = Counter(w for _, w in bi)
    d, low_d = kneser_ney._discounts(Counter(bi.values())), kneser_ney._discounts(Counter(cont.values()))
    spread = sum(x * sum(min(c, 3) == k for c in cont.values()) for k, x in enumerate(low_d, 1)) / types
    ctx = defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bi.items():
        ctx[u][0] += c
        ctx[u][min(c, 3)] += 1

    def p(u, w):
        c = cont.get(w, 0)
        low = (c - low_d[min(c, 3) - 1] if c else 0) / types + spread / (v + 1)
        if u not in ctx:
            return low
        seen, c = ctx[u], bi.get((u, w), 0)
        return (c - d[min(c, 3) - 1] if c else 0) / seen[0] + sum(x * k for x, k in zip(d, seen[1:], strict=True)) / seen[0] * low

    return uni, bi, p


def test_language_model(spark, odd, empty):
    docs = odd.where("doc_id IS NOT NULL")
    model = kneser_ney.train(docs)
    out = kneser_ney.score(odd, model, "doc_id", "text").collect()
    uni, _, p = by_counting([words(t) + [None] for i, t, *_ in rows_of() if i is not None])
    n, v = sum(uni.values()), len(uni)
    assert model.tokens == n
    for r in out:
        s = words(r["text"]) + [None]
        assert (r["n_tokens"], r["n_known"]) == (len(s), sum(w in uni for w in s))
        assert r["base_score"] == pytest.approx(sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in s))
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *s[:-1]], s, strict=True)))
    assert sum(p("<s>", w) for w in uni) + p("<s>", "unheard of") == pytest.approx(1)
    untrained = kneser_ney.train(empty)
    assert kneser_ney.score(docs, untrained, "doc_id").where("score <= 0").count() == docs.count()
    model.delete()


def test_trigrams(spark, odd, empty, monkeypatch):
    """Order 3 against counts in a dictionary, over the pruned trigrams and the bigram model."""
    texts = [f"the cat {('sat', 'ran', 'sat', 'hid')[i % 4]} on the {('mat', 'red mat', 'mat')[i % 3]} and w{i} the cat sat" for i in range(40)] + ["", None, "one", "the cat", "the cat sat on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(kneser_ney, "SHARD_ROWS", 7)
    model = kneser_ney.train(docs, order=3)
    uni, bi, low = by_counting([words(t) + [None] for t in texts])
    tri = Counter()
    for t in texts:
        s = ["<s>", *words(t), None]
        tri.update(zip(s, s[1:], s[2:], strict=False))
    d = (0, *kneser_ney._discounts(Counter(tri.values())))
    kept = {k: n for k, n in tri.items() if n > 1}
    assert model.top_discounts == pytest.approx(d[1:]) and model.trigrams.rows == len(kept)

    def p(u, v, w):
        if not bi.get((u, v)):
            return low(v, w)
        used = sum(n - d[min(n, 3)] for k, n in kept.items() if k[:2] == (u, v))
        n = kept.get((u, v, w), 0)
        return (n - d[min(n, 3)]) / bi[u, v] + (1 - used / bi[u, v]) * low(v, w)

    for t in ["the cat sat on the mat", "the cat flew on the red mat and w3 the", "on the moon", "", "zzz zzz zzz", *texts]:
        s = ["<s>", *words(t), None]
        want = math.log10(low(*s[:2])) + sum(math.log10(p(*s[i - 2 : i + 1])) for i in range(2, len(s)))
        assert model.score([(t or "").encode()])[3][0] == pytest.approx(want)
    for u, v in (("<s>", b"the"), (b"the", b"cat"), (b"on", b"the"), (b"cat", b"sat"), (b"w3", b"mat")):
        assert sum(p(u, v, w) for w in (*uni, "unheard of")) == pytest.approx(1)
    assert {r["doc_id"]: r["score"] for r in kneser_ney.score(docs, model, "doc_id").collect()} == pytest.approx({r["doc_id"]: r["score"] for r in kneser_ney.score(docs.repartition(1), kneser_ney.train(docs.repartition(1), order=3), "doc_id").collect()})
    untrained = kneser_ney.train(empty, order=3)
    assert kneser_ney.score(odd, untrained, "doc_id").where("score <= 0").count() == odd.count()
    with pytest.raises(ValueError):
        kneser_ney.train(docs, order=4)


def test_language_model_is_cut_evenly(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"the w{(i * 37 + j) % 900}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    scores = lambda model: {r["doc_id"]: tuple(r) for r in kneser_ney.score(docs, model, "doc_id").collect()}
    whole = scores(kneser_ney.train(docs))
    monkeypatch.setattr(kneser_ney, "SHARD_ROWS", 50)
    monkeypatch.setattr(kneser_ney, "MAX_MAPS", 2)
    model = kneser_ney.train(docs)
    assert scores(model) == whole
    assert max(n for a in (model.words, model.bigrams, model.contexts, model.followers) for *_, n in a.files) <= 50
    the = model.words.look_up(kneser_ney._tokens([b"the"])[0])[0][0]
    keys = [model.bigrams.part(i)[1][0] for i in range(len(model.bigrams.files))]
    assert all((k[1:] > k[:-1]).all() and (a[-1] < b[0]) for k, a, b in zip(keys, keys, keys[1:], strict=False))
    assert sum((k >> 32 == the).any() for k in keys) >= 100  # its 900 bigrams lie in many shards
    assert len(model.bigrams._maps) <= 2 and model.bigrams.rows == sum(map(len, keys))
    # A shard of many keys is written in files of bounded size, and a repeated task writes the same ones.
    rows = spark.range(1000).select(F.lit(3).cast("long").alias("shard"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    path = kneser_ney.C.new_path(spark, "cut")
    files = kneser_ney.write_arrays(rows.unionByName(rows.where("key < 500")).repartition(5), path, ["n"])[0]
    assert [n for *_, n in sorted(files)] == [50] * 20
    assert sorted(files) == sorted(kneser_ney.write_arrays(rows.unionByName(rows.where("key < 500")), path, ["n"])[0])
    place, (n,) = kneser_ney.Arrays(path, 1, files).look_up(np.array([999, 0, 499, 500, 1000]))
    assert place.tolist() == [999, 0, 499, 500, -1] and n.tolist() == [1, 2, 2, 1, 0]
    model.delete()


def test_mixing(spark, sf, odd, empty, monkeypatch):
    out = mixing.plan(odd).collect()
    assert len(out) == len(rows_of()) and mixing.plan(empty).count() == 0
    assert all(r["copies"] <= 2 for r in out) and Counter(r["size"] for r in out) == Counter(len(words(t)) for _, t, *_ in rows_of())
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.plan(odd.repartition(2)).collect()), key=repr)
    assert mixing.mix(odd).columns == odd.columns
    monkeypatch.setattr(mixing, "MAX_SOURCE_BYTES", 0)  # many sources: salted keys
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.plan(odd).collect()), key=repr)
    monkeypatch.undo()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.plan(docs).collect()}
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs).collect())
    assert mixed == Counter({k: n for k, n in plan.items() if n})


def test_targets_share_what_is_cut(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 90, None: 500}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    weights, tops = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {k: 2.0 * v for k, v in sizes.items()}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit >= tops[k]}
        for k in full or open_:
            want[k] = tops[k] if full else weights[k] * unit
        left -= sum(want[k] for k in full)
        open_ = open_ - full if full else set()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(want)


def test_quality_rules(odd, empty):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert rows.count() == len(rows_of()) and quality_rules.ledger(empty).count() == 0
    by = Counter()
    for _, t, *_ in rows_of():
        w = (t or "").encode().split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        by[(len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(at))] += 1
    assert Counter(tuple(r) for r in rows.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == by
    table = {r["rule"]: (r["n_failed"], r["n_failed_alone"]) for r in quality_rules.ablations(rows).collect()}
    failed = [r["failed"] for r in rows.collect()]
    assert table["few_words"] == (sum(f & 1 for f in failed), sum(f == 1 for f in failed))
    assert quality_rules.mask("base") == 3


def test_sampled_pieces(odd, empty):
    out = sampled_pieces.encode(odd, keep=("doc_id", "text"))
    again = sampled_pieces.encode(odd.repartition(5), keep=("doc_id", "text"))
    rows = out.collect()
    assert all(r["lossless"] for r in rows) and len(rows) == len(rows_of()) and sampled_pieces.encode(empty).count() == 0
    assert Counter((r["doc_id"], r["text"], bytes(r["pieces"])) for r in rows) == Counter((r["doc_id"], r["text"], bytes(r["pieces"])) for r in again.collect())
    back = sampled_pieces.decode(out).collect()
    assert Counter(tuple(r) for r in back) == Counter((i, t or "") for i, t, *_ in rows_of())
    other = {r["doc_id"]: bytes(r["pieces"]) for r in sampled_pieces.encode(odd, seed=1).collect() if r["doc_id"] == 15}
    assert other[15] != next(bytes(r["pieces"]) for r in rows if r["doc_id"] == 15)


def test_pieces_are_drawn_by_probability():
    import numpy as np

    p = sampled_pieces.Pieces(sharpness=0.3)
    logp = dict(zip(p.ids.tolist(), p.logp.tolist(), strict=True))
    ids = {raw.decode(): i for i, raw in enumerate(p.raw) if i in logp}

    def cuts(t):
        return [(ids[t[:n]], *rest) for n in range(1, len(t) + 1) if t[:n] in ids for rest in cuts(t[n:])] if t else [()]

    weight = {c: math.exp(sum(logp[i] for i in c)) for c in cuts("than")}
    n = 20_000
    out, at = p.sample(["than"] * n, np.arange(n).astype(np.uint64))
    found = Counter(tuple(out[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True))
    for c, w in weight.items():
        q = w / sum(weight.values())
        assert abs(found[c] / n - q) < 5 * math.sqrt(q / n) + 1e-3


def test_secrets(spark, odd, empty):
    forest = secret_scan.train()
    out = secret_scan.scan(odd, forest).collect()
    assert len(out) == len(rows_of()) and secret_scan.scan(empty, forest).count() == 0
    found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["secrets"]] for r in out if r["secrets"]}
    assert found == {45: ["0123456789abcdef0123456789abcdef01234567"]}
    clean = secret_scan.scan(odd, forest, redact=True)
    assert clean.columns == odd.columns
    row = clean.where("doc_id = 45").first()
    assert row["text"] == 'token = "[SECRET]" end' and row["n_chars"] == len(row["text"])
    assert clean.where("doc_id = 36").first()["text"] == next(t for i, t, *_ in rows_of() if i == 36)
    glued = "é" + ";".join(f"k{i}:0123456789abcdef{i:08}" for i in range(20_000))  # one word of 600,000 characters
    spans = secret_scan._candidates([b"", glued.encode()])[1]
    assert len(spans) == 20_000 and all(glued[c[0] : c[1]] == c[2] and len(c[3]) <= secret_scan.CONTEXT for c in spans)
    fresh = secret_scan.findings(1000, seed=99)
    import numpy as np

    right = (forest.score(np.array([secret_scan.features(*r[:4]) for r in fresh])) >= 0.5) == np.array([r[4] for r in fresh])
    assert right.mean() > 0.95


def test_short_secrets_and_far_words(spark):
    """Values of a few characters after a key word, and words beside candidates that a long word parts from them."""
    secret = ["password=hunter2", 'password: "Tr0ub4dor"', "pwd=s3cr3t!9", "db_password = kitten42", "secret: x9$Qa7!"]
    plain = ["password: string", "token: none", "auth: basic", "key: value", 'token: "user"', "the secret: they left", "auth = true", "key: 4096"]
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["secrets"]] for r in secret_scan.scan(docs, secret_scan.train()).collect()}
    assert [got[i] for i in range(len(secret))] == [["hunter2"], ["Tr0ub4dor"], ["s3cr3t!9"], ["kitten42"], ["x9$Qa7!"]]
    assert all(not got[len(secret) + i] for i in range(len(plain)))
    url = "https://host/" + "/".join(["path"] * 200)
    value = "0123456789abcdef0123456789abcdef"
    for lead, want in ((f"the token {url} {value} end", (1.0, 0.0, 0.0)), (f"an example {url} {value}", (0.0, 0.0, 1.0)), (f"commit {url} {value}", (0.0, 1.0, 0.0)), (f"so {url} {value}", (0.0, 0.0, 0.0)), (f"so {value} {url}/sample", (0.0, 0.0, 1.0))):
        assert next(c for c in secret_scan._candidates([lead.encode()])[0] if c[2] == value)[5] == want, lead[:20]


def test_secrets_without_digits(spark):
    secret = {
        'password = "correcthorsebatterystaple" end': "correcthorsebatterystaple", 'é dbPassword: \'P@ss-w0rd!x\', end': "P@ss-w0rd!x", "password=P@ss-w0rd!x": "P@ss-w0rd!x",
        '{"secret": "qwertzuiopasdfgh"}': "qwertzuiopasdfgh", 'password = "correct horse battery staple"': "correct horse battery staple",
        "key: https://h.org/x?token=0123456789abcdef0123456789abcdef": "0123456789abcdef0123456789abcdef",
    }
    plain = ['key: "The name of the thing to look for"', "password = getpass.getpass()", "token: authentication", "monkey: abcdefghijkl", 'secret = "your_secret_here"']
    docs = spark.createDataFrame(list(enumerate([*secret, *plain])), "doc_id long, text string")
    forest = secret_scan.train()
    out = secret_scan.scan(docs, forest).orderBy("doc_id").collect()
    assert [[r["text"][s["start"] : s["end"]] for s in r["secrets"]] for r in out] == [[v] for v in secret.values()] + [[]] * len(plain)
    clean = secret_scan.scan(docs, forest, redact=True).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == [t.replace(v, "[SECRET]") for t, v in secret.items()] + plain
    assert secret_scan._apart([{"start": 0, "end": 9, "score": 0.6}, {"start": 2, "end": 5, "score": 0.9}]) == [{"start": 0, "end": 9, "score": 0.9}]


def test_base64_secrets_and_secrets_in_docs():
    import base64
    import random

    import numpy as np

    r, forest = random.Random(4), secret_scan.train()
    keys = [base64.b64encode(r.randbytes(k)).decode() for k in (30, 64) * 400]
    keys = [k for k in keys if k.count("/") > 1]
    for values, path in ((keys, "src0"), (keys, "docs/a.html"), ([r.randbytes(20).hex() for _ in range(200)], "tests")):
        scores = forest.score(np.array([secret_scan.features(v, 'the secret = "', "end", path) for v in values]))
        assert len(values) >= 100 and (scores >= 0.5).mean() > 0.95
    sample = ("0123456789abcdef0123456789abcdef", "the fake token: ", "end", "tests/data.md")
    paths = ("users/home/files/a1b2c3d4", "the file ", "end", "src0")
    assert (forest.score(np.array([secret_scan.features(*sample), secret_scan.features(*paths)])) < 0.5).all()


def test_texts_of_equal_rows_and_crc(spark):
    from palimpsest.llm._common import crc32_text

    row = spark.range(1).select(crc32_text(F.lit(17)), crc32_text(F.lit(None).cast("long"))).first()
    assert list(row) == [zlib.crc32(b"17"), 0]


def test_mix_draws_null_ids_apart(spark):
    """Sums of the words taken, plan against mix, where ids are null or repeat."""
    import random

    r = random.Random(5)
    rows = [(None if i % 2 else i // 6, " ".join(["w"] * r.randint(1, 9) + [str(i)]), ("a", "b", "c", None)[i % 4], 1, 2) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_key` int, `copies` int")
    plan = mixing.plan(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {x["source"]: x["taken"] for x in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("taken")).collect()}
    assert taken == {x["source"]: x["taken"] for x in plan if x["taken"]}
    assert all(abs(x["taken"] - x["target"]) <= 0.02 * x["target"] for x in plan)
    assert set(Counter(x["text"] for x in mixed.collect()).values()) <= {1, 2}


def test_targets_of_many_sources(spark):
    rows = [(f"s{i:05}", 1 + i * i % 977) for i in range(3000)] + [(None, 400)]
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate([*sorted(k for k, _ in rows if k), None])}
    size, left, open_, want = dict(rows), 1.5 * sum(n for _, n in rows), {k for k, _ in rows}, {}
    while True:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if 2.0 * size[k] <= weight[k] * unit}
        if not full:
            break
        want |= {k: 2.0 * size[k] for k in full}
        left, open_ = left - sum(want[k] for k in full), open_ - full
    assert got == pytest.approx(want | {k: weight[k] * unit for k in open_})


def test_quality_labels_and_texts_that_disagree(spark):
    """An id labelled both ways isn't learnt from, and of repeated ids one text is, whatever the order of the rows."""
    docs = spark.createDataFrame([(i, f"good plain words of the text {i}" if i % 2 else f"zz## {i} zz## 00 zz##") for i in range(200)] + [(3, "another text"), (None, "no id")], "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(200)] + [(5, 0, 0), (None, 1, 0), (7, None, 0), (9999, 1, 0)]
    a = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    b = quality_classifier.train(docs.orderBy(F.desc("text")).repartition(7), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert (a.vectors == b.vectors).all() and all((p == q).all() for x, y in zip(a.layers, b.layers, strict=True) for p, q in zip(x, y, strict=True))
    scores = a.score([b"good plain words of the text 901", b"zz## 900 zz## 00 zz##"])
    assert scores[0] > 0.8 and scores[1] < 0.2


def test_jaccard_join_of_texts_that_share_long_passages(spark, monkeypatch):
    """Texts that consist mostly of common passages, by the table of frequent tokens, by none, and by lists that are refined."""
    import random

    r = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(30)] for k in range(3)]
    rows = []
    for i in range(240):
        own = [f"o{i}_{j}" for j in range(r.choice((0, 1, 3, 6, 12)))]
        text = passages[i % 3] + (passages[(i + 1) % 3][: r.choice((0, 10, 30))]) + own
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table, least, long in ((100_000, 12, 96), (4, 12, 10), (100_000, 3, 8)):
        monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", table)
        monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", least)
        monkeypatch.setattr(jaccard_join, "STEP", 4)
        monkeypatch.setattr(jaccard_join, "LONG", long)
        for a in (80, 90):
            assert Counter(tuple(x) for x in jaccard_join.jaccard_join(docs, 3, (a, 100)).collect()) == brute_components(rows, 3, a, 100)


def test_prefix_entries_never_miss_a_pair():
    """Any two sets that link have an entry in common, whatever classes their tokens have."""
    import numpy as np

    r = np.random.default_rng(1)
    for a, b in ((4, 5), (9, 10), (1, 2)):
        ks = jaccard_join.combination_sizes(a, b)
        for _ in range(1500):
            n = int(r.integers(1, 90))
            x = np.unique(r.integers(1, 1 << 62, n))
            lost = int(r.integers(0, max(1, (b - a) * len(x) // b + 1)))
            y = np.unique(np.concatenate((r.permutation(x)[lost:], r.integers(1, 1 << 62, int(r.integers(0, lost + 2))))))
            both = len(np.intersect1d(x, y))
            if not both or b * both < a * (len(x) + len(y) - both):
                continue
            level = {int(t): int(c) for t, c in zip(np.union1d(x, y), r.choice(5, len(np.union1d(x, y)), p=r.dirichlet(np.ones(5))), strict=True)}
            found = []
            for s in (x, y):
                token = s.astype(np.uint64)
                found.append(set(jaccard_join.prefix_signatures(np.zeros(len(s), int), token, np.array([0, len(s)]), np.array([level[int(t)] for t in s], np.int8), a, b, ks)[2].tolist()))
            assert found[0] & found[1] or set(x.tolist()) == set(y.tolist())


def test_next_documents_of_uneven_ids(spark, monkeypatch):
    """Every row's next one and even ranges, with ids far off the others, null ids and repeated ones."""
    import random

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    r = random.Random(7)
    ids = [*range(300), 10**15, -(10**17), (1 << 62) + 5, *[None] * 80, 7, 7]
    rows = [(i, f"text {k} " + "x" * r.randint(0, 9)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    ties = {x["text"]: x["tie"] for x in docs.collect()}
    order = [t for i, t in sorted(rows, key=lambda x: (math.inf if x[0] is None else -x[0], ties[x[1]]))]
    want = dict(zip(order, order[1:] + order[:1], strict=True))
    found = fingerprints.with_next(docs)
    got = found.withColumn("next", F.lead("text").over(fingerprints.order())).where("NOT extra").collect()
    assert {x["text"]: x["next"] for x in got} == want
    sizes = Counter((x["range"], x["part"]) for x in got)
    assert max(sizes.values()) <= 16 and len(sizes) > 50


def test_likeness_against_exact_shares(spark):
    """Shares of 0, a quarter, a half and three quarters, ten pairs each; and texts of repeated runs."""
    word = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = [(k, share, "\n".join([word(f"s{k}_", 400 * share // 4), word(f"a{k}_", 400 - 100 * share)]), "\n".join([word(f"s{k}_", 400 * share // 4), word(f"b{k}_", 400 - 100 * share)])) for k in range(10) for share in range(4)]
    rows += [(99, 9, "one two three " * 300, "one two three " * 290 + word("z", 30))]
    rows += [(98, 8, word("s", 200), word("s", 100) + " z" * 100)]
    f = fingerprints
    out = spark.createDataFrame(rows, "k int, share int, a string, b string").select("share", f.likeness(f.fingerprint(F.col("a")), f.fingerprint(F.col("b"))).alias("x")).collect()
    for share in range(4):
        errors = [x["x"] - share / 4 for x in out if x["share"] == share]
        assert abs(sum(errors)) / 10 < 0.04 and math.sqrt(sum(e * e for e in errors) / 10) < 0.08 * (1 - share / 4) + 0.01
    assert abs(next(x["x"] for x in out if x["share"] == 9) - 2 * 868 / (898 + 898)) < 0.05
    assert abs(next(x["x"] for x in out if x["share"] == 8) - 2 * 98 / (198 + 198)) < 0.08


def test_language_model_guards_its_keys(spark, sf, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="64-bit"):
        kneser_ney.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_long_texts_that_differ_do_not_leave_the_lists(spark):
    """256 bits are full in texts of thousands of tokens; the wider bitmaps still tell them apart, and no linked pair is lost by them."""
    from functools import reduce

    texts = [" ".join(f"w{i}" for i in range(at, at + n)) for at, n in ((0, 3000), (900, 3000), (1800, 3000), (150, 3000), (0, 2090), (0, 1990), (0, 500), (20, 530))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    for a, least in ((9, 4), (8, 6)):
        shared = spark.sparkContext.broadcast(jaccard_join.frequent_tokens(docs, 3))
        d = jaccard_join._described(docs, shared, 3, a, 10, jaccard_join.combination_sizes(a, 10)).cache()
        pairs = d.alias("x").join(d.alias("y"), (F.col("x.doc_id") < F.col("y.doc_id")) & jaccard_join._can_link("x", "y", a, 10, wide=True)).select("x.doc_id", F.col("y.doc_id").alias("other"))
        got = {tuple(r) for r in pairs.collect()}
        linked = {(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j])}
        assert linked and linked <= got and len(got) < least
        narrow = reduce(lambda x, p: x + F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))), jaccard_join._PARITY, F.lit(0))
        assert d.alias("x").join(d.alias("y"), F.expr("x.doc_id < y.doc_id AND x.n = 2998 AND y.n = 2998") & (narrow * (10 + a) <= 5996 * (10 - a))).count() == 6
