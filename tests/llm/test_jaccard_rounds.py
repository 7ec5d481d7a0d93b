"""Texts that are indexed anew in many rounds: right components by every path, and no tables or lists of earlier rounds kept."""

import random
from collections import Counter

import pytest

from palimpsest.llm import _common as C
from palimpsest.llm import jaccard_join


def _texts():
    """Large families of near copies, whose tokens all turn out frequent, some with passages of others, and texts of their own."""
    r = random.Random(5)
    rows = []
    for i in range(150):
        text = [f"f{i % 4}_{k}" for k in range(90)]
        for _ in range(r.choice((0, 1, 2, 6))):
            text[r.randrange(len(text))] = f"x{i}_{r.randrange(1000)}"
        rows.append((i, " ".join(text)))
    rows += [(150 + i, " ".join([f"f{i % 4}_{k}" for k in range(r.choice((5, 30, 60)))] + [f"o{i}_{k}" for k in range(40)])) for i in range(40)]
    return rows + [(3, rows[3][1]), (200, None), (None, rows[7][1])]


def _brute(rows, width, a, b):
    sets = [frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and b * len(sets[x] & sets[y]) >= a * len(sets[x] | sets[y]):
                root[top(x)] = top(y)
    names = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            names[top(x)] = min(i, names.get(top(x), i))
    return Counter((i, len(sets[x]), names.get(top(x))) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("known", "touched"), [(1 << 21, 1_000_000), (0, 0)])
def test_rounds_keep_one_table_of_a_kind(spark, monkeypatch, known, touched):
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "LONG", 12)
    monkeypatch.setattr(jaccard_join, "MAX_KNOWN", known, raising=False)
    monkeypatch.setattr(jaccard_join, "MAX_TOUCHED", touched, raising=False)
    C.shared_dir(spark)
    most, made, keep = Counter(), Counter(), C.Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        made[name] += 1
        for k, n in Counter(p.rsplit("/", 1)[-1][:-33] for p in self.paths).items():
            most[k] = max(most[k], n)
        return out

    monkeypatch.setattr(C.Scratch, "keep", kept)
    rows = _texts()
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, (80, 100))
    assert Counter(tuple(x) for x in found.collect()) == _brute(rows, 3, 80, 100)
    assert made["anew"] >= 3  # rounds
    assert made["entries"] == 0  # not all entries again in each round
    assert max(most[x] for x in ("members", "anew", "changed", "known", "long", "texts", "wanted", "sizes", "meeting", "touched")) <= 2
