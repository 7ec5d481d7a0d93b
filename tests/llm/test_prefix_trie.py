"""The prefix trie against a plain one built in Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from palimpsest.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, id string, depth string, parent string, item string"


def brute(rows, shared):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), item, role, text))
    plain = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        base = plain.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        made[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    out = []
    for path, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(made[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def rows_of():
    """Common beginnings, a long conversation, nulls, ties, repeated rows, negative ids and ids whose base is absent or short."""
    rest = ("i", "d", "p", "t")
    out = []
    for c in [*range(0, 12), *range(-7, 0), *range(100, 130), *range(250, 260), 300, *range(301, 340)]:
        n = 1 if c == 300 else 2 + c % 7
        out += [(c, t, "user" if t % 2 == 0 else None if c == 5 else "assistant", f"common {t}" if t < c % 4 else f"turn {t} of {c}", *rest) for t in range(n)]
    out += [(100, t, "user", f"deep {t}" * (t % 3), *rest) for t in range(50, 350)]
    out += [(117, t, "user", f"deep {t}" * (t % 3), *rest) for t in range(50, 350)]
    out += [(3, None, "user", "before all", *rest), (3, None, None, None, *rest), (4, 1, "user", "tie", *rest), (4, 1, "user", "tie too", *rest), (6, 0, "x", "twice", *rest), (6, 0, "x", "twice", *rest)]
    out += [(None, 0, "user", "of nobody", *rest), (400, 0, "", "", *rest), (401, 0, None, None, *rest), (402, 0, "user", "long " * 50_000, *rest), (403, 0, "user", "long " * 50_000, *rest)]
    out += [(c, t, "user", f"hot {t}", *rest) for c in range(500, 560) for t in range(7)]
    return out


@pytest.mark.parametrize("shared", [False, True])
def test_equals_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(prefix_trie, "FEW", 40)  # so that common parents and long conversations take the way of large keys
    docs = spark.createDataFrame(rows_of(), SCHEMA).repartition(5)
    assert found(prefix_trie.conversation_trie(docs, shared)) == brute(rows_of(), shared)


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(c, 0, "user", "all alike", *"idpt") for c in range(400)]
    out = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(out) == brute(rows, False)


def test_one_conversation_and_none(spark):
    rows = [(7, t, "user", "same", *"idpt") for t in range(300)]
    out = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found(out) == brute(rows, False)
    none = prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", *"idpt")], SCHEMA), True)
    assert none.count() == 0 and prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA), True).count() == 0
