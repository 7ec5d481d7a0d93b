"""N-gram Jaccard join over token-combination prefixes.

Each text's set holds the hashes of its distinct word shingles. Tokens have classes by how many texts hold
them: class 0 is rare, and each class above it holds tokens STEP times as frequent. They are ordered by class, then by
hash. A text indexes a prefix of its ordered set: rare tokens by themselves, those of class j as combinations of
k_j neighbours of that class, k_j = 2, 3, 4 and so on.

No pair is lost. With J >= a/b and n tokens, a partner lacks m <= e = n(b-a)//b of them and adds f foreign ones,
m + f <= D = n(b-a)//a. A lacking token breaks k combinations of k neighbours and a foreign one k-1, so in one class at
most m + (k-1)(m+f) are broken. If no earlier class i left a common entry, all its w_i entries were broken, which
takes k w_i / k_i at least of what class j could break. So

    wanted_j = e + (k_j - 1) D + 1 - sum over i < j of k_j w_i // k_i

entries of class j leave one that both texts index; what lies before the first common entry is all broken, so
it is within both texts' prefixes. A text of which no class has enough also indexes its first e + 1 tokens singly,
the plain prefix. Which tokens count as frequent never matters for the result, only for the lists' lengths.

Long texts share single rare tokens with many texts that are not like them, and no short bitmap tells them apart. So a
text of more than T = long_from(a, b) tokens indexes combinations of two for its rare tokens too, k_0 = 2. Texts up to
T b/a tokens have entries of the first form, longer ones than T of the second; two texts that link have either a common form.

The table of classes is bounded and goes to every worker. A rare token that the table missed shows by its list,
longer than LONG: the texts of such lists are indexed again with these tokens in class 1, from a distributed table,
until no list of a rare token is long.

The texts of a list are compared with one of them, its pivot. Those in another component than their pivot's
are left; links within a component change nothing.

* On a rare token's list, at most LONG texts, they are compared with the others of the list.
* Lists of combinations are many for the same texts, so a text is left once for each component that its pivots are in,
  not once for each list. Two texts without a common rare token differ by r + r' + |f - f'| at least (r rare and
  f other tokens), so they link only if the intervals [f + g, f - g], g = r - n(b-a)/(b+a), meet: A <= B' and A' <= B.
  Texts with g > 0 never meet each other; they, and those with g <= 0, are dealt to cells of a logarithmic grid of
  f, where each pair meets once. Pairs with a common rare token have a list of it.
* That is not so of long texts, whose rare tokens are in combinations: r counts as 0 there. Of these lists those up to LONG
  are compared as those of rare tokens, longer ones as the others.

Exact bounds come before the whole sets: sizes, and parity bitmaps, whose differing bits never exceed the symmetric
difference. Bitmaps of one width for all fill up in long texts, so these bring wider ones to the lists of rare tokens where texts are
left, else every pair on a list of long texts would come out of it. Pairs that remain are verified on the whole sets. Texts with equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Upper bound of the table of frequent tokens that goes to every worker (9 bytes each); lists find the others.
MAX_FREQUENT = 100_000
#: A token of so many texts is frequent; STEP times as many make the next class.
FREQUENT_FROM, STEP = 24, 16
#: Tokens of a combination at most; thresholds may allow fewer.
MAX_K = 4
#: A rare token's list of more classes is refined.
LONG = 96
#: Tokens that lists showed to be frequent go to every worker up to this number (8 bytes each); more are looked up by a join.
MAX_KNOWN = 1 << 21
#: Entries of texts that are indexed anew meet the others' by a broadcast up to this number, else by a shuffle.
MAX_TOUCHED = 1_000_000
PARITY_WORDS = 4
#: Differing bits that two texts of ``long_from`` tokens may have and link; of 64 * PARITY_WORDS bits, half differ at random.
LONG_BITS = 48
#: Keys that hold more than this part of all rows are fewer than this number; a table of them is broadcast (32 bytes each).
MAX_HOT = 1 << 14
#: A key's pairs are dealt to tasks by this part of all pairs.
SPLIT = 1 << 10
#: A key of so few rows is never hot, whatever part of all rows they are: any task holds them, and in small tables all keys would be hot, each with a plan and a broadcast that the driver pays for.
LEAST_HOT = 64
#: Cells of the grid between a size and the least that links with it.
CELLS = 8


def _sets(words, width: int):
    """(text, token) of the distinct tokens, by text and token, and each text's first row."""
    import numpy as np

    from ._tokens import shingles

    doc, token = shingles(words, width)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[fresh], token[fresh]
    return doc, token, np.searchsorted(doc, np.arange(len(words.first)))


def _word_batches(batches: Iterator, width: int) -> Iterator:
    from ._tokens import Words, as_bytes

    for block in C.text_blocks(batches):
        yield block, *_sets(Words(as_bytes(block["text"])), width)


def combination_sizes(a: int, b: int) -> tuple[int, ...]:
    """k of each class: 1 for rare tokens, then 2, 3, ... as long as a text of 32 tokens of one class can fulfil the guarantee."""
    n = 32
    return (1, 2, *(k for k in range(3, MAX_K + 1) if n * (b - a) // b + (k - 1) * (n * (b - a) // a) + 1 <= n - k + 1))


def long_from(a: int, b: int) -> int:
    """Texts of more tokens index combinations of rare tokens: about where the bound on the narrow bitmap, half of whose bits differ in any two long texts, stops telling them apart."""
    n = 32
    if a == b or n * (b - a) // b + n * (b - a) // a + 1 > n - 1:
        return 1 << 40  # only equal sets link, or combinations seldom suffice
    return LONG_BITS * (b + a) // (b - a)


def frequent_tokens(docs: DataFrame, width: int):
    """(tokens, classes) of tokens of many texts, at most MAX_FREQUENT, from the counts that each partition keeps of its common ones."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, _, token, _ in _word_batches(batches, width):
            found, n = np.unique(token, return_counts=True)
            held, at = np.unique(np.concatenate((held, found)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(held)).astype(np.int64)
            if len(held) > 1_000_000:  # a lossy count: what is rare so far starts again
                keep = counts > 1
                held, counts = held[keep], counts[keep]
        keep = np.flatnonzero(counts > 1)
        if len(keep) > MAX_FREQUENT:
            keep = keep[np.argpartition(counts[keep], -MAX_FREQUENT)[-MAX_FREQUENT:]]
        yield pa.RecordBatch.from_arrays([pa.array(held[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

    found = (
        docs.select("text").mapInArrow(count, "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    )
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    level = 1 + np.floor(np.log(n[order] / FREQUENT_FROM) / np.log(STEP) + 1e-9)
    return token[order], level.astype(np.int8)


def _levels(token, table, more=()):
    """Each token's class: the table's, or 1 for those whose single entry is in ``more``, which ascends."""
    import numpy as np

    known, of = table
    level = np.zeros(len(token), np.int8)
    if len(known) and len(token):
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        level = np.where(known[at] == token, of[at], np.int8(0))
    if len(more):
        open_ = np.flatnonzero(level == 0)
        single = _single(token[open_])
        level[open_[more[np.minimum(np.searchsorted(more, single), len(more) - 1)] == single]] = 1
    return level


def _ascending(sigs):
    """Entries, an Arrow column, as an ascending array."""
    import numpy as np

    return np.sort(sigs.to_numpy(zero_copy_only=False).view(np.uint64)) if len(sigs) else np.empty(0, np.uint64)


def _single(token):
    """The entry of a rare token: odd, while those of frequent tokens are even. The second bit is set in the entries of long texts."""
    from ._tokens import U, mix

    return mix(token ^ U(1)) & ~U(2) | U(1)


def prefix_signatures(doc, token, first, level, a: int, b: int, ks: tuple[int, ...]):
    """(rare tokens of each text, text and hash of each index entry); the form for long texts if rare tokens make combinations too, that is if ks[0] > 1."""
    import numpy as np

    from ._tokens import U, mix

    n = np.diff(first)
    level = np.minimum(level, len(ks) - 1)
    order = np.lexsort((token, level, doc))
    token, level = token[order], level[order]  # doc is sorted, so the order keeps it
    e, d = n * (b - a) // b, n * (b - a) // a
    rank = np.arange(len(doc)) - first[:-1][doc]
    unmet = d > 0  # else only an equal set can link
    form = U(2 if ks[0] > 1 else 0)
    texts, entries, used, before, rare = [], [], [], np.zeros(len(n), np.int64), None
    for j, k in enumerate(ks):
        at = np.flatnonzero(level == j)
        size = np.bincount(doc[at], minlength=len(n))
        rare = size if rare is None else rare
        have = np.maximum(size - k + 1, 0)
        wanted = e + (k - 1) * d + 1 - sum(k * w // ks[i] for i, w in enumerate(used))
        used.append(np.where(unmet, np.clip(wanted, 0, have), 0))
        at = at[(rank - before[doc])[at] < used[-1][doc[at]]]
        if k > 1:
            h = np.full(len(at), U(k), U)
            for i in range(k):
                h = mix(h * U(0x9E3779B97F4A7C15) + token[at + i])
            h = h & ~U(3) | form | U(j == 0)
        else:
            h = _single(token[at])
        texts.append(doc[at])
        entries.append(h)
        unmet &= wanted > have
        before += size
    at = np.flatnonzero((level >= (0 if form else 1)) & unmet[doc] & (rank <= e[doc]))
    return rare, np.concatenate((*texts, doc[at])), np.concatenate((*entries, _single(token[at]) & ~U(3) | form))


def _parity(doc, token, width):
    """For each text ``width`` bits, one text after the other: whether an odd number of its tokens falls on each. Widths are powers of two."""
    import numpy as np

    from ._tokens import U

    at = np.cumsum(width) - width
    place = at[doc] + ((token >> U(7)) & (width[doc] - 1).astype(U)).astype(np.int64)
    return (np.bincount(place, minlength=int(width.sum())) & 1).astype(np.uint8)


def _entries_of(doc, token, first, level, a: int, b: int, ks: tuple[int, ...], base=None):
    """(rare tokens of each text, its entries as a list) as Arrow arrays. ``base``: the classes for the form of long texts, where they are others."""
    import numpy as np
    import pyarrow as pa

    base, n, least = level if base is None else base, np.diff(first), long_from(a, b)
    rare, found = np.bincount(doc[level == 0], minlength=len(n)), []
    for held, of, sizes in ((n * a <= least * b, level, ks), (n > least, base, (2, *ks[1:]))):
        own = held[doc]
        mine = doc[own]
        found.append(prefix_signatures(mine, token[own], np.searchsorted(mine, np.arange(len(first))), of[own], a, b, sizes)[1:])
    at, entry = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(first)))
    return pa.array(rare.astype(np.int64)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(entry[order].view(np.int64)))


def _described(docs: DataFrame, shared, width: int, a: int, b: int, ks: tuple[int, ...]) -> DataFrame:
    """doc_id, hash of the text, class of equal sets and a second hash of it, size, rare tokens, parity bitmap, one of the text's own width as bytes and, if that is wider than the other, as words, index entries."""

    def describe(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from ._tokens import U, mix

        for block, doc, token, first in _word_batches(batches, width):
            n = np.diff(first)
            sums = []
            for seed in (1, 2):
                total = np.concatenate((np.zeros(1, U), np.cumsum(mix(token + U(seed)), dtype=U)))
                sums.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(U)).view(np.int64))
            parity = np.packbits(_parity(doc, token, np.full(len(n), 64 * PARITY_WORDS)).reshape(len(n), -1), axis=1).view(np.int64)
            wide = 1 << np.ceil(np.log2(np.maximum(n, 128) / 2)).astype(np.int64)  # bits enough for the bound to tell
            bytes_to = np.concatenate(([0], np.cumsum(wide // 8)))
            raw = np.packbits(_parity(doc, token, wide)).tobytes()
            sketch = pa.array([raw[i:j] for i, j in zip(bytes_to[:-1], bytes_to[1:], strict=True)], pa.binary())
            bits = pa.array([np.frombuffer(raw[i:j], np.int64) if j - i > 8 * PARITY_WORDS else None for i, j in zip(bytes_to[:-1], bytes_to[1:], strict=True)], pa.list_(pa.int64()))
            rare, lists = _entries_of(doc, token, first, _levels(token, shared.value), a, b, ks)
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"], block["key"], *map(pa.array, (*sums, n.astype(np.int64))), rare, *(pa.array(parity[:, i].copy()) for i in range(PARITY_WORDS)), bits, sketch, lists],
                ["doc_id", "key", "cls", "cls2", "n", "rare", *_PARITY, "bits", "sketch", "entries"],
            )

    schema = "doc_id long, key long, cls long, cls2 long, n long, rare long, " + ", ".join(f"{p} long" for p in _PARITY) + ", bits array<long>, sketch binary, entries array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(describe, schema)


_PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


def _told_apart(described: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``described`` where different sets that share their first hash, to be expected once in 10**9 to 10**10 texts, have classes of their own."""
    for turn in range(1, 9):
        clash = described.groupBy("cls").agg((F.min("cls2") != F.max("cls2")).alias("clash")).where("clash")
        if clash.isEmpty():
            break
        clash = scratch.keep(clash, "clash")
        described = described.join(clash, "cls", "left").withColumn("cls", F.when(F.col("clash"), F.xxhash64("cls2", F.lit(turn))).otherwise(F.col("cls"))).drop("clash")
        described = scratch.keep(described, "described")
    return described


def _differing(x: Column, y: Column) -> Column:
    """Differing bits of two texts' wide bitmaps, the wider folded to half its width if that is the other's; null if one has none, or if the widths are further apart."""
    xor = lambda u, v: u.bitwiseXOR(v)

    def like(bits: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(bits) == 2 * half, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), xor)).otherwise(bits)

    return F.aggregate(F.zip_with(like(x, y), like(y, x), xor), F.lit(0).cast("long"), lambda total, w: total + F.bit_count(w))


def _can_link(x: str, y: str, a: int, b: int, rare_list: Column | None = None, wide: bool = False) -> Column:
    """Exact bounds that any linked pair meets: sizes, and the symmetric difference by parity bitmaps, with ``wide`` by the wide ones after the narrow; and, but on a rare token's list, by rare tokens that aren't common."""
    c = lambda side, name: F.col(f"{side}.{name}")
    most = (c(x, "n") + c(y, "n")) * (b - a)
    differ = sum((F.bit_count(c(x, p).bitwiseXOR(c(y, p))).cast("long") for p in _PARITY), F.lit(0).cast("long"))
    bounds = (c(x, "n") * b >= c(y, "n") * a) & (c(y, "n") * b >= c(x, "n") * a) & (differ * (b + a) <= most)
    if rare_list is not None:
        others = c(x, "n") - c(x, "rare") - c(y, "n") + c(y, "rare")
        bounds = bounds & (rare_list | ((c(x, "rare") + c(y, "rare") + F.abs(others)) * (b + a) <= most))
    return bounds if not wide else bounds & F.coalesce(_differing(c(x, "bits"), c(y, "bits")) * (b + a) <= most, F.lit(True))


def _some(rows: DataFrame) -> DataFrame | None:
    """``rows``, or None if there are none: a plan without the joins that only few keys need is much smaller, and so is what the driver holds for it."""
    return None if rows.isEmpty() else rows


def _meet(pairs: DataFrame, x: DataFrame, y: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(x, y) ``pairs`` joined with two tables, one row for each ``x`` and for each ``y``. A key with more than LEAST_HOT pairs and one in SPLIT of all has them dealt by the other column and its row repeated, so that no task gets all of them."""
    total, found, sides = pairs.count(), pairs, set()
    most = max(total / SPLIT, LEAST_HOT)
    if total > most:
        keys = pairs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_side"), F.col(c).alias("_key")) for c in "xy"))).alias("k")).select("k.*")
        hot = keys.groupBy("_side", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        hot = scratch.keep(hot.select("_side", "_key", F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_parts")), "hot")
        sides = {r["_side"] for r in hot.select("_side").collect()}  # fewer than SPLIT rows of either side
    for key, by, table in (("x", "y", x), ("y", "x", y)):
        if key not in sides:
            found = found.join(table, key)
            continue
        own = F.broadcast(hot.where(F.col("_side") == key).select(F.col("_key").alias(key), "_parts"))
        left = found.join(own, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
        right = table.join(own, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
        found = left.join(right, [key, "_part"]).drop("_part")
    return found


def _near(pairs: DataFrame, described: DataFrame, a: int, b: int, scratch: C.Scratch) -> DataFrame:
    """Of (x, y) pairs of classes, those that the parity bitmaps of their own width don't rule out."""

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n, m, s, t in zip(*(batch[c].to_pylist() for c in ("n", "m", "s", "t")), strict=True):
                s, t = (np.frombuffer(v, np.uint8) for v in (s, t))
                while len(s) != len(t):  # a bitmap folds to half its width
                    s, t = (s, t) if len(s) > len(t) else (t, s)
                    s = s[: len(s) // 2] ^ s[len(s) // 2 :]
                keep.append(int(np.bitwise_count(s ^ t).sum()) * (b + a) <= (n + m) * (b - a))
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    one = scratch.keep(described.where("n > 0").select("cls", "n", "sketch").join(asked, "cls", "left_semi").dropDuplicates(["cls"]), "sketches")
    side = lambda c, n, s: one.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    both = _meet(pairs, side("x", "n", "s"), side("y", "m", "t"), scratch)
    return scratch.keep(both.select("x", "y", "n", "m", "s", "t").mapInArrow(near, "x long, y long"), "near")


def _texts_of(classes: DataFrame, docs: DataFrame, reps: DataFrame, scratch: C.Scratch) -> DataFrame:
    """cls and the text of its first row, for each of ``classes`` (cls)."""
    wanted = scratch.keep(classes.join(reps, "cls").select("cls", F.col("doc_id").alias("_id"), "key"), "wanted")
    if wanted.count() <= 1_000_000:  # 24 MB at most
        wanted = F.broadcast(wanted)
    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(docs["text"]) == wanted["key"])  # ids may be null or repeat
    return docs.join(wanted, same).select("cls", "text")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, a: int, b: int, scratch: C.Scratch) -> DataFrame:
    """Of (x, y) pairs of classes, those whose whole sets have b * intersection >= a * union."""

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        from ._tokens import as_bytes

        pack = zstandard.ZstdCompressor(level=3).compress
        for block in C.text_blocks(batches):
            yield pa.RecordBatch.from_arrays([block["cls"], pa.array(map(pack, as_bytes(block["text"])), pa.binary())], ["cls", "packed"])

    def linked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        from ._tokens import Words

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep, held = [], {}
            for x, y, s, t in zip(*(batch[c].to_pylist() for c in "xyst"), strict=True):
                for c, text in ((x, s), (y, t)):
                    if c not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held)))
                        held[c] = _sets(Words([unpack(text)]), width)[1]
                n, m = len(held[x]), len(held[y])
                both = n + m - len(np.union1d(held[x], held[y]))
                keep.append(b * both >= a * (n + m - both))
                held = {x: held[x]} if len(held) > 32 else held
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    texts = scratch.keep(_texts_of(wanted, docs, reps, scratch).mapInArrow(packed, "cls long, packed binary").dropDuplicates(["cls"]), "texts")
    side = lambda c, s: texts.select(F.col("cls").alias(c), F.col("packed").alias(s))
    both = _meet(pairs, side("x", "s"), side("y", "t"), scratch)
    links = scratch.keep(both.select("x", "y", "s", "t").mapInArrow(linked, "x long, y long"), "links")
    scratch.release("texts", "wanted", "sketches", "near")
    scratch.free_shuffles()
    return links


def _least_hot(total: int) -> float:
    """Keys with more rows are hot in a table of ``total`` rows: fewer than MAX_HOT, and none in small tables."""
    return max(total / MAX_HOT, LEAST_HOT)


def _hot(rows: DataFrame, key: str, total: int, scratch: C.Scratch) -> DataFrame | None:
    """The hot keys of ``rows``, or None if there are none."""
    if total <= _least_hot(total):
        return None
    return _some(scratch.keep(rows.groupBy(key).count().where(F.col("count") > _least_hot(total)).select(key), "hot"))


def _by_key(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row of a few numbers for each key.

    The keys of ``hot`` meet their rows where they are, by a broadcast, so that no task gets all rows of one; the
    others, all if there is no such key, meet by a shuffle.
    """
    if hot is None:
        return rows.join(table, key, "left")
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def components(links: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(node, root) of every node of undirected links (x, y); root is the smallest node reachable.

    Each round gives a node the smallest root among itself and its neighbours and then its root's root,
    so chains shorten by more than half; the loop ends when a round changes nothing.
    """
    edges = scratch.keep(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "edges")
    roots = scratch.keep(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    nodes, hubs = roots.count(), _hot(edges, "y", edges.count(), scratch)
    while True:
        of_neighbours = _by_key(edges, roots.select(F.col("node").alias("y"), "root"), "y", hubs).select(F.col("x").alias("node"), "root", F.lit(None).cast("long").alias("old"))
        seen = of_neighbours.unionByName(roots.select("node", "root", F.col("root").alias("old"))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        seen = scratch.keep(seen, "seen")
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = _by_key(seen, up, "root", _hot(seen, "root", nodes, scratch)).select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "old")
        after = scratch.keep(after, "roots")
        roots = after.select("node", "root")
        if after.where("root != old").isEmpty():
            return roots


def jaccard_join(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns, whatever their names, are ignored).

    Two texts link when ``threshold[1] * intersection >= threshold[0] * union`` of their sets of distinct
    shingles of ``width`` words. component_id is the smallest doc_id reachable by links. A text with fewer
    words has one token; null and empty texts have none and link with nothing. Rows with equal texts are
    linked; rows that repeat a doc_id are kept, each with its own set. A null doc_id is kept and counts as
    larger than any other: it names a component only if the component has no other id. An empty
    table gives an empty result. A text of any length is read whole; one above a block is a block of its own,
    and takes about 60 bytes for each of its words in one worker.
    """
    return groups(docs, width, threshold).select("doc_id", "n_shingles", "component_id")


def _shared(entries: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Of (cls, sig), the different rows on lists of several classes."""
    lists = entries.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("sig")
    return scratch.keep(entries.join(lists, "sig").distinct(), "members")


def _refined(entries: DataFrame, sizes: DataFrame, docs: DataFrame, reps: DataFrame, shared, width: int, a: int, b: int, ks: tuple[int, ...], scratch: C.Scratch):
    """(members, sizes with new ``rare``) once no rare token's list is longer than LONG: those texts' entries are made anew with its token in class 1.

    Only lists of entries that were made anew change, so a round looks these up among the others' entries and leaves the
    other lists as they are; what a round takes of disk and shuffles goes with the texts that it changes.
    """

    def rare_tokens(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block, doc, token, _ in _word_batches(batches, width):
            own = _levels(token, shared.value) == 0
            yield pa.RecordBatch.from_arrays([block["cls"].take(pa.array(doc[own])), pa.array(_single(token[own]).view("int64"))], ["cls", "sig"])

    def again(held=None):
        def made(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for block, doc, token, first in _word_batches(batches, width):
                more = _ascending(block["more"].flatten()) if held is None else held.value  # each text's are complete, so all hold for all
                yield pa.RecordBatch.from_arrays([block["cls"], *_entries_of(doc, token, first, _levels(token, shared.value, more), a, b, ks, _levels(token, shared.value))], ["cls", "rare", "entries"])

        return made

    schema = "cls long, rare long, entries array<long>"
    exploded = lambda rows: rows.select("cls", F.explode("entries").alias("sig"))
    members, known, changed = _shared(entries, scratch), None, None
    while True:
        scratch.free_shuffles()
        long = scratch.keep(members.where("sig & 3 = 1").groupBy("sig").count().where(F.col("count") > LONG).select("sig"), "long")
        if long.isEmpty():
            break
        known = scratch.keep(long if known is None else known.unionByName(long).distinct(), "known")
        texts = _texts_of(members.join(long, "sig", "left_semi").select("cls").distinct(), docs, reps, scratch)
        if known.count() <= MAX_KNOWN:
            held = docs.sparkSession.sparkContext.broadcast(_ascending(known.toArrow()["sig"]))
            anew = scratch.keep(texts.mapInArrow(again(held), schema).dropDuplicates(["cls"]), "anew")
            held.destroy()
        else:
            texts = scratch.keep(texts.dropDuplicates(["cls"]), "texts")
            found = texts.mapInArrow(rare_tokens, "cls long, sig long").join(known, "sig").groupBy("cls").agg(F.collect_list("sig").alias("more"))  # a text's own tokens
            anew = scratch.keep(texts.join(found, "cls").mapInArrow(again(), schema), "anew")
        scratch.release("texts", "wanted", "long")
        scratch.free_shuffles()

        new, before = exploded(anew), changed
        rest = None if before is None else before.join(anew.select("cls"), "cls", "left_anti")
        changed = anew if before is None else scratch.keep(rest.unionByName(anew), "changed")
        touched = scratch.keep(new.select("sig").distinct(), "touched")
        if touched.count() <= MAX_TOUCHED:  # 24 MB at most
            touched = F.broadcast(touched)
        others = entries.join(touched, "sig", "left_semi").join(changed.select("cls"), "cls", "left_anti")
        if before is not None:  # a text that was made anew has its last entries
            others = others.unionByName(exploded(rest).join(touched, "sig", "left_semi"))
        meeting = scratch.keep(others.unionByName(new), "meeting")
        scratch.free_shuffles()
        members = _shared(members.join(anew.select("cls"), "cls", "left_anti").unionByName(meeting), scratch)
        scratch.release("touched", "meeting", *(["anew"] if before is not None else []))
        scratch.release("members", "known", "changed", last=1)
    if changed is not None:
        sizes = sizes.join(changed.select("cls", F.col("rare").alias("_rare")), "cls", "left").withColumn("rare", F.coalesce("_rare", "rare")).drop("_rare")
        sizes = scratch.keep(sizes, "sizes")
    scratch.release("anew", "changed", "known", "long")
    return members, sizes


def _left_over(members: DataFrame, pivots: DataFrame, roots: DataFrame, described: DataFrame, a: int, b: int, scratch: C.Scratch) -> DataFrame:
    """(x, y) pairs of classes on one list that are in different components and may link, where one isn't in its pivot's."""
    rooted = roots.withColumnRenamed("node", "cls")
    pivot_roots = pivots.select("sig", "cls", ((F.col("sig") % 2 != 0) & (F.col("rows") <= LONG)).alias("short")).join(rooted, "cls", "left").select("sig", "short", F.coalesce("root", "cls").alias("home"))
    placed = members.join(rooted, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(pivot_roots, "sig")
    mixed = placed.groupBy("sig").agg(F.bool_or(F.col("root") != F.col("home")).alias("mixed")).where("mixed").select("sig")
    placed = scratch.keep(placed.join(mixed, "sig", "left_semi"), "placed")

    rare, longer = placed.where("short"), F.col("n") > max(2 * 64 * PARITY_WORDS, long_from(a, b))  # those have wide bitmaps, and the narrow ones don't tell
    bits = described.where(longer).select("cls", "bits").dropDuplicates(["cls"])
    rare = rare.where(~longer).withColumn("bits", F.lit(None).cast("array<long>")).unionByName(rare.where(longer).join(bits, "cls"))
    once = (F.col("y.root") == F.col("y.home")) | (F.col("x.cls") < F.col("y.cls"))  # else the pair comes from either side
    on_list = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & once & _can_link("x", "y", a, b, wide=True)
    listed = rare.where("root != home").alias("x").join(rare.alias("y"), on_list).select("x.cls", F.col("y.cls").alias("other"))

    own = [F.first(c).alias(c) for c in ("root", "n", *_PARITY)]
    form = F.col("sig").bitwiseAND(2).alias("form")
    texts = placed.where("NOT short").groupBy("home", "cls", form).agg(*own, F.first(F.when(form == 0, F.col("rare")).otherwise(0)).alias("rare"))
    g, f = F.col("rare") * (b + a) - F.col("n") * (b - a), (F.col("n") - F.col("rare")) * (b + a)
    cell = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) * (CELLS / _log(b, a))).cast("int")
    poor = g <= 0
    texts = texts.withColumn("lo", f + g).withColumn("hi", f - g).withColumn("poor", poor)
    texts = texts.withColumn("cells", F.when(poor, F.sequence(cell(F.col("lo")), cell(F.col("hi")))).otherwise(F.array(cell(f))))
    texts = scratch.keep(texts.withColumn("start", F.col("cells")[0]).withColumn("cell", F.explode("cells")).drop("cells"), "cells")
    once = F.when(F.col("x.poor") & F.col("y.poor"), F.col("x.cell") == F.greatest("x.start", "y.start")).otherwise(F.col("x.poor") | F.col("y.poor"))
    in_cell = (F.col("x.home") == F.col("y.home")) & (F.col("x.form") == F.col("y.form")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.root") != F.col("y.root"))
    in_cell = in_cell & once & (F.col("x.lo") <= F.col("y.hi")) & (F.col("y.lo") <= F.col("x.hi")) & _can_link("x", "y", a, b)
    met = texts.where("root != home").alias("x").join(texts.alias("y"), in_cell).select("x.cls", F.col("y.cls").alias("other"))
    return listed.unionByName(met).select(F.least("cls", "other").alias("x"), F.greatest("cls", "other").alias("y")).distinct()


def _log(b: int, a: int) -> float:
    import math

    return math.log(b / a) if b > a else 1.0


def groups(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """What ``jaccard_join`` returns, with the hash of the text and ``root``, which tells components apart that have no id."""
    import math

    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    g = math.gcd(*threshold)
    a, b = threshold[0] // g, threshold[1] // g
    ks = combination_sizes(a, b)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(frequent_tokens(docs, width))  # 900 KB at most
    described = _told_apart(scratch.keep(_described(docs, shared, width, a, b, ks), "described"), scratch)
    scratch.release("described", last=1)
    classes = described.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("row"), F.count("*").alias("rows"))
    classes = scratch.keep(classes, "classes")
    reps = classes.select("cls", "row.doc_id", "row.key")

    # Entries are shuffled as bare numbers; what bounds need joins those on lists of several classes.
    entries = described.where("n > 0").select("cls", F.explode("entries").alias("sig"))
    sizes = described.where("n > 0").select("cls", "n", "rare", *_PARITY).dropDuplicates(["cls"])
    members, sizes = _refined(entries, sizes, docs, reps, shared, width, a, b, ks, scratch)
    members = scratch.keep(members.join(sizes, "cls"), "members")
    scratch.release("members", last=1)
    scratch.release("sizes")
    scratch.free_shuffles()
    # The pivot of a list is the class with fewest rare tokens.
    pivots = scratch.keep(members.groupBy("sig").agg(F.min(F.struct("rare", "cls", "n", *_PARITY)).alias("pivot"), F.count("*").alias("rows")), "lists").select("sig", "rows", "pivot.*")
    in_order = [F.least("x.cls", "y.cls").alias("x"), F.greatest("x.cls", "y.cls").alias("y")]
    on_list = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cls") != F.col("y.cls")) & _can_link("x", "y", a, b, F.col("x.sig").bitwiseAND(3) != 0)
    starred = scratch.keep(members.alias("x").join(pivots.alias("y"), on_list).select(*in_order).distinct(), "pairs")
    scratch.free_shuffles()
    links = _verified(_near(starred, described, a, b, scratch), docs, reps, width, a, b, scratch)
    roots = components(links, scratch)
    more = scratch.keep(_left_over(members, pivots, roots, described, a, b, scratch).join(starred, ["x", "y"], "left_anti"), "pairs")
    scratch.release("members", "lists", "placed", "cells")
    scratch.free_shuffles()
    if not more.isEmpty():
        roots = components(links.unionByName(_verified(_near(more, described, a, b, scratch), docs, reps, width, a, b, scratch)), scratch)

    linked = scratch.keep(classes.select("cls", "row.doc_id", "rows").join(roots.withColumnRenamed("node", "cls"), "cls"), "linked")
    names = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = _by_key(linked.select("cls", "root", "rows"), names, "root", _hot(linked, "root", linked.count(), scratch))
    alone = classes.join(linked.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("root"), "rows", F.col("row.doc_id").alias("component_id"))
    homes = scratch.keep(named.select(*alone.columns).unionByName(alone), "homes")
    rows = described.select("doc_id", "key", F.col("n").alias("n_shingles"), "cls")
    bare = rows.where("n_shingles = 0").select("doc_id", "key", F.col("cls").alias("root"), "n_shingles", F.col("doc_id").alias("component_id"))
    rows = rows.where("n_shingles > 0")
    large = _some(homes.where(F.col("rows") > _least_hot(rows.count())).select("cls"))
    out = _by_key(rows, homes.drop("rows"), "cls", large).select(*bare.columns).unionByName(bare)
    out = out.checkpoint()
    scratch.drop()
    return out


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: the smallest doc_id's, null ids last, then that of the smallest hash of the text.

    Of rows that repeat both id and text one stays; rows that only share an id are judged apart. Texts without words all stay.
    """
    found = groups(docs, **how)
    rows = found.where("n_shingles > 0").groupBy("root", "doc_id", "key").count()
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "count")).alias("x")).select("x.doc_id", "x.key", (F.col("x.count") > 1).alias("repeats"))
    bare = found.where("n_shingles = 0").select("doc_id", "key", F.lit(False).alias("repeats")).distinct()
    chosen = first.unionByName(bare)

    def rows_of(which: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").cast("long").alias("_id"), F.col("key").alias("_key"))
        return docs.join(which, docs["doc_id"].eqNullSafe(which["_id"]) & (F.xxhash64(docs["text"]) == which["_key"]), "left_semi")

    if first.where("repeats").isEmpty():
        return rows_of(chosen)
    return rows_of(chosen.where("NOT repeats")).unionByName(rows_of(chosen.where("repeats")).dropDuplicates(["doc_id", "text"]))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle Jaccard of 0.9 or more."""
    C.shared_dir(spark)
    return jaccard_join(C.table(spark, sf_dir, "documents"))
