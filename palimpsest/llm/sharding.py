"""Shards by minimax contiguous partition of atomic groups.

Groups of equal texts stand in the order of their SHA-256. The smallest capacity that a greedy fill of
``n_shards`` meets is found by binary search, and the cuts keep to it. The driver never holds the
groups: it plans over segments, which are the groups of a common hash prefix, and takes a segment apart
only where a cut can fall between the bounds that segments give. Planning takes a few aggregates of
bounded size, and a row's shard follows from its own hash and the cuts, without a join.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Hexadecimal digits by which the hashes are told apart at first, and more at each step.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows that number themselves together within a shard, and rows of one id and text that one step writes.
SLOT_ROWS = 20_000

#: A run of groups: the hash prefix that they share, how many, their bytes, and the bytes of the largest.
Segment = tuple[str, int, int, int]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))


class _Plan:
    """Greedy fills over segments. A segment of one group is atomic; one of several can be filled to any byte when ``fluid``, else it is atomic too."""

    def __init__(self, segments: list[Segment], n_shards: int):
        self.segments, self.k = segments, n_shards
        self.ends = list(accumulate(s[2] for s in segments))
        self.starts = [e - s[2] for e, s in zip(self.ends, segments, strict=True)]
        self.total = self.ends[-1] if segments else 0
        self.largest = max((s[3] for s in segments), default=0)

    def reach(self, start: int, capacity: int, fluid: bool) -> int:
        """The furthest byte that a shard from ``start`` can end at."""
        want = start + capacity
        if want >= self.total:
            return self.total
        i = bisect_left(self.ends, want + 1)  # the segment that ``want`` falls into
        return want if fluid and self.segments[i][1] > 1 else max(start, self.starts[i])

    def back(self, end: int, capacity: int) -> int:
        """The earliest byte that a shard up to ``end`` can start at, segments being atomic."""
        want = end - capacity
        return 0 if want <= 0 else min(end, self.ends[bisect_left(self.ends, want)])

    def fits(self, capacity: int, fluid: bool) -> bool:
        at = 0
        for _ in range(self.k):
            at = self.reach(at, capacity, fluid)
        return at >= self.total

    def capacity(self, fluid: bool) -> int:
        """The smallest that fits, by binary search."""
        lo, hi = max(self.largest, -(-self.total // self.k)), max(self.total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.fits(mid, fluid) else (mid + 1, hi)
        return lo

    def cuts(self, capacity: int) -> list[int]:
        """Where shards end: as near to an even share of the rest as the capacity allows for this shard and all later ones."""
        latest_starts = [self.total]  # from the last shard back: the earliest start that leaves the later ones enough room
        for _ in range(self.k - 1):
            latest_starts.append(self.back(latest_starts[-1], capacity))
        out, at = [], 0
        for j in range(1, self.k):
            lo, hi = max(latest_starts[self.k - j], at), self.reach(at, capacity, False)
            goal = at + (self.total - at) / (self.k - j + 1)
            i = min(bisect_left(self.ends, goal), len(self.ends) - 1)
            at = min((min(max(x, lo), hi) for x in (self.starts[i], self.ends[i])), key=lambda x: abs(x - goal))
            out.append(at)
        return out

    def open(self) -> set[int]:
        """Segments of several groups that decide between the lower and the upper bound of the capacity; none when these meet."""
        low, high = self.capacity(True), self.capacity(False)
        if low == high:
            return set()
        found: set[int] = set()
        x = y = 0
        for _ in range(self.k):
            x, y = self.reach(x, low, True), self.reach(y, high, True)
            first, last = (min(bisect_left(self.ends, at), len(self.ends) - 1) for at in (x, y))
            found.update(i for i in range(first, last + 1) if self.segments[i][1] > 1)
        return found


def _segments(groups: DataFrame, digits: int) -> list[Segment]:
    found = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.min("digest").alias("first"))
    return [(r["first"] if r["n"] == 1 else r["prefix"], r["n"], r["bytes"], r["largest"]) for r in found.collect()]


def plan_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the digest that each shard but the last ends before ("g" is past all)."""
    digits = FIRST_DIGITS
    segments = sorted(_segments(groups, digits))
    while segments:
        plan = _Plan(segments, n_shards)
        opened = {segments[i][0] for i in plan.open()}
        if not opened:
            break
        # Prefixes of one length are opened together; longer ones wait until they are found again.
        length = min(map(len, opened))
        opened = {x for x in opened if len(x) == length}
        parts = _segments(groups.where(F.substring("digest", 1, length).isin(sorted(opened))), length + MORE_DIGITS)
        segments = sorted([s for s in segments if s[0] not in opened] + parts)
    else:
        return 0, ["g"] * (n_shards - 1)
    capacity = plan.capacity(False)
    names = [s[0] for s in segments]
    return capacity, [names[i] if (i := bisect_left(plan.starts, x)) < len(names) else "g" for x in plan.cuts(capacity)]


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of ``docs`` (doc_id, text; other columns are ignored).

    A row's size is the UTF-8 bytes of its text plus 8, a null text counting as empty. Rows of equal texts
    share a shard. The largest shard is as small as any contiguous partition of the groups in hash order can
    make it; below that, cuts go where they even out the rest. Slots number a shard's rows from 0 without
    gaps, rows that repeat each other included, in an order that the rows fix. With fewer groups than shards
    some shards are empty; an empty table gives no rows. Texts of any length are hashed where they are read and don't move.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    rows = scratch.keep(digests(docs), "digests")
    groups = scratch.keep(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = plan_cuts(groups, n_shards)
    placed = rows.withColumn("shard", sum((F.when(F.col("digest") >= x, 1).otherwise(0) for x in cuts), F.lit(0)).cast("int"))

    parts = max(1, -(-rows.count() // (n_shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Rows of one id and text are alike, so they are counted, numbered as a run, and told apart again at the end.
    runs = placed.groupBy("shard", "part", "doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed_runs = runs.withColumn("first", F.sum("n").over(up_to) - F.col("n")).join(offsets, ["shard", "part"])
    runs = scratch.keep(placed_runs.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("first")).alias("first"), "n"), "runs")
    long = F.col("n") > SLOT_ROWS
    pieces = runs.where(long).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_ROWS).cast("long"))))
    pieces = pieces.withColumn("first", F.col("first") + F.col("at")).withColumn("n", F.least(F.col("n") - F.col("at"), F.lit(SLOT_ROWS))).drop("at").repartition("shard", "first")
    slots = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    return runs.where(~long).unionByName(pieces).select("doc_id", "size", "text_crc32", "shard", slots)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of nearly equal bytes."""
    C.shared_dir(spark)
    out = shard(C.table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
