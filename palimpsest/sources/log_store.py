"""A store that takes one change for the price of that change: rows are appended, and merged when they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..operators.lifecycle import Change, Tables
from ..schema import ENTITY_LINKS, HISTORY, MEMORIES
from .commits import Commits

#: Kinds of rows that a change has, with their columns; an entity whose links a reset removed is named without its memories.
ENTITY = ", ".join(x for x in ENTITY_LINKS.split(", ") if x.split()[0] not in ("id", "seq"))
KINDS = {"put": MEMORIES, "drop": "id string", "history": HISTORY, "links": ENTITY_LINKS, "unlink": ENTITY}


@dataclass
class Snapshot(Tables):
    """Tables at a version, and how many entries their history has."""

    version: int = 0
    events: int = 0


class LogStore:
    """Memories, history and links as a base and the changes since.

    ``append`` writes the rows of a change and one commit; ``load`` reads the base without what changes touch, and the
    newest row of that. Changes are few next to the base until ``compact``, so Spark broadcasts their ids as long as these are small, by
    its own measure, and shuffles them otherwise. ``save`` replaces everything, for which ``compact`` uses it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def _state(self, version: int) -> dict:
        """Folders by kind, each with its version; base, events, applied batches."""
        last = self.commits.read(version)
        return {"base": None, "parts": {}, "events": 0, "applied": {}} | last

    def load(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of a version which is still there."""
        version = self.commits.latest() if version is None else version
        state = self._state(version)
        parts = lambda kind: state["parts"].get(kind, {})
        base = lambda kind: {state["base"][kind]: 0} if state["base"] else {}
        get = lambda kind, some: self.commits.get(kind, some, KINDS[kind])
        kept = get("put", base("put"))
        if parts("put") or parts("drop"):
            columns = [c for c in kept.columns if c != "_v"]
            puts = get("put", parts("put")).select("id", F.col("_v"), F.lit(1).alias("_kind"), F.struct(*columns).alias("row"))
            drops = get("drop", parts("drop")).select("id", F.col("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(puts.schema["row"].dataType).alias("row"))
            newest = puts.unionByName(drops).groupBy("id").agg(F.max_by("row", F.struct("_v", "_kind")).alias("row"))
            kept = kept.drop("_v").join(newest.select("id"), "id", "left_anti").select(*columns).unionByName(newest.where("row IS NOT NULL").select("row.*"))
        else:
            kept = kept.drop("_v")
        links = get("links", base("links") | parts("links"))
        if parts("unlink"):
            gone = get("unlink", parts("unlink"))
            keys = [c for c in gone.columns if c != "_v"]
            gone = gone.groupBy(*keys).agg(F.max("_v").alias("_until")).select(F.struct(*keys).alias("_key"), "_until")
            mine = F.struct(*(F.col(k) for k in keys))
            links = links.withColumn("_mine", mine).join(gone, F.col("_mine").eqNullSafe(F.col("_key")) & (F.col("_v") < F.col("_until")), "left_anti").drop("_mine")
        return Snapshot(kept, get("history", base("history") | parts("history")).drop("_v"), links.drop("_v"), version, state["events"])

    def own(self, version: int) -> DataFrame:
        """The memories that a change put."""
        own = (self.commits.read(version).get("own") or {}).get("put")
        return self.commits.get("put", {own: version} if own else {}, MEMORIES).drop("_v")

    def touched(self, since: int, until: int) -> DataFrame | None:
        """id of the memories that the changes after ``since`` up to ``until`` put or dropped; None if one replaced everything."""
        ids = self.spark.createDataFrame([], "id string")
        for n in range(since + 1, until + 1):
            body = self.commits.read(n)
            if body["own"] is None and not body.get("compaction"):
                return None
            for kind in ("put", "drop"):
                if name := (body["own"] or {}).get(kind):
                    ids = ids.unionByName(self.commits.get(kind, {name: n}, KINDS[kind]).select("id"))
        return ids.distinct()

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a change came from, -1 for none."""
        return self._state(self.commits.latest())["applied"].get(stream, -1)

    def append(self, change: Change, read: int, batch: tuple[str, int] | None = None) -> int | None:
        """Commits ``change``, which was worked out on version ``read``; its own version, or None if its ``batch`` (stream, number) is in already.

        If others have committed meanwhile, the change stands when they touched none of its ids, and when it was worked out on all
        memories of a scope (``change.scope``, as new facts and resets are), none of that scope; else it is a Conflict and nothing is changed.
        """
        if batch and self.applied(batch[0]) >= batch[1]:
            return None
        written = {kind: self.commits.put(df, kind) for kind in KINDS if (df := getattr(change, kind)) is not None}
        events = self.commits.get("history", {written["history"]: 0}, HISTORY).count() if "history" in written else 0
        while True:
            latest = self.commits.latest()
            state = self._state(latest)
            if batch and state["applied"].get(batch[0], -1) >= batch[1]:
                return None
            for n in range(read + 1, latest + 1):
                self._check(n, written, change.scope)
            version = latest + 1
            parts = {kind: state["parts"].get(kind, {}) | ({written[kind]: version} if kind in written else {}) for kind in KINDS}
            body = {"base": state["base"], "parts": parts, "events": state["events"] + events, "applied": state["applied"] | (dict([batch]) if batch else {}), "own": written}
            try:
                return self.commits.write(version, body)
            except Conflict:
                read = max(read, latest)  # someone else got this number; look at what they did

    def _check(self, n: int, written: dict[str, str], scope: dict[str, str] | None) -> None:
        other = self.commits.read(n)["own"]
        if other is None:  # a compaction or a replacement
            if not self.commits.read(n).get("compaction"):
                raise Conflict(f"version {n} replaced everything")
            return
        ids = lambda which: [self.commits.get(kind, {which[kind]: 0}, KINDS[kind]).select("id") for kind in ("put", "drop") if kind in which]
        for a in ids(written):
            for b in ids(other):
                if a.join(b, "id", "left_semi").limit(1).count():
                    raise Conflict(f"version {n} changed the same memories")
        if scope is not None and "put" in other:
            same = self.commits.get("put", {other["put"]: 0}, MEMORIES)
            for k, v in scope.items():
                same = same.where(F.col("payload")[k] == v)
            if same.limit(1).count():
                raise Conflict(f"version {n} changed the same scope")

    def save(self, tables: Tables, compaction: bool = False) -> int:
        """Replaces everything by ``tables``. With ``compaction`` they say the same as before, so other writers needn't mind."""
        read = tables.version if isinstance(tables, Snapshot) else self.commits.latest()
        state = self._state(read)
        base = {"put": self.commits.put(tables.memories, "put"), "history": self.commits.put(tables.history, "history"), "links": self.commits.put(tables.links, "links")}
        events = self.commits.get("history", {base["history"]: 0}, HISTORY).count()
        return self.commits.write(read + 1, {"base": base, "parts": {}, "events": events, "applied": state["applied"], "own": None, "compaction": compaction})

    def compact(self, least: int = 1) -> int | None:
        """Merges the changes into a new base if there are ``least``; its version. A Conflict means that someone wrote meanwhile: try again."""
        read = self.commits.latest()
        parts = self._state(read)["parts"]
        if len({v for x in parts.values() for v in x.values()}) < least:
            return None
        return self.save(self.load(read), compaction=True)
