"""The trie of conversations' common beginnings: digest-keyed edges to parents, rolled up to all ancestors by pointer jumping.

A node is a digest of the turns so far: lanes of SHA-256 of each turn and its place, summed modulo 2**32, so that
the digest of every prefix is a running sum, which splits over tasks wherever a conversation is long, and a
parent's digest is the child's less the last turn. Each round doubles the distance of every node's pointer and
adds what the pointers' sources have gathered, so depth d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: 32-bit lanes of a digest.
LANES = 4
ROOT = "0" * 8 * LANES
#: A key with more rows than this, and than a thousandth of all, is looked up by a broadcast of at most a thousand rows.
FEW = 10_000
#: Characters of one piece of a list of ids.
PIECE = 1 << 20


def steps(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item (SHA-256 of role and text), chars of the text, for each row that has a conv_id; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", item.alias("item"), F.char_length(text).cast("long").alias("chars"))


def _running(rows: DataFrame, order: list[Column], sums: list[str], scratch: C.Scratch, name: str) -> DataFrame:
    """``rows`` with each of ``sums`` (no negative numbers) replaced by its sum over the rows of their conv_id up to this one.

    Rows are dealt by ranges of conv_id and order, so a long conversation spreads over tasks; a range can go
    on with one conversation of those before it at most, so there are no more offsets than ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv_id", *order).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy("_part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = scratch.keep(dealt.select(*(c for c in dealt.columns if c not in sums), *(F.sum(c).over(upto).alias(c) for c in sums)), name)
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("conv_id", "_part").agg(*(F.max(c).alias(c) for c in sums))
    offsets = totals.select("conv_id", "_part", *(F.sum(c).over(before).alias(f"_{c}") for c in sums)).where(F.col(f"_{sums[0]}").isNotNull())
    joined = local.join(F.broadcast(offsets), ["conv_id", "_part"], "left")
    return joined.select(*(c for c in rows.columns if c not in sums), *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums))


def _look_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``table``, of which ``key`` names one row each; rows without it go. Keys of more than FEW rows and a thousandth of ``total`` are at most a thousand and are broadcast."""
    hot = rows.groupBy(key).count().where(F.col("count") > max(FEW, total // 1000)).select(key)
    few = F.broadcast(table.join(F.broadcast(hot), key))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def in_order(rows: DataFrame, scratch: C.Scratch) -> DataFrame:
    """conv_id, pos from 1, item, chars of ``steps``: by turn, null first; ties go by item, and rows that still tie are equal."""
    # Equal rows are told apart by a number that is written with them, so that a reread agrees.
    held = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("pos", F.lit(1).cast("long")), "steps")
    return _running(held, [F.col("turn").asc_nulls_first(), F.col("item"), F.col("_row")], ["pos"], scratch, "order").select("conv_id", "pos", "item", "chars")


def borrow(placed: DataFrame, scratch: C.Scratch, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Steps and ids of conversations of which each begins like the first of its ``span`` ids: h turns of that one (crc32 of the id modulo ``most``; fewer where it has fewer, none where it is absent) stand for its own first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    ids = placed.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), h.alias("h"))
    heads = placed.where((F.col("conv_id") % span == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    ids = scratch.keep(ids.join(heads.groupBy("base").agg(F.max("pos").alias("have")), "base", "left").withColumn("moved", F.least("h", F.coalesce("have", F.lit(0))) - F.col("h")), "ids")
    given = ids.join(heads, "base").where("pos <= h").select("conv_id", "pos", "item", "chars")
    own = placed.where(F.col("pos") > h)
    moved = _look_up(own, "conv_id", ids.where("moved < 0").select("conv_id", "moved"), ids.count()).withColumn("pos", F.col("pos") + F.col("moved")).drop("moved")
    # Who has nothing to move is told by the id alone where the base has its turns; only the short bases' ids have to be known.
    still = _without(own, ids.where("moved < 0").select("conv_id"))
    return given.unionByName(still).unionByName(moved), ids.select("conv_id")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose conv_id isn't among ``ids``; keys with many rows are split by their place."""
    salts = 32
    salted = ids.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int")).join(salted, ["conv_id", "_salt"], "left_anti").drop("_salt")


def _digest(lanes: list[Column]) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x % (1 << 32))), 8, "0") for x in lanes))


def _list_hashes(ends: DataFrame) -> DataFrame:
    """id, ends_sha256: SHA-256 of the ascending conv_ids of each id, joined by commas.

    Sorted ranges make pieces of text, so a node that ends a third of all conversations is read and
    written out by many tasks; the hash itself has to take its pieces one after the other, and does so as a stream.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, convs = batch["id"].to_pylist(), batch["conv_id"].to_numpy()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            cut = sorted({k for a, b in zip(cut, cut[1:], strict=False) for k in range(a, b, PIECE // 20)} | {len(ids)})
            at = cut[:-1]
            yield pa.RecordBatch.from_pydict({"id": [ids[a] for a in at], "first": convs[np.array(at)], "piece": [",".join(map(str, convs[a:b].tolist())) for a, b in zip(at, cut[1:], strict=True)]})

    def hashes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            done: dict[str, list] = {"id": [], "ends_sha256": []}
            for node, piece in zip(batch["id"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if node != now:
                    if state:
                        done["id"].append(now)
                        done["ends_sha256"].append(state.hexdigest())
                    now, state = node, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pydict(done, pa.schema([("id", pa.string()), ("ends_sha256", pa.string())]))
        if state:
            yield pa.RecordBatch.from_pydict({"id": [now], "ends_sha256": [state.hexdigest()]})

    ranged = ends.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id string, first long, piece string")
    return ranged.repartition(parts, "id").sortWithinPartitions("id", "first").mapInArrow(hashes, "id string, ends_sha256 string")


def roll_up(nodes: DataFrame, scratch: C.Scratch, sums: list[str], total: int, deepest: int) -> DataFrame:
    """id and, for each of ``sums``, its sum over the subtree, of ``nodes`` (id, parent, the sums), whose edges make trees of ``deepest`` edges at most.

    In round k a node's pointer goes to its ancestor 2**k above and its sums cover the distances below 2**k;
    what points to a node is added to it, and the pointer goes on to its target's own pointer.
    """
    so_far = nodes.select("id", *sums)
    pointers = nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"))
    for k in range(deepest.bit_length()):
        gathered = scratch.keep(pointers.join(so_far, "id").groupBy("to").agg(*(F.sum(c).alias(f"_{c}") for c in sums)), f"gathered-{k}")
        so_far = scratch.keep(so_far.join(gathered.withColumnRenamed("to", "id"), "id", "left").select("id", *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums)), f"sums-{k}")
        onward = pointers.select(F.col("id").alias("to"), F.col("to").alias("then"))
        pointers = scratch.keep(_look_up(pointers, "to", onward, total).select("id", F.col("then").alias("to")), f"pointers-{k}")
    return so_far


def trie(placed: DataFrame, members: DataFrame, scratch: C.Scratch) -> DataFrame:
    """One row for each node of the conversations ``members`` (conv_id) with the turns ``placed`` (conv_id, pos from 1 without gaps, item, chars).

    id and parent (digests; the root's parent is null), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (of the subtree: chars of a node's last text for each member but one), ends_sha256. Members without turns are the
    root's. No member, no node.
    """
    lane = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("item")), 256)
    lanes = [f"l{k}" for k in range(LANES)]
    own = [f"o{k}" for k in range(LANES)]
    cut = placed.withColumn("_h", lane).select("conv_id", "pos", "chars", *(F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(o) for k, o in enumerate(own)))
    summed = _running(cut.select("*", *(F.col(o).alias(x) for o, x in zip(own, lanes, strict=True))), [F.col("pos")], lanes, scratch, "prefixes")
    here, above = _digest([F.col(x) for x in lanes]), _digest([F.col(x) - F.col(o) for x, o in zip(lanes, own, strict=True)])
    none = F.lit(None).cast("string")
    tops = members.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("id"), none.alias("parent"), F.lit(0).cast("long").alias("chars"))
    rows = scratch.keep(summed.select("conv_id", "pos", here.alias("id"), above.alias("parent"), "chars").unionByName(tops), "members")

    plain = scratch.keep(rows.groupBy("id", "parent", F.col("pos").alias("depth"), "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    total, deepest = plain.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    children = plain.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = plain.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.keep(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "edges")
    sums = roll_up(nodes, scratch, ["n_leaves", "saved_tokens"], total, deepest)

    # The last place of each conversation, from which its end is the row that has it.
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "id")).alias("x")).select("conv_id", "x.id")
    hashes = scratch.keep(_list_hashes(ends), "ends")
    parents = _look_up(nodes.where("parent IS NOT NULL").select("id", "parent"), "parent", nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), total)
    out = nodes.drop("n_leaves", "saved_tokens", "chars").join(sums, "id").join(hashes, "id", "left").join(parents.drop("parent"), "id", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_trie(conversations: DataFrame, shared: bool = False) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text; other columns, whatever their names, are ignored), of which ``shared`` makes each begin as ``borrow`` says.

    Turns go by turn, null first; of equal ones by the hash of role and text, and rows that repeat all of these stand one
    after the other. Null roles and texts are empty. Rows without conv_id belong to no conversation. An empty table has no node. Texts
    are hashed where they are read, so long ones take no more than their own memory; long conversations and common beginnings are split.
    """
    spark = conversations.sparkSession
    C.shared_dir(spark)
    scratch = C.Scratch(spark)
    placed = scratch.keep(in_order(steps(conversations), scratch), "placed")
    members = placed.where("pos = 1").select("conv_id")
    if shared:
        placed, members = borrow(placed, scratch)
    out = trie(placed, members, scratch)
    kept = C.Scratch(spark).keep(out, "trie")  # read by the caller
    scratch.drop()
    return kept


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations."""
    found = conversation_trie(C.table(spark, sf_dir, "conversations"), shared=True)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = (
    "xor(list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda a, b: list_reduce(list_transform(range(8), lambda k: 0::UBIGINT), "
    "lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
)
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS item FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, length(text) AS chars, item, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({_CRC.format("conv_id")} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, o.i, o.item, o.chars FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
      UNION ALL SELECT c.conv_id, 1, o.i, o.item, o.chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
p AS (SELECT conv_id, chars, row_number() OVER w AS d, sha256(string_agg(item, ',') OVER w) AS id FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
q AS (SELECT conv_id, d, id, lag(id, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS up, chars FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
e AS (SELECT id, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(id, d) AS id FROM q GROUP BY conv_id) GROUP BY id),
n AS (SELECT id, up, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM q GROUP BY id, up, d),
k AS (SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT q.id, count(*) FILTER (k.id IS NULL) AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens FROM n JOIN q ON q.conv_id = n.conv_id AND q.d <= n.d LEFT JOIN k ON k.id = n.id GROUP BY q.id)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (id) LEFT JOIN k ON k.id = n.id LEFT JOIN e ON e.id = n.id LEFT JOIN n m ON m.id = n.up
"""
