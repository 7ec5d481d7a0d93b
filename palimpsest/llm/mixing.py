"""Mixing sources to target weights: repetition rates, whole copies, and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Draws of a document: 32-bit numbers, eight from each SHA-256 of its key and a counter.
DRAWS = 32
#: Bytes of the table of sources up to which it is broadcast; a larger one meets the documents by salted keys.
MAX_SOURCE_BYTES, SALTS = 8 << 20, 32


def _ranked(sizes: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``sizes`` with ``rank``, from 1, by source in code-point order, null last. The sorted table is kept, so that its parts don't change; only their row counts meet in one task."""
    parts = scratch.keep(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for each row of ``sizes`` (source, source_size), one for each source.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes in
    proportion; no target exceeds ``most`` times its source, and what is cut is shared again by weight. Each round
    is one aggregate: sources whose cap doesn't exceed their part of what is left are cut, which raises the others' part, until no
    more are. So nothing but a line of sums comes to the driver, however many sources there are.
    """
    spark = sizes.sparkSession
    scratch = C.Scratch(spark)
    ranked = _ranked(sizes, scratch).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = scratch.keep(ranked.select("source", "source_size", "weight", (most * F.col("source_size")).alias("top")), "ranked")
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left = budget = share * (whole[0] or 0)
    weight, n_cut, cut = whole[1] or 0, 0, F.lit(False)
    while weight:
        cut = F.col("top") * weight <= F.col("weight") * left
        now = ranked.agg(F.count_if(cut), F.sum(F.when(cut, F.col("top")).otherwise(0.0)), F.sum(F.when(cut, 0).otherwise(F.col("weight")))).first()
        if now[0] == n_cut:
            break
        n_cut, left, weight = now[0], budget - now[1], now[2]
    out = ranked.select("source", "source_size", F.when(cut, F.col("top")).otherwise(F.col("weight") * left / max(weight, 1)).alias("target")).checkpoint()
    scratch.drop()
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def _draws(key: Column) -> Column:
    hashes = F.concat(*(F.sha2(F.concat(key, F.lit(f":{i}")), 256) for i in range(DRAWS // 8)))
    return F.array(*(F.conv(F.substring(hashes, 8 * j + 1, 8), 16, 10).cast("double") / 2.0**32 for j in range(DRAWS)))


def _join_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """``rows`` (source, _key, ...) with what ``sources`` (source, ...) says of their source; a source's rows are never all in one task."""
    named = sources.withColumnRenamed("source", "_of")
    if small:
        return rows.join(F.broadcast(named), rows["source"].eqNullSafe(named["_of"])).drop("_of")
    named = named.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    return rows.join(named, rows["source"].eqNullSafe(named["_of"]) & (rows["_part"] == named["_salt"])).drop("_of", "_salt", "_part")


def _key() -> Column:
    """What fixes a row's draws: its doc_id, or of a null one its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _rates(base: DataFrame, **how) -> tuple[DataFrame, bool]:
    """(source, source_size, target, _whole copies, _part of one more, _j the draw) of ``base`` (source, size, _key), and whether these are few enough to be broadcast."""
    rates = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.select("source", "source_size", "target", F.floor("rate").cast("long").alias("_whole"), (F.col("rate") - F.floor("rate")).alias("_part_of_one"))
    small = (rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0) <= MAX_SOURCE_BYTES
    joined = _join_sources(base, rates, small).withColumn("_u", _draws(F.col("_key")))
    sums = joined.groupBy("source", "source_size", "target", "_whole", "_part_of_one").agg(F.sum("size").alias("words"), *(F.sum(F.when(F.col("_u")[j] < F.col("_part_of_one"), F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(DRAWS)))
    off = [F.struct(F.abs(F.col("words") * F.col("_whole") + F.col(f"s{j}") - F.col("target")).alias("off"), F.lit(j).alias("j")) for j in range(DRAWS)]
    return sums.select("source", "source_size", "target", "_whole", "_part_of_one", F.least(*off)["j"].alias("_j")).checkpoint(), small


def _copies() -> Column:
    """Copies of a row that has _key and its source's _whole, _part_of_one and _j."""
    return F.col("_whole") + (F.element_at(_draws(F.col("_key")), F.col("_j") + 1) < F.col("_part_of_one")).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("_key"))


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row of ``docs`` (doc_id, text, source).

    A source's rate is target / source_size. Each document gets floor(rate) copies and one more if its
    draw, a number in [0, 1) that its doc_id (of a null one, its text) and nothing else fixes, is below the
    fraction. There are DRAWS of them; each source uses the one whose sum comes nearest to its target
    (the first on ties), so reruns agree: with one draw a source of a few long documents may end far from its target. Null
    sources are a source, null texts have size 0, an empty table gives no rows; rows that repeat a doc_id are drawn alike;
    other columns, whatever their names, are ignored. Of a text of any length only its number of words goes on.
    """
    scratch = C.Scratch(docs.sparkSession)
    base = scratch.keep(_sized(docs), "sizes")
    rates, small = _rates(base, **how)
    out = _join_sources(base, rates, small).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies")).checkpoint()
    scratch.drop()
    return out


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` takes them, with all their columns; each row, repeated ids and null ones included, by its own draw.

    The second pass over the texts meets the rates of the sources and nothing else, so no text is shuffled
    unless the sources are too many for a broadcast. Columns of any name are kept, and an empty table stays empty; texts are whole, however long.
    """
    scratch = C.Scratch(docs.sparkSession)
    rates, small = _rates(scratch.keep(_sized(docs), "sizes"), **how)
    scratch.drop()
    rows = docs.select("source", _key().alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    taken = _join_sources(rows, rates, small).select("_row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("_copy"))
    return taken.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document."""
    C.shared_dir(spark)
    mixed = plan(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_HASHES_SQL = " || ".join(f"sha256(key || ':{i}')" for i in range(DRAWS // 8))
_DRAWS_SQL = ", ".join(f"('0x' || substr(h, {8 * j + 1}, 8))::UBIGINT::DOUBLE / 4294967296.0 AS u{j}" for j in range(DRAWS))
_SUMS_SQL = ", ".join(f"sum(CASE WHEN u{j} < part THEN size ELSE 0 END) AS s{j}" for j in range(DRAWS))
_OFF_SQL = ", ".join(f"abs(words * whole + s{j} - target)" for j in range(DRAWS))
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{C.WORD}'))::BIGINT AS size,
             coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key FROM documents),
base AS (SELECT doc_id, source, size, {_DRAWS_SQL} FROM (SELECT *, {_HASHES_SQL} AS h FROM d)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, [3, 1, 2][(rk - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS top FROM r),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
        1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER o, 0.0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights_left
      FROM w WINDOW o AS (ORDER BY top / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, top * weights_left <= weight * rest AS cut FROM b),
t AS (SELECT source, source_size, CASE WHEN cut THEN top ELSE weight * (budget - sum(CASE WHEN cut THEN top ELSE 0.0 END) OVER ())
        / sum(CASE WHEN cut THEN 0 ELSE weight END) OVER () END::DOUBLE AS target FROM c),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
p AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM rate),
j AS (SELECT base.*, source_size, target, whole, part FROM base JOIN p ON base.source IS NOT DISTINCT FROM p.source),
sums AS (SELECT source, target, whole, sum(size) AS words, {_SUMS_SQL} FROM j GROUP BY source, target, whole),
pick AS (SELECT source AS src, list_position([{_OFF_SQL}], list_min([{_OFF_SQL}])) AS k FROM sums)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN [{", ".join(f"u{j}" for j in range(DRAWS))}][k] < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j JOIN pick ON j.source IS NOT DISTINCT FROM pick.src
"""
