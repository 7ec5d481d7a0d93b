"""Homomorphic multiset hashes of documents.

A paragraph hashes to a wide vector and a document to the sum of its paragraphs' vectors modulo powers
of two, so paragraphs may come in any order, and may be added to or taken from a fingerprint without
the rest of the text. The vector has two parts. Sixteen 32-bit lanes of SHA-512 tell multisets of
paragraphs apart. 960 20-bit lanes are sums of random signs of the paragraph's three-word runs: a
run's hash picks one of 64 groups and its signs in that group's fifteen lanes. Their squared
difference estimates how many runs two documents don't share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from . import _common as C

EXACT_LANES, EXACT_MOD = 16, 1 << 32
#: The sign lanes stand three to a number, 20 bits each; a run goes to a group, by SPLIT_BITS twice, of PACKED numbers.
PACKED, PACKED_LANES, LANE_BITS = 5, 3, 20
PACKED_MOD = 1 << (PACKED_LANES * LANE_BITS)
SPLIT_BITS, SPLIT_AT = 3, (8, 14)
GROUPS = 1 << (2 * SPLIT_BITS)
_LANE_MASK = sum(1 << (LANE_BITS * i) for i in range(PACKED_LANES))
_LANE_HALVES = _LANE_MASK << (LANE_BITS - 1)
RUN = 3
#: Ranges of ids that find their neighbours apart from each other; a line of each is broadcast (a few MB).
MAX_RANGES, RANGE_ROWS = 1 << 16, 256
#: A range of so many times the wanted rows is cut again; no more turns than a 64-bit id has room for.
UNEVEN, TURNS = 4, 8
#: Up to so many times the number of runs, the estimated square of a text's vector is taken for that of runs that don't repeat (three standard errors).
REPEATS = 1.14


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def _runs(paragraph: Column) -> Column:
    """Hashes of a paragraph's runs of three words, or of all its words if they are fewer, in order of the hash; a run's repetitions are numbered, so that they count as so many different runs."""
    words = F.filter(F.split(paragraph, f"{C.SPACE}+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        part = lambda i: F.slice(h, i, n - (RUN - 1))
        whole = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= RUN, _let(F.sort_array(whole), numbered)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def numbered(s: Column) -> Column:
        """Equal hashes stand together: how many of them come before one is found by halving steps."""
        steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))  # a constant
        before = lambda x, i: F.aggregate(steps, F.lit(0), lambda r, p: r + F.when((i - r - p >= 0) & (F.get(s, i - r - p) == x), p).otherwise(0))
        return F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), F.xxhash64(x, before(x, i))).otherwise(x))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _signs(h: Column) -> Column:
    """Sums of signs of the runs ``h``, PACKED numbers for each group. Runs are split twice, so each is looked at 2 * 2**SPLIT_BITS times and added PACKED times."""
    zero = F.lit(0).cast("long")
    parts = F.sequence(zero, F.lit((1 << SPLIT_BITS) - 1).cast("long"))
    empty = F.struct(*(zero.alias(f"c{g}") for g in range(PACKED)))
    of = lambda runs, at, part: F.filter(runs, lambda x: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)) == part)

    def add(sums: Column, x: Column) -> Column:
        return F.struct(*((sums[f"c{g}"] + F.shiftrightunsigned(x, g).bitwiseAND(F.lit(_LANE_MASK))).bitwiseAND(F.lit(PACKED_MOD - 1)).alias(f"c{g}") for g in range(PACKED)))

    def summed(group: Column) -> Column:
        """Twice the runs that have a bit set, less all."""
        counts = F.aggregate(group, empty, add, lambda s: F.array(*(s[f"c{g}"] for g in range(PACKED))))
        return F.transform(counts, lambda c: (2 * c - F.size(group) * F.lit(_LANE_MASK)).bitwiseAND(F.lit(PACKED_MOD - 1)))

    halves = F.transform(parts, lambda i: _let(of(h, SPLIT_AT[0], i), lambda half: F.transform(parts, lambda j: _let(of(half, SPLIT_AT[1], j), summed))))
    return F.flatten(F.flatten(halves))


def fingerprint(text: Column) -> Column:
    """struct(exact array<long>, signs array<long>, runs long) of a text that isn't null."""

    def add_exact(sums: Column, paragraph: Column) -> Column:
        lane = lambda s, i: F.conv(F.substring(s, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
        return _let(F.sha2(paragraph, 512), lambda s: F.transform(sums, lambda x, i: (x + lane(s, i)) % EXACT_MOD))

    exact = F.aggregate(_paragraphs(text), F.array_repeat(F.lit(0).cast("long"), EXACT_LANES), add_exact)
    runs = F.flatten(F.transform(_paragraphs(text), _runs))
    both = _let(runs, lambda h: F.struct(_signs(h).alias("signs"), F.size(h).cast("long").alias("runs")))
    return _let(both, lambda b: F.struct(exact.alias("exact"), b["signs"].alias("signs"), b["runs"].alias("runs")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs together (sign 1), or of what is left of ``a`` without those of ``b`` (sign -1)."""
    put = lambda mod: lambda x, y: F.pmod(x + sign * y, F.lit(mod))
    return F.struct(
        F.zip_with(a["exact"], b["exact"], put(EXACT_MOD)).alias("exact"),
        F.zip_with(a["signs"], b["signs"], put(PACKED_MOD)).alias("signs"),
        (a["runs"] + sign * b["runs"]).alias("runs"),
    )


def render(f: Column) -> Column:
    """A fingerprint as text: lanes in hexadecimal, then the number of runs."""
    hexed = lambda lanes, width: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")
    return F.concat_ws("-", hexed(f["exact"], 8), hexed(f["signs"], 15), f["runs"].cast("string"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of common three-word runs, 2 * common / all for runs that don't repeat; 1 for equal fingerprints.

    It is 1 less the estimated squared difference over the squares of both texts, which are their numbers of runs unless runs
    repeat. The standard error is about 0.046 times what the texts don't share: 0.023 for halves, 0.005 for a tenth.
    """

    def squares(packed: Column) -> Column:
        """Estimated square of a vector: each group's mean over its lanes, summed. A sum stands modulo its lane's width and is taken for the value nearest to 0."""
        lane = lambda x, i: F.shiftrightunsigned(x, LANE_BITS * i).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) - (1 << (LANE_BITS - 1))
        square = lambda x, i: lane(x, i).cast("double") * lane(x, i)
        shifted = F.transform(packed, lambda x: F.pmod(x + _LANE_HALVES, F.lit(PACKED_MOD)))
        return F.aggregate(shifted, F.lit(0.0), lambda s, x: sum((square(x, i) for i in range(PACKED_LANES)), s)) / (PACKED * PACKED_LANES)

    def norm(f: Column) -> Column:
        return _let(squares(f["signs"]), lambda q: F.when(q <= REPEATS * f["runs"], f["runs"].cast("double")).otherwise(q))

    def compare(norms: Column) -> Column:
        apart = squares(F.zip_with(a["signs"], b["signs"], lambda s, t: s - t))
        return F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - apart / norms))).otherwise(0.0)

    same = (a["exact"] == b["exact"]) & (a["signs"] == b["signs"]) & (a["runs"] == b["runs"])
    return F.when(same, F.lit(1.0)).otherwise(_let(norm(a) + norm(b), compare))


def _ranged(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, tie) with ``range`` and ``part``, which rise with the doc_id; for null ids, range is null and part rises with the tie.

    A range is named by the lowest id that it can hold. All ids are one at first; one of more than UNEVEN times the wanted
    rows is cut into ranges of equal width between its own ends, again and again, so a few ids far off the others don't matter.
    Rows of one id stay together.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = max(RANGE_ROWS, -(-n // MAX_RANGES))
    k = max(1, nulls // wanted)
    place = F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * k), F.lit(k - 1)).cast("long")
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long"))).withColumn("part", F.when(F.col("doc_id").isNull(), place).otherwise(F.lit(0).cast("long")))
    for _ in range(TURNS):
        cells = docs.where("doc_id IS NOT NULL").groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("hi")).where((F.col("n") > UNEVEN * wanted) & (F.col("_lo") < F.col("hi")))
        width = F.floor((F.col("hi").cast("decimal(20,0)") - F.col("_lo")) / F.ceil(F.col("n") / wanted)) + 1
        cells = cells.select(F.col("range").alias("_of"), "_lo", width.cast("decimal(20,0)").alias("_width")).checkpoint()  # at most MAX_RANGES / UNEVEN rows
        if not cells.limit(1).count():
            break
        start = F.col("_lo") + F.floor((F.col("doc_id").cast("decimal(20,0)") - F.col("_lo")) / F.col("_width")) * F.col("_width")
        joined = docs.join(F.broadcast(cells), docs["range"] == cells["_of"], "left")
        docs = joined.withColumn("range", F.when(F.col("_of").isNotNull(), start.cast("long")).otherwise(F.col("range"))).drop("_of", "_lo", "_width")
    return docs


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and of each row the range and place within which ``F.lead`` finds the next document; see ``order``.

    Documents go by descending doc_id, rows of one doc_id by the hash of their text, null ids last. Ids are cut
    into ranges of about as many rows, each in one task. A range also gets, marked ``extra``, the
    first document of the next one, and the last range that of the first. So the text is shuffled once.
    """
    C.shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = _ranged(docs)
    first = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("turned"))).alias("first")  # the highest id, the lowest hash
    firsts = ranged.groupBy("range", "part").agg(first)  # a line for each range
    down = Window.orderBy(F.col("range").desc_nulls_last(), "part")
    start = F.first("first").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = firsts.select("range", "part", F.coalesce(F.lead("first").over(down), start).alias("next"))
    links = F.broadcast(links.select(F.col("range").alias("to_range"), F.col("part").alias("to_part"), F.col("next.doc_id").alias("next_id"), F.bitwise_not("next.turned").alias("next_tie")))
    found = docs.join(links, docs["doc_id"].eqNullSafe(links["next_id"]) & (docs["tie"] == links["next_tie"]))
    extra = found.select("doc_id", "text", "tie", F.col("to_range").alias("range"), F.col("to_part").alias("part"), F.lit(True).alias("extra")).dropDuplicates(["range", "part"])
    return ranged.withColumn("extra", F.lit(False)).unionByName(extra)


def order() -> WindowSpec:
    return Window.partitionBy("range", "part").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, by descending doc_id, the first after the last. A null text counts as empty; a table of one
    row is its own next; an empty table gives no rows; other columns are ignored. Texts of any length are read whole; a row takes
    memory for its own text and the next one's.
    """
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order())).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - half), F.col("next_text").substr(F.lit(1), half))))
    rows = rows.select("range", "part", "extra", "doc_id", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("f"), fingerprint(F.col("edited")).alias("g"))
    rows = rows.withColumn("next_f", F.lead("f").over(order())).where(~F.col("extra"))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        render(F.col("f")).alias("fingerprint"),
        render(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edits(C.table(spark, sf_dir, "documents"))
