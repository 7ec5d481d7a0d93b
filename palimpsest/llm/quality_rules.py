"""Quality rules as a ledger: every rule runs once, its failure is a bit beside the measurements, and policies are masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Name and failure of each rule over the ledger's measurements; the place is the bit. Places never change: a new rule goes to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "5 * n_capitals > 2 * word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)
#: Rules that each version of the policy applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "capitals"),
    "v2": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    part = lambda h, k: F.slice(h, k, F.greatest(n - 2, F.lit(0)))
    windows = _let(hashes, lambda h: F.zip_with(F.zip_with(part(h, 1), part(h, 2), lambda a, b: F.xxhash64(a, b)), part(h, 3), lambda a, b: F.xxhash64(a, b)))

    def repeated(s: Column) -> Column:
        """Places of the windows that equal a neighbour in hash order, ascending."""
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        places = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
        return F.sort_array(F.filter(places, lambda x: x.isNotNull()))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(ordered, lambda s: covered(repeated(s))))

    return _let(windows, count)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, a mask of RULES, for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: no words, so it fails few_words. Rows are independent; equal rows give
    equal results, and an empty table gives none. Texts are measured whole, however long. Everything stays within the row, without a shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ends = rf"^{C.SPACE}+|{C.SPACE}+$"
    bare = docs.select("doc_id", text.alias("text"))
    words = F.when(F.col("text").rlike(rf"^{C.SPACE}*$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("text", ends, ""), f"{C.SPACE}+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # A one-row explode is a fence: the optimiser would else repeat the split wherever the words are read.
    held = bare.select("doc_id", "text", F.explode(F.array(F.struct(words.alias("words"), lines.alias("lines")))).alias("x")).select("doc_id", "text", "x.words", "x.lines")
    n = F.size("words")
    measured = held.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(C.SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), n).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed", bits.cast("int"))


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """``rows`` of a ledger with base_failed and kept, which is what the policy's mask leaves."""
    fails = lambda p: F.col("failed").bitwiseAND(F.lit(mask(p))) != 0
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """rule, n_failed, n_failed_alone: rows that fail each rule of the policy, and those that only it rejects. One pass, one row per rule."""
    of = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    names = [name for name, _ in RULES if name in POLICIES[policy]]
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    sums = rows.agg(*(F.count_if(of.bitwiseAND(F.lit(bit[x])) != 0).alias(f"a_{x}") for x in names), *(F.count_if(of == bit[x]).alias(f"b_{x}") for x in names))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(f"a_{x}").alias("n_failed"), F.col(f"b_{x}").alias("n_failed_alone")) for x in names))))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents and what policy v2 keeps."""
    rows = apply_policy(ledger(C.table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


_BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
OP8_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{C.WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
        (length(text) - len(regexp_extract_all(text, '{C.SPACE}')))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({_BITS_SQL})::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & {mask("base")}) != 0 AS base_failed, (failed & {mask("v2")}) = 0 AS kept, failed FROM f
"""
