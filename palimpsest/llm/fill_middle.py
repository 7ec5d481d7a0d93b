"""Fill-in-the-middle examples by escaped markers: a delimiter is escaped, put after every unit, counted, and ranked parts are taken between its places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: The delimiter after a unit and the escape; both may occur in texts, which are escaped first.
MARK, ESCAPE = "\x1f", "\x1b"
#: Lines with their line feed; what is left at the end is a unit too.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Plan:
    """How documents are cut: the seed of the draws, the share of documents in 100 that is turned, that of them in suffix-first form, the unit and the three sentinels."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        names = self.sentinels
        if not all(names) or len(set(names)) < 3 or any(a in b for a in names for b in names if a is not b):
            raise ValueError("the sentinels have to differ, and none may hold another")
        if any(a[-k:] == b[:k] for a in names for b in names for k in range(1, min(len(a), len(b)))):
            raise ValueError("no sentinel may end as one begins: else the parts couldn't be told from them")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(MARK), F.lit(f"{ESCAPE}m"))


def _unescape(marked: Column) -> Column:
    """The text of a part: without the delimiters put after units, with those that the text itself has."""
    return F.replace(F.replace(F.replace(marked, F.lit(MARK), F.lit("")), F.lit(f"{ESCAPE}m"), F.lit(MARK)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def _ranked(marked: Column, first: Column, last: Column, n: Column) -> Column:
    """Units ``first`` + 1 to ``last`` of ``n`` marked ones, unescaped."""
    upto = F.call_function("substring_index", marked, F.lit(MARK), last)
    part = F.call_function("substring_index", upto, F.lit(MARK), first - last)
    # With every unit kept, the last delimiter counts as well, so the parts are counted from it.
    tail = F.call_function("substring_index", marked, F.lit(MARK), first - n - 1)
    return _unescape(F.when(last == n, tail).otherwise(part))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that the seed and the id fix."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that ``output`` of this ``form`` was made from: a text holds no sentinel unless it is plain, so each stands once."""
    p, s, m = plan.sentinels
    before = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    cut = lambda x, first, then: (F.substring_index(F.substring_index(x, then, 1), first, -1), F.substring_index(x, then, -1))
    prefix, suffix = cut(before, p, s)
    suffix_, prefix_ = cut(before, s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle, suffix_)).otherwise(output)


def turn(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n units, form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text; other columns, whatever their names, are ignored).

    The first cut falls after the smaller of two drawn numbers of units, the second after the larger, so any part may
    be empty. Form is plain, and the output the text, for an empty text (a null one is empty), one that holds a
    sentinel, and one outside ``rate``; the chars are null there. The draws hang on the seed and the id alone: rows of
    one id, and all rows of a null one, share them, and equal rows give equal results. Rows are independent: an
    empty table gives none, nothing is shuffled, and a row takes memory for a few copies of its text, however long.
    """
    p, s, m = map(F.lit, plan.sentinels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = _draws(F.col("doc_id"), plan.seed)
    bare = docs.select("doc_id", text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))
    marked = F.regexp_replace(_escape(F.col("text")), plan.unit, f"$0{MARK}")
    # One-row explodes are fences: the optimiser would else repeat what is read several times.
    held = bare.select("doc_id", "text", "h1", "h2", "h3", "h4", F.explode(F.array(marked)).alias("marked"))
    n = F.char_length("marked") - F.char_length(F.replace("marked", F.lit(MARK), F.lit("")))
    counted = held.select("*", F.explode(F.array(n.cast("int"))).alias("n"))
    cuts = [(F.col(x) % (F.col("n") + 1)).cast("int") for x in ("h1", "h2")]
    bad = (F.col("text") == "") | (F.col("h3") % 100 >= plan.rate)
    for x in plan.sentinels:
        bad = bad | F.col("text").contains(x)
    form = F.when(bad, "plain").when(F.col("h4") % 100 < plan.suffix_first, "spm").otherwise("psm")
    cut = counted.select("doc_id", "text", "marked", "n", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), form.alias("form"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    parts = F.struct(_ranked(F.col("marked"), F.lit(0), a, n).alias("prefix"), _ranked(F.col("marked"), a, b, n).alias("middle"), _ranked(F.col("marked"), b, n, n).alias("suffix"))
    made = cut.select("doc_id", "text", "n", "form", F.explode(F.array(F.when(F.col("form") != "plain", parts))).alias("x"))
    x = lambda k: F.col(f"x.{k}")
    output = F.when(F.col("form") == "psm", F.concat(p, x("prefix"), s, x("suffix"), m, x("middle"))).when(F.col("form") == "spm", F.concat(s, x("suffix"), p, x("prefix"), m, x("middle"))).otherwise(F.col("text"))
    return made.select(
        "doc_id",
        F.col("n").cast("long").alias("n"),
        "form",
        F.char_length(x("prefix")).cast("long").alias("prefix_chars"),
        F.char_length(x("middle")).cast("long").alias("middle_chars"),
        output.alias("output"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document turned by lines, and what is rebuilt from the output and its form."""
    made = turn(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    fenced = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.explode(F.array("output")).alias("output"))
    sha = lambda c: F.sha2(c, 256)
    return fenced.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


_DRAWS_SQL = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
_JOIN = "coalesce(array_to_string({}, ''), '')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{LINES}') AS units, {_DRAWS_SQL} FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {_JOIN.format("units[1:a]")} AS prefix, {_JOIN.format("units[a + 1:b]")} AS middle, {_JOIN.format("units[b + 1:]")} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
