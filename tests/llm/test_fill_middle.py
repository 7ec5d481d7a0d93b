"""Fill-in-the-middle examples against a plain rebuilding of them."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, form string, output string, marked string, x long"
TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a\nb\nc\nd\ne\n", "has <P> inside\nno", "ends with <", "<S", ">\n<\nM>\n", "\x1f\n\x1b\x1fm\x1b\n\x1be\x1bm", "$0 \\1 $\n\\\n", "\r\n\r\n x", "Öl\n\U0001f600 é\n\x00z",
    "line of words\n" * 3000, "w" * 300_000, "x\n" * 50_000 + "tail",
]


def brute(doc_id, text, plan):
    text = text or ""
    units = re.findall(plan.unit, text)
    h = [int(hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in plan.sentinels) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = plan.sentinels
    spm = h[3] % 100 < plan.suffix_first
    return len(units), "spm" if spm else "psm", len(x), len(y), f"{s}{z}{p}{x}{m}{y}" if spm else f"{p}{x}{s}{z}{m}{y}"


@pytest.mark.parametrize("plan", [fill_middle.Plan(), fill_middle.Plan(seed=3, rate=60, suffix_first=20), fill_middle.Plan(unit=r"[^ ]* |[^ ]+", prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")])
def test_equals_brute_force(spark, plan):
    rows = [(i * 7 - 3, t, "n", "f", "o", "m", i) for i, t in enumerate(TEXTS * 6)] + [(None, "no id\nat all\n", *"abcd", 1), (None, "another\none", *"abcd", 1), (4, "again\na", *"abcd", 1), (4, "again\na", *"abcd", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_middle.turn(docs, plan).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), plan))
    found = sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made.collect())))
    assert found == sorted(repr((i, *brute(i, t, plan), t or "")) for i, t, *_ in rows)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    out = fill_middle.turn(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_bad_sentinels():
    for names in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Plan(prefix=names[0], suffix=names[1], middle=names[2])
