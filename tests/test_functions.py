"""Filters, text and embeddings, case by case."""

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import Provider, Validation
from palimpsest.functions import filters, text
from palimpsest.functions.embed import embed_text, hash_embedding

CASES = [
    ({"user_id": "alice"}, {"user_id": "alice"}, True),
    ({"user_id": "alice"}, {}, False),
    ({"user_id": {"ne": "alice"}}, {"user_id": "bob"}, True),
    ({"user_id": {"ne": "alice"}}, {}, False),
    ({"c": {"in": ["a", "b"]}}, {"c": "b"}, True),
    ({"c": {"in": []}}, {"c": "b"}, False),
    ({"c": {"nin": ["a", "b"]}}, {"c": "c"}, True),
    ({"c": {"nin": ["a"]}}, {}, False),
    ({"c": {"nin": []}}, {"c": "c"}, True),
    ({"user_id": "*"}, {}, True),
    ({"user_id": {"eq": "*"}}, {"user_id": "x"}, False),
    ({"p": {"eq": 10}}, {"p": "10"}, True),
    ({"p": {"eq": 10}}, {"p": "1e1"}, True),
    ({"p": {"eq": 10}}, {"p": " 10 "}, False),
    ({"p": {"eq": 1}}, {"p": "1d"}, False),
    ({"p": {"gt": 5}}, {"p": "10"}, True),
    ({"p": {"gt": 10}}, {"p": "10"}, False),
    ({"p": {"gte": 10}}, {"p": "10"}, True),
    ({"p": {"lt": 20}}, {"p": "10"}, True),
    ({"p": {"lte": 10}}, {"p": "10"}, True),
    ({"p": {"gt": 5}}, {"p": "unspecified"}, True),
    ({"p": {"lt": 5}}, {"p": "unspecified"}, False),
    ({"p": {"gt": 5}}, {"p": "NaN"}, False),
    ({"p": {"eq": 5}}, {"p": "NaN"}, False),
    ({"p": {"ne": 5}}, {"p": "NaN"}, True),
    ({"p": {"gt": 5}}, {"p": "inf"}, True),
    ({"d": {"gt": "2026-01-01"}}, {"d": "2026-06-15"}, True),
    ({"content": {"contains": "Engineer"}}, {"content": "an engineer."}, False),
    ({"content": {"icontains": "ENGINEER"}}, {"content": "an engineer."}, True),
    ({"b": True}, {"b": "true"}, True),
    ({"AND": [{"c": "eng"}, {"p": {"gte": 5}}]}, {"c": "eng", "p": "8"}, True),
    ({"AND": [{"c": "eng"}, {"p": {"gte": 5}}]}, {"c": "eng", "p": "2"}, False),
    ({"OR": [{"c": "eng"}, {"c": "design"}]}, {"c": "design"}, True),
    ({"NOT": [{"c": "spam"}]}, {}, True),
    ({"NOT": []}, {}, False),
    ({"OR": []}, {}, False),
    ({}, {}, True),
    ({"k": {}}, {}, True),
]


def test_filters(spark):
    of = lambda payload: lambda k: F.lit(payload.get(k)).cast("string")
    row = spark.range(1).select(*(filters.compile_filter(filters.parse(s), of(p)).alias(f"c{i}") for i, (s, p, _) in enumerate(CASES))).first()
    assert [(CASES[i][:2], row[i]) for i in range(len(CASES))] == [((s, p), want) for s, p, want in CASES]


@pytest.mark.parametrize("spec", [[], {"a": {"like": "x"}}, {"a": None}, {"a": [1]}, {"AND": {}}, {"a": {"in": "x"}}, {"a": {"contains": 1}}])
def test_bad_filters(spec):
    with pytest.raises(Validation):
        filters.parse(spec)


def test_filters_come_back_from_json():
    for spec, _, _ in CASES:
        expr = filters.parse(spec)
        assert filters.parse(filters.to_json(expr)) == expr


def test_number_display():
    assert [filters.display(x) for x in (10.0, 0.5, 1e20, -3.0, True)] == ["10", "0.5", "100000000000000000000", "-3", "true"]


ENTITIES = [
    ("yesterday Marta Vogel repaired the pump.", [("proper", "Marta Vogel")]),
    ("nobody came to the harbour.", []),
    ("Red Harbour lies north. Stone Mill stands south.", [("proper", "Red Harbour"), ("proper", "Stone Mill")]),
    ("we left Red Harbour! Stone Mill burnt", [("proper", "Red Harbour"), ("proper", "Stone Mill")]),
    ("(Anna) Lind, Ove Berg", [("proper", "Anna Lind Ove Berg")]),
    ("one Word, then 3D Tools", []),
    ('the sign read "mind the step" in red.', [("quoted", "mind the step")]),
    ('they wrote "no" on it.', []),
    ("they wrote 'no' on it.", []),
    ("the miller's wheel wasn't the baker's.", []),
    ("a word like 'slow cooking' comes up often.", [("quoted", "slow cooking")]),
    ("'first things' come first.", [("quoted", "first things")]),
    ("it closes with 'the very last'", [("quoted", "the very last")]),
    ("on the card: 'crème brûlée', twice.", [("quoted", "crème brûlée")]),
    ("", []),
]


def test_entities(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ENTITIES)], "i int, t string").select("i", text.entities(F.col("t")).alias("e")).orderBy("i").collect()
    assert [[(e["type"], e["text"]) for e in r["e"]] for r in rows] == [want for _, want in ENTITIES]


def test_scores_and_dates(spark):
    said = {"0.375": 0.375, "I'd give this 0.4, or 0.9 at best": 0.4, "relevance 1 of 1": 1.0, "0, as it is about boats": 0.0, "7.25 stars": 1.0, "minus: -1.5": 0.0, "can't tell": 0.5, "3 of 10, so 0.3": 0.3}
    days = {0: "1970-01-01", 86400: "1970-01-02", 1609459200: "2021-01-01", 946684800: "2000-01-01", 951782400: "2000-02-29"}
    row = spark.range(1).select(*(text.score_in(F.lit(s)) for s in said), *(text.date_of(F.lit(s)) for s in days)).first()
    assert list(row) == [*said.values(), *days.values()]
    row = spark.range(1).select(*(filters.is_live("2026-08-24", F.lit(d).cast("string")) for d in ("2020-01-01", "2030-01-01", "2026-08-24", None))).first()
    assert list(row) == [False, True, True, True]


def test_facts_and_embedding(spark):
    row = spark.range(1).select(
        text.sentence_facts(F.lit("Alice is an engineer. Bob lives in Berlin.")), text.sentence_facts(F.lit("a: one\nlost line\nb: two. three")),
        *(hash_embedding(F.lit(t)) for t in ("Alice is an engineer.", "café ñ", "x" * 700)), hash_embedding(F.lit("")), text.project_id(F.lit("git@host:owner/name.git")), text.state_key(F.lit("u"), F.lit("a")),
    ).first()
    assert row[0] == ["Alice is an engineer.", "Bob lives in Berlin."]
    assert row[1] == ["one two.", "three."]
    assert row[2] == [493347, 664853, 836359, 7862, 179368, 350874, 522380, 693886]
    assert [row[i] for i in (2, 3, 4)] == [embed_text(t) for t in ("Alice is an engineer.", "café ñ", "x" * 700)]
    assert row[5] is None and row[6] == "owner-name" and len(row[7]) == 16
    with pytest.raises(Provider):
        embed_text("")


def test_small_functions(spark):
    row = spark.range(1).select(
        text.facts_of_lines(F.lit(" a \r\n\n b")), text.first_chars(F.lit("é" * 5000)), text.is_date_shaped(F.lit("2024-1-01")), text.is_role(F.lit("user")), text.auth_kind(F.create_map(F.lit("X-Api-Key"), F.lit("k"))),
        text.text_of_parts(F.array(F.struct(F.lit("text").alias("type"), F.lit("a ").alias("text")))), *(text.faulty(F.lit(t), 3) for t in (None, " \u2003", "abc", "abcd", "éé")),
    ).first()
    assert list(row) == [["a", "b"], "é" * 4000, False, True, "api_key", "a", True, True, False, True, True]


def test_embedding_of_texts_longer_than_a_piece():
    """Whole batches as the driver embeds each: nulls, bytes beyond ASCII, ends of pieces and of groups of steps, slices."""
    import pyarrow as pa

    from palimpsest.functions import embed

    texts = [None, "", "a", "café ñ", "y" * 64, "z" * 65, "é \n" * 30_000, "w" * embed.PIECE, "w" * (embed.PIECE + 1), "x" * 4096, "x" * 4097]
    want = [embed_text(t) if t else None for t in texts]
    assert embed._embedded(pa.array(texts)).to_pylist() == want
    assert embed._embedded(pa.array(texts).slice(3, 5)).to_pylist() == want[3:8]
    assert embed._embedded(pa.array([None, ""], pa.string())).to_pylist() == [None, None]
