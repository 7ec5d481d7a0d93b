"""Each stage of the pipeline on what the one before kept."""

from collections import Counter

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    start, good, single, clean, mixed, pieces = kept
    assert all(k.columns == columns for k in kept[:-1])
    lost = start.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("quality = 1").count() <= 0.05 * labels.where("quality = 1").count() and lost.where("quality = 0").count() >= 0.9 * labels.where("quality = 0").count()

    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in good.collect() if (w := r["text"].encode().lower().split())}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 10 * min(map(len, (sets[i], sets[j]))) >= 8 * max(map(len, (sets[i], sets[j]))) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {r["doc_id"] for r in single.collect()} == {i for i in root if root[i] == i}
    assert clean.count() == single.count()
    words = lambda df: sum(len(r["text"].encode().split()) for r in df.collect())
    assert abs(words(mixed) / (1.5 * words(clean)) - 1) < 0.1
    assert set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2}
    assert pieces.count() == mixed.count() and pieces.where("NOT lossless").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "source", "n_pieces", "lossless", "pieces"]


def odd_rows():
    text = " ".join(f"word{i % 400} and then" for i in range(1500))
    long_text = "\n".join(f"line {i} of a text that goes on " + " ".join(f"t{(i * 7919 + k) % 50021}" for k in range(30)) for i in range(14000))  # above one block of 2 MB
    assert len(long_text) > 2 << 20
    rows = [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text + " end", "b"), (None, None, None), (3, "", "b"), (4, None, "b"), (5, "   \n\t", "a"), (6, long_text, "b"), (7, "one two", "a"), (8, "one two", "a")]
    return [(i, t, "en", s, len(t or ""), "x", i, "y", -1) for i, t, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id long, hash string, size int"


def test_stages_of_odd_rows(spark, sf):
    """Nulls, ties, repeated rows, a text above one block and columns named like the stages' own; each stage on the same rows."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    single = stages["n-gram Jaccard join"](spark, docs, sf)
    assert single.columns == docs.columns
    # Rows 1, 1, 2 and the null id with one word more are one group; 7 and 8 another; texts without words are linked with nothing.
    got = single.collect()
    assert Counter((r["doc_id"], (r["text"] or "")[:5]) for r in got) == Counter([(1, "word0"), (None, ""), (3, ""), (4, ""), (5, "   \n\t"[:5]), (6, "line "), (7, "one t")])
    assert all(r in rows for r in got)

    clean = stages["secret scans"](spark, docs, sf)
    assert clean.columns == docs.columns and Counter(clean.collect()) == Counter(rows)

    mixed = stages["mixing sources to target weights"](spark, docs, sf)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(rows)

    pieces = stages["SentencePiece encoding and decoding"](spark, docs, sf)
    assert Counter((r["doc_id"], r["source"], r["lossless"]) for r in pieces.collect()) == Counter((r["doc_id"], r["source"], True) for r in rows)


def test_stages_of_an_empty_table(spark, sf):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, empty, sf)
        assert out.count() == 0, name
        assert name.startswith("SentencePiece") or out.columns == empty.columns


def test_quality_stage_keeps_odd_columns(spark, sf):
    """Fitted on the labelled documents beside the odd rows; rows that repeat each other are kept or lost together."""
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(r[0] and r[0] + 10**9, *r[1:]) for r in odd_rows()], SCHEMA)
    docs = plain.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' score", "doc_id component_id", "'y' hash", "-1 size").unionByName(odd)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()} and kept.count() > 10
    of = Counter(r["doc_id"] for r in kept.where(f"doc_id = {10**9 + 1}").collect())
    assert set(of.values()) <= {2}
