"""From raw documents to sampled pieces of a deduplicated, cleaned and mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, whatever these are called.

Of all stages: an empty table gives an empty one; null and empty texts are documents like any other (scored as
texts without words, never linked, without secrets, of size 0, without pieces); rows are told apart by
their id and text, so rows of null or repeated ids are kept or lost each by itself; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import _common as C
from palimpsest.llm import jaccard_join, mixing, quality_classifier, sampled_pieces, secret_scan

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, fitted on the labelled ones among them, scores LEAST_QUALITY or more. Rows that repeat each other score alike."""
    C.shared_dir(spark)
    model = quality_classifier.train(docs, C.table(spark, sf_dir, "labels"))
    own = "_" * (1 + max(map(len, docs.columns)))  # a column score that the documents bring keeps its values
    good = quality_classifier.score(docs.withColumnRenamed("score", own), model).where(f"score >= {LEAST_QUALITY}").drop("score")
    return good.withColumnRenamed(own, "score").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of smallest id, of each group linked by a five-word shingle Jaccard of 0.8 or more; null ids are larger than any, ties go by the hash of the text, and of rows that repeat id and text one stays."""
    return jaccard_join.one_of_each(docs, width=5, threshold=(80, 100))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blots out the secrets that the scan confirms; the documents stay, one for one."""
    C.shared_dir(spark)
    return secret_scan.scan(docs, secret_scan.train(), redact=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source, a null one included, comes to its share of the words; rows of one id are drawn alike, those of null ids by their text."""
    C.shared_dir(spark)
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, lossless, pieces of every document."""
    C.shared_dir(spark)
    return sampled_pieces.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces),
]

#: Trained models and sampled pieces can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows. A stage's table goes once the next one's is written; the last one is read by the result."""
    docs, scratch = C.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        written = C.Scratch(spark)
        docs = written.keep(out, f"stage-{i}")
        if scratch is not None:
            scratch.drop()
        scratch = written
    raise ValueError("no stages")
