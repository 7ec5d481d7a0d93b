"""What happens to candidates after the store: fusion with keywords, entity boost, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..session import shared_path

#: Fixed values.
BOOST = 0.15
ENTITY_NEIGHBOURS = 5


def _extremes(c: str) -> tuple[Column, Column]:
    everything = Window.partitionBy(F.lit(0))
    return F.min(c).over(everything), F.max(c).over(everything)


def normalised(x: Column, low: Column, high: Column) -> Column:
    """0 for the best and 1 for the worst; 0 where all are equal."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)).cast("float")


def midpoint(a: Column, b: Column) -> Column:
    return ((a.cast("double") + b.cast("double")) / 2).cast("float")


def details(candidates: DataFrame, explain: bool) -> DataFrame:
    """``score_details`` at the start: raw and final are the semantic score; null without ``explain``."""
    none = F.lit(None).cast("float")
    parts = F.struct(F.col("score").alias("semantic_score"), none.alias("bm25_score"), none.alias("entity_boost"), F.col("score").alias("raw_score"), F.col("score").alias("final_score"))
    return candidates.withColumn("score_details", F.when(F.lit(explain), parts))


def _noted(**fields: Column) -> Column:
    d = F.col("score_details")
    for name, value in fields.items():
        d = d.withField(name, value.cast("float"))
    return F.when(F.col("score_details").isNotNull(), d)


def fuse(candidates: DataFrame, keywords: DataFrame, id_: str = "id") -> DataFrame:
    """Candidates with the midpoint of both normalised scores; without a keyword hit the keyword part is 1.

    ``keywords`` (id, keyword_score) is normalised over all its rows, those that are no candidates included. If
    it is empty, scores stay raw. Candidates are at most a window, so their extremes take one small task.
    """
    kw = keywords.agg(F.min("keyword_score").cast("float").alias("_kmin"), F.max("keyword_score").cast("float").alias("_kmax"), F.count("*").alias("_hits"))
    joined = candidates.join(keywords.select(F.col(id_).alias("_id"), F.col("keyword_score").cast("float").alias("_kw")), candidates[id_] == F.col("_id"), "left").crossJoin(F.broadcast(kw))  # one row
    sem = normalised(F.col("score"), *_extremes("score"))
    key = F.coalesce(normalised(F.col("_kw"), F.col("_kmin"), F.col("_kmax")), F.lit(1.0).cast("float"))
    key = F.when(F.col("_kw").isNull(), F.lit(1.0)).otherwise(key)
    fused = F.when(F.col("_hits") > 0, midpoint(sem, key)).otherwise(F.col("score"))
    out = joined.withColumn("score", fused)
    if "score_details" in candidates.columns:
        out = out.withColumn("score_details", _noted(bm25_score=F.col("_kw"), raw_score=F.col("score"), final_score=F.col("score")))
    return out.drop("_id", "_kw", "_kmin", "_kmax", "_hits")


def boost(candidates: DataFrame, boosted_ids: DataFrame, id_: str = "id") -> DataFrame:
    """Scores of ``boosted_ids`` (id) times 0.85, once each."""
    flag = boosted_ids.select(F.col(id_).alias("_id")).distinct().withColumn("_boost", F.lit(True))
    joined = candidates.join(flag, candidates[id_] == F.col("_id"), "left")
    hit = F.coalesce(F.col("_boost"), F.lit(False))
    out = joined.withColumn("score", F.when(hit, (F.col("score") * F.lit(1 - BOOST).cast("float")).cast("float")).otherwise(F.col("score")))
    if "score_details" in candidates.columns:
        out = out.withColumn("score_details", F.when(hit, _noted(entity_boost=F.lit(BOOST), final_score=F.col("score"))).otherwise(F.col("score_details")))
    return out.drop("_id", "_boost")


def numbered(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``rows`` with their place from 0 in an order, which no task sees whole: sorted ranges are numbered by themselves, and moved on by the sizes of those before, a row for each range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ranges")
    inside = Window.partitionBy("_range").orderBy(*order)
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).withColumn("_place", F.row_number().over(inside)).write.parquet(path)
    ranges = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as there are ranges
    moved = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ranges.join(F.broadcast(moved), "_range").withColumn(name, F.col("_before") + F.col("_place") - 1).select(*rows.columns, name)


def lexical_distance(query: Column, content: Column) -> Column:
    """1 less the part of the query's tokens that the content has; 1 for a query without tokens."""
    q = token_set(query)
    common = F.size(F.array_intersect(q, token_set(content)))
    return F.when(F.size(q) > 0, (1 - common / F.size(q))).otherwise(F.lit(1.0)).cast("float")


Reranker = Callable[[DataFrame, str], DataFrame]


def overlap_reranker(results: DataFrame, query: str) -> DataFrame:
    """The midpoint of the normalised score and the lexical distance; details stay as they are."""
    base = normalised(F.col("score"), *_extremes("score"))
    return results.withColumn("score", midpoint(base, lexical_distance(F.lit(query), F.coalesce(F.col("content"), F.lit("")))))


def scoring_reranker(score_of: Callable[[Column, Column], Column]) -> Reranker:
    """A reranker by any provider's relevance in 0..1, a Column of query and content; null counts as 0.5."""
    return lambda results, query: results.withColumn("score", (1 - F.coalesce(score_of(F.lit(query), F.col("content")), F.lit(0.5))).cast("float"))


def sigmoid(x: Column) -> Column:
    return (1 / (1 + F.exp(-x))).cast("float")
