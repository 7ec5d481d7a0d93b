"""Search for many queries at once: the same steps as one search, with the query as a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.embed import Embedding
from ..functions.text import entities, token_set
from ..operators import keyword, lifecycle
from ..operators.knn import nearest_for_each, window_size
from ..operators.lifecycle import Tables, value_of
from ..operators.ranking import BOOST, ENTITY_NEIGHBOURS, midpoint, normalised


def search_each(tables: Tables, queries: DataFrame, top_k: int, scope: dict[str, str], today: str, spec: dict | None = None, show_expired: bool = False, metric: str = "l1", embedding: Embedding | None = None, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score, payload: for each of ``queries`` (query_id, query) what a search of its own finds, best first.

    ``index`` is the stored ``keyword.token_table`` of all memories, or else words are taken from the
    texts. Nearest neighbours and keywords are scored in blocks of memories; the rest are joins by entity or id, and some windows of candidates per query move.
    """
    lifecycle.need_scope(scope)
    of_column = (embedding or Embedding()).of_column
    memories, window = tables.memories, window_size(top_k)
    of = value_of(memories)
    scoped = memories.where(filters.in_scope(scope, of))
    asked = queries.select("query_id", of_column(F.col("query")).alias("query_vector"))
    near = nearest_for_each(scoped, asked, window, metric).drop("rank")
    wanted = filters.compile_filter(filters.parse(spec), of) if spec is not None else F.lit(True)
    if not show_expired:
        wanted = wanted & filters.is_live(today, of("expiration_date"))
    found = near.join(scoped.where(wanted).select("id", "payload"), "id")

    index = keyword.token_lists(memories) if index is None else index
    sizes = memories.agg(F.count("*").alias("n"), F.avg(F.size(keyword.token_list(F.coalesce("content", F.lit(""))))).alias("average")).first()
    terms = queries.select("query_id", F.explode(token_set(F.col("query"))).alias("term"))
    hits = keyword.search_each(index, terms, sizes["n"], sizes["average"] or 1.0, window, scoped)
    by_query = Window.partitionBy("query_id").orderBy("keyword_score", "id")
    hits = hits.withColumn("_place", F.row_number().over(by_query)).where(F.col("_place") <= window).select("query_id", "id", F.col("keyword_score").cast("float").alias("kw"))
    extremes = hits.groupBy("query_id").agg(F.min("kw").alias("_low"), F.max("kw").alias("_high"))
    every = Window.partitionBy("query_id")  # at most a window of rows
    semantic = normalised(F.col("score"), F.min("score").over(every), F.max("score").over(every))
    lexical = F.when(F.col("kw").isNull(), F.lit(1.0)).otherwise(normalised(F.col("kw"), F.col("_low"), F.col("_high")))
    found = found.join(hits, ["query_id", "id"], "left").join(extremes, "query_id", "left")
    found = found.withColumn("score", F.when(F.col("_low").isNotNull(), midpoint(semantic, lexical)).otherwise(F.col("score")))

    named = queries.select("query_id", F.explode(entities(F.col("query"))).alias("e")).select("query_id", F.col("e.type").alias("entity_type"), F.col("e.text").alias("asked")).distinct()
    links = tables.links.where(filters.in_scope({k: v for k, v in scope.items() if k in tables.links.columns}, F.col))
    known = links.select("entity_type", "entity_text").distinct().withColumn("v", of_column(F.col("entity_text")))
    near_by_type = []
    for kind in ("proper", "quoted"):  # the names asked for meet the known ones in bounded broadcasts, the five best of each part move
        asked_for = named.where(F.col("entity_type") == kind).select(F.struct("query_id", "asked").alias("query_id"), of_column(F.col("asked")).alias("query_vector"))
        best = nearest_for_each(known.where(F.col("entity_type") == kind), asked_for, ENTITY_NEIGHBOURS, "l1", "v", "entity_text")
        near_by_type.append(best.select("query_id.query_id", F.lit(kind).alias("entity_type"), F.col("id").alias("entity_text")))
    meant = near_by_type[0].unionByName(near_by_type[1]).distinct()
    boosted = links.join(meant, ["entity_type", "entity_text"]).select("query_id", "id", F.lit(True).alias("_boost")).distinct()
    found = found.join(boosted, ["query_id", "id"], "left")
    found = found.withColumn("score", F.when(F.col("_boost"), (F.col("score") * F.lit(1 - BOOST).cast("float")).cast("float")).otherwise(F.col("score")))

    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= top_k)
    return best.select("query_id", "rank", "id", "score", "payload")
