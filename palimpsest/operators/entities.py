"""Entities that memories mention, kept as one row for each mention's entity and memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedding, embed_text, hash_embedding
from ..functions.text import entities
from ..functions.vector import l1
from ..schema import SCOPE_KEYS
from .ranking import ENTITY_NEIGHBOURS


def links(memories: DataFrame, content: str = "content", seq: str = "seq") -> DataFrame:
    """Scope, entity_type, entity_text, id and seq of each different entity of each memory."""
    scope = [k for k in SCOPE_KEYS if k in memories.columns]
    each = memories.select(*scope, "id", seq, F.explode(entities(F.coalesce(F.col(content), F.lit("")))).alias("e"))
    return each.select(*scope, F.col("e.type").alias("entity_type"), F.col("e.text").alias("entity_text"), "id", F.col(seq).alias("seq")).distinct()


#: Known entities, and which memories they have, in the order of batches and, within one, of seq.
ENTITIES = "entity_id string, user_id string, agent_id string, run_id string, entity_type string, entity_text string, vector array<float>"
MEMBERS = "entity_id string, id string, batch bigint, seq bigint"


def entity_id() -> Column:
    """Fixed by scope, type and text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in (*SCOPE_KEYS, "entity_type", "entity_text")]
    return F.concat(F.lit("ent-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def upsert(known: DataFrame, members: DataFrame, link_rows: DataFrame, batch: int, embedding: Embedding | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that a batch of ``links`` adds to ``known`` (ENTITIES) and ``members`` (MEMBERS): an entity that a scope has gets the memories it hadn't, another one is made with its vector.

    Nothing that is there is rewritten: a memory's place in an entity's list is its batch and seq, so a list grows at its end, and a
    memory that is linked already, or twice within the batch, keeps its first place. An entity of very many memories is many rows.
    """
    absent = [F.lit(None).cast("string").alias(k) for k in SCOPE_KEYS if k not in link_rows.columns]
    named = link_rows.select("*", *absent).withColumn("entity_id", entity_id())
    keys = [*SCOPE_KEYS, "entity_type", "entity_text"]
    new = named.groupBy("entity_id", *keys).agg(F.lit(1).alias("_one")).drop("_one").join(known.select("entity_id"), "entity_id", "left_anti")
    made = new.select("entity_id", *keys, (embedding or Embedding()).of_column(F.col("entity_text")).alias("vector"))
    each = named.groupBy("entity_id", "id").agg(F.min("seq").cast("bigint").alias("seq"))
    added = each.join(members.select("entity_id", "id"), ["entity_id", "id"], "left_anti").select("entity_id", "id", F.lit(batch).cast("bigint").alias("batch"), "seq")
    return made, added


def linked_lists(members: DataFrame, piece: int = 10_000) -> DataFrame:
    """entity_id, piece, ids: the memories of each entity in the order of their first mention, ``piece`` at most in a row; ties go by id."""
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("batch", "seq", "id")) - 1
    ranked = members.withColumn("place", place).withColumn("piece", F.floor(F.col("place") / piece).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "id")))
    return ranked.groupBy("entity_id", "piece").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))


def summary(link_rows: DataFrame) -> DataFrame:
    """One row for each entity of each scope: how many memories have it, and the first."""
    scope = [k for k in SCOPE_KEYS if k in link_rows.columns]
    return link_rows.groupBy(*scope, "entity_type", "entity_text").agg(F.count("*").alias("n_memories"), F.min_by("id", "seq").alias("first_id"))


def boosted_ids(link_rows: DataFrame, query_entities: Sequence[tuple[str, str]]) -> DataFrame:
    """id of memories linked to the nearest entities: for each (type, text) of the query, the five of that type whose embedding is nearest, however far."""
    spark = link_rows.sparkSession
    asked = spark.createDataFrame([(i, t, x, embed_text(x)) for i, (t, x) in enumerate(query_entities)], "q int, q_type string, q_text string, q_vector array<float>")
    known = link_rows.select("entity_type", "entity_text").distinct().withColumn("v", hash_embedding(F.col("entity_text")))
    pairs = known.join(F.broadcast(asked), F.col("entity_type") == F.col("q_type"))  # a query has a few entities
    near = pairs.withColumn("d", l1(F.col("v"), F.col("q_vector"))).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "entity_text"))).where(F.col("rank") <= ENTITY_NEIGHBOURS)
    return link_rows.join(near.select("entity_type", "entity_text").distinct(), ["entity_type", "entity_text"], "left_semi").select("id").distinct()
