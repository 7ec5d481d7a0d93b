"""The record model: an id, an embedding, and string metadata with the hot keys beside it as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE_KEYS = ("user_id", "agent_id", "run_id")
#: Keys that stand beside the payload, so that filters on them reach the Parquet scan.
PROMOTED = (*SCOPE_KEYS, "expiration_date", "content")

RECORDS = "id string, vector array<float>, payload map<string,string>"
MEMORIES = f"{RECORDS}, " + ", ".join(f"{k} string" for k in PROMOTED)
HISTORY = "id string, seq bigint, event string, content string"
#: One row for each memory that an entity occurs in; lists of ids are made on export only.
ENTITY_LINKS = "user_id string, agent_id string, run_id string, entity_type string, entity_text string, id string, seq bigint"


def promote(records: DataFrame) -> DataFrame:
    """``records`` (id, vector, payload) with the promoted columns, which follow the payload."""
    return records.select("id", "vector", "payload", *(F.col("payload")[k].alias(k) for k in PROMOTED))


def key(name: str, columns: list[str]) -> Column:
    """A payload value: the promoted column where there is one, else the map entry; null when absent."""
    return F.col(name) if name in PROMOTED and name in columns else F.col("payload")[name]
