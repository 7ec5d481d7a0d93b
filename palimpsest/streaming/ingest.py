"""Structured Streaming around the batch operators, and the small stateful reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import Config


def ingest(messages: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str) -> StreamingQuery:
    """Feeds each micro-batch of a stream of messages (conv_id, turn, role, text) to ``apply``, e.g. an engine's add and save."""
    return messages.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(messages: DataFrame, engine, scope: dict[str, str], stream: str, checkpoint: str, infer: bool = True) -> StreamingQuery:
    """Feeds a stream of messages to an engine that has a store, each micro-batch exactly once.

    The store commits a batch's number with its rows, so a batch that Spark replays, because it died after the rows were
    written and before the checkpoint was, finds its number there and adds nothing. ``stream`` names the checkpoint for good.
    """
    if engine.store is None:
        raise Config("exactly-once needs a store that remembers batches")
    return messages.writeStream.foreachBatch(lambda batch, n: engine.add(batch, scope, infer, batch=(stream, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of a stream or table of events (ts, event_type, value)."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    by = watermarked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def last_requests(log: DataFrame, seq: str, n: int = 1000) -> DataFrame:
    """The newest ``n`` rows of a log, oldest first."""
    return log.orderBy(F.desc(seq)).limit(n).orderBy(seq)


def session_gate(events: DataFrame, user: str, session: str, order: str, least: int = 5) -> DataFrame:
    """user, n_sessions, due: how often a user's session differs from the one before, the first included, and whether that reaches ``least``."""
    before = F.lag(session).over(Window.partitionBy(user).orderBy(order))
    changes = events.withColumn("_new", (before.isNull() | (F.col(session) != before)).cast("int"))
    return changes.groupBy(user).agg(F.sum("_new").alias("n_sessions")).withColumn("due", F.col("n_sessions") >= least)


def consolidation_due(gates: DataFrame, memories: DataFrame, last: DataFrame, now: str, user: str, hours: int = 24, least: int = 20) -> DataFrame:
    """user, n_sessions, n_memories, due: whether ``session_gate`` says so, the last consolidation (user, at) is ``hours`` ago or more, if there was one, and there are ``least`` memories."""
    counted = memories.groupBy(user).agg(F.count("*").alias("n_memories"))
    rows = gates.join(counted, user, "left").join(last, user, "left").withColumn("n_memories", F.coalesce("n_memories", F.lit(0)))
    rested = F.col("at").isNull() | (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) >= hours * 3600)
    return rows.select(user, "n_sessions", "n_memories", (F.col("due") & rested & (F.col("n_memories") >= least)).alias("due"))
