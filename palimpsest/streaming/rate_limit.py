"""Token buckets: a key may make ``capacity`` requests at once and ``refill`` more each second; refused ones take nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A burst and its refill a second.
CAPACITY, REFILL = 20.0, 5.0


def _take(level: float, last: int | None, at: int, capacity: float, refill: float) -> tuple[bool, float]:
    """Whether a request at a microsecond is let through, and the tokens left. A key's first finds its bucket full; a clock that goes back refills nothing."""
    if last is not None:
        level = min(capacity, level + max(0, at - last) / 1e6 * refill)
    return (True, level - 1.0) if level >= 1.0 else (False, level)


def limited(requests: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """``requests`` with ``allowed`` and the ``tokens`` left to their key after each, taken by time and then ``order``.

    A bucket is full again after capacity / refill seconds without a request, whatever was before. So a key's requests fall into
    runs that don't know of each other, and a busy key spreads over tasks: slots of that length are counted where the
    rows lie, and a slot that is empty ends a run. Within a run each request hangs on the one before, which is a stream over
    sorted rows that holds one number. Null keys are one key; rows without a time are refused and take nothing.
    """
    slot_us = max(1, int(capacity / refill * 1e6) + 1)
    timed = requests.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_slot", F.floor(F.col("_us") / slot_us))
    slots = timed.where("_us IS NOT NULL").groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_of")).agg(F.lit(1).alias("_one")).drop("_one")
    by_key = Window.partitionBy("_key").orderBy("_of")
    starts = slots.withColumn("_start", F.when(F.coalesce(F.col("_of") - F.lag("_of").over(by_key) > 1, F.lit(True)), F.col("_of")))
    runs = starts.withColumn("_run", F.max("_start").over(by_key)).select("_key", "_of", "_run")
    dealt = timed.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_of")), "left").drop("_key", "_of", "_slot")
    whole = dealt.repartition(F.col(key), F.col("_run")).sortWithinPartitions(key, "_run", "_us", order)

    def pour(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, level, last = None, capacity, None
        for batch in batches:
            allowed, left = [], []
            keys = batch[key].astype(object).where(batch[key].notna(), None)
            for k, run, us in zip(keys.tolist(), batch["_run"].tolist(), batch["_us"].tolist(), strict=True):
                if us is None or us != us:
                    allowed.append(False)
                    left.append(None)
                    continue
                if (k, run) != now:
                    now, level, last = (k, run), capacity, None
                ok, level = _take(level, last, int(us), capacity, refill)
                last = int(us)
                allowed.append(ok)
                left.append(level)
            yield batch.drop(columns=["_us", "_run"]).assign(allowed=allowed, tokens=pd.Series(left, dtype="float64", index=batch.index))

    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", allowed boolean, tokens double"
    return whole.mapInPandas(pour, schema)


class _Bucket(StatefulProcessor):
    """The tokens of a key and when it asked last, in microseconds."""

    def __init__(self, key: str, at: str, order: str, capacity: float, refill: float):
        self.names, self.capacity, self.refill = (key, at, order), capacity, refill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, at, order = self.names
        every = pd.concat(list(rows)).sort_values([at, order])  # of one key and micro-batch
        level, last = self.state.get() if self.state.exists() else (self.capacity, None)
        allowed, left = [], []
        for us in (every[at].astype("datetime64[us]").astype("int64")).tolist():
            ok, level = _take(level, last, us, self.capacity, self.refill)
            last = us if last is None else max(last, us)
            allowed.append(ok)
            left.append(level)
        self.state.update((level, last))
        yield pd.DataFrame({name: every[name], order: every[order], "allowed": allowed, "tokens": left})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """key, order, allowed, tokens of a stream of requests, by buckets that are kept as state and refilled when they are asked. It needs the RocksDB state store."""
    kinds = dict(requests.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean, tokens double"
    return requests.where(F.col(at).isNotNull()).groupBy(key).transformWithStateInPandas(_Bucket(key, at, order, capacity, refill), outputStructType=schema, outputMode="append", timeMode="none")
