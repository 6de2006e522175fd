"""Stateful streams with timers, late rows kept aside, and joins of two streams.

The first two need the state store that Spark calls RocksDB; `with_state_store` sets it.
State is bounded by time: what has fired, what no row can join any more and keys that
have been idle for long are let go.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.shared import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class DelayedEffects(StatefulProcessor):
    """Of each key the effects that wait, as a list of chunks of CHUNK at most, each in the order
    in which they are due, and a timer for the first one of a batch. A timer that
    fires gives all that is due by the watermark, keeps the rest and sets a timer for its
    first one, so that state is read and written per key and batch, not per effect."""

    CHUNK = 4096

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_ids array<long>, dues_ms array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            both = sorted(zip(frame["due_ms"].tolist(), frame["event_id"].tolist(), strict=True))
            dues, ids = [x[0] for x in both], [x[1] for x in both]
            # Due by the watermark: the timer's time is over, so these take effect now.
            k = bisect_right(dues, now)
            if k:
                yield self._made(key, ids[:k], dues[:k])
            if k < len(dues):
                self.waiting.appendList([(ids[i : i + self.CHUNK], dues[i : i + self.CHUNK]) for i in range(k, len(ids), self.CHUNK)])
                self.handle.registerTimer(dues[k])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ids, dues, left, fired = [], [], [], False
        for some_ids, some_dues in self.waiting.get():
            k = bisect_right(some_dues, now)
            ids += some_ids[:k]
            dues += some_dues[:k]
            fired = fired or k > 0
            if k < len(some_dues):
                left.append((list(some_ids[k:]), list(some_dues[k:])))
            if len(ids) >= self.CHUNK:
                yield self._made(key, ids, dues)
                ids, dues = [], []
        if ids:
            yield self._made(key, ids, dues)
        if fired and left:
            self.waiting.put(left)
        elif fired:
            self.waiting.clear()
        if left:
            # Later than the watermark, and so than the timer that fires and is deleted afterwards.
            self.handle.registerTimer(min(x[0] for _, x in left))

    def _made(self, key: tuple, ids: Sequence[int], dues: Sequence[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(ids), "event_id": ids, "due_ms": dues})

    def close(self) -> None:
        pass


def delayed_effects(events: DataFrame, delay_ms: Column, late: str, key: str = "user_id") -> DataFrame:
    """(key, event_id, due_ms): an effect per event of a stream, once event time has come
    to the event's own plus its delay: when the watermark, which trails the latest event by
    `late`, has passed it. Rows later than that are left out. Append mode; ts is a timestamp.

    Defined cases: rows without a key, id, time or delay have no effect. Events that
    repeat have an effect each. A key has no state once its effects have fired.
    """
    with_state_store(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    due = (F.unix_millis("ts") + delay_ms).cast("long").alias("due_ms")
    rows = events.withWatermark("ts", late).select(key, "event_id", "ts", due).where(f"{key} IS NOT NULL AND event_id IS NOT NULL AND due_ms IS NOT NULL")
    return rows.groupBy(key).transformWithStateInPandas(DelayedEffects(key), f"{key} {kind}, event_id long, due_ms long", "append", "eventTime")


class LateRows(StatefulProcessor):
    """Of each key the greatest time seen before this batch, and how many rows were late."""

    def __init__(self, key: str, late_ms: int, idle_ms: int | None):
        self.key, self.late_ms, self.idle_ms = key, late_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "latest_ms long, n_late long", *((self.idle_ms,) if self.idle_ms else ()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.seen.get() if self.seen.exists() else None
        latest, n_late = (known[0], known[1]) if known else (None, 0)
        bound = latest - self.late_ms if latest is not None else None
        for frame in rows:
            is_late = frame["ts_ms"] < bound if bound is not None else pd.Series(False, index=frame.index)
            n = int(is_late.sum())
            frame = frame.assign(is_late=is_late, late_so_far=is_late.cumsum() + n_late)
            n_late += n
            most = int(frame["ts_ms"].max())
            latest = most if latest is None else max(latest, most)
            yield frame
        if latest is not None:
            self.seen.update((latest, n_late))

    def close(self) -> None:
        pass


def marked_late(events: DataFrame, late_ms: int, key: str = "user_id", idle_ms: int | None = None) -> DataFrame:
    """All rows of a stream, with is_late (its time is more than late_ms before the key's
    latest one of earlier batches) and late_so_far (the key's late rows up to this one). None
    is dropped: a sink for rows on time and one for late ones take them by is_late. With
    idle_ms a key that has no rows for so long, by the clock, is forgotten; Spark then
    watches the clock, so that such a stream doesn't end by itself when all is read.

    Defined cases: rows without a time are left out before, as they are neither; a null
    key is a key. Append mode; rows have ts as a timestamp.
    """
    with_state_store(events.sparkSession)
    rows = events.where("ts IS NOT NULL").withColumn("ts_ms", F.unix_millis("ts"))
    schema = StructType([*rows.schema.fields, StructField("is_late", BooleanType()), StructField("late_so_far", LongType())])
    out = rows.groupBy(key).transformWithStateInPandas(LateRows(key, late_ms, idle_ms), schema, "append", "processingTime" if idle_ms else "none")
    return out.drop("ts_ms")


def interval_join(left: DataFrame, right: DataFrame, key: str, after: str, late: str) -> DataFrame:
    """Rows of left (key, ts, ...) with the rows of right (key, ts, ...) of the same key that
    come at the same time or up to `after` later: left's columns, then right's with the
    prefix r_. Both sides have a watermark that trails by `late`; with the condition on
    times, Spark lets each row go once no row of the other side can meet it any more."""
    right_columns = {c: f"r_{c}" for c in right.columns}
    l, r = left.withWatermark("ts", late), right.withColumnsRenamed(right_columns).withWatermark("r_ts", late)  # noqa: E741
    met = (F.col(key) == F.col(f"r_{key}")) & (F.col("r_ts") >= F.col("ts")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {after}"))
    return l.join(r, met)
