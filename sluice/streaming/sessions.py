"""The interaction operators over unbounded streams.

Event times must be timestamps with a zone; `zoned` casts tables that have none. Where
an operator keeps a row for each key, naming how long a key may be idle bounds its state:
the watermark lets go of keys that have been idle for longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.interaction import DONE


def zoned(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def first_arrivals(events: DataFrame, reached: Column, key: str = "user_id", idle: str | None = None) -> DataFrame:
    """The first event to arrive per key at which reached holds: a latch as a page
    has it. Arrival decides, so out-of-order input can give a later event. With idle
    (an interval) a key is forgotten once the watermark is that far past its first
    event, and may then fire again; without it every key is kept."""
    hits = events.where(reached)
    return hits.withWatermark("ts", idle).dropDuplicatesWithinWatermark([key]) if idle else hits.dropDuplicates([key])


def earliest(events: DataFrame, reached: Column, key: str = "user_id") -> DataFrame:
    """(key, first_event) with the least time, whatever the order of arrival; for
    update or complete mode, as a late event can replace an answer."""
    return events.where(reached).groupBy(key).agg(F.min(F.struct("ts", "event_id")).alias("first")).select(key, F.col("first.event_id").alias("first_event"))


def selections(events: DataFrame, key: str = "user_id", option: str = "event_type") -> DataFrame:
    """(key, option, selected, last) with the parity of clicks so far; update mode."""
    return events.groupBy(key, option).agg((F.count(F.lit(1)) % 2 == 1).alias("selected"), F.max(F.struct("ts", "event_id")).alias("last"))


def latest_state(events: DataFrame, above: Column, key: str = "user_id") -> DataFrame:
    """(key, above) at the latest event so far; update or complete mode."""
    return events.groupBy(key).agg(F.max_by(above, F.struct("ts", "event_id")).alias("above"))


def windowed_counts(events: DataFrame, size: str, late: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts per window and kind; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Events per key and session; a session ends after `gap` without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


#: Where each action leads from every state: next, back, reset, and any other.
ACTIONS = ("next", "back", "reset")
LEADS_TO = np.array([[*range(1, DONE + 1), DONE], [0, *range(DONE - 1), DONE], [0] * (DONE + 1), [*range(DONE + 1)]])


def put_together(maps: np.ndarray) -> np.ndarray:
    """The map from every state that rows of such maps, one after another, are."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        first, second = maps[0 : len(maps) - len(odd) : 2], maps[1::2]
        maps = np.concatenate([np.take_along_axis(second[: len(first)], first, axis=1), odd])
    return maps[0]


def step_machine(actions: DataFrame, key: str = "user_id", idle: str | None = None) -> DataFrame:
    """(key, state) after each micro-batch in which the key acted; update mode. A
    batch's actions are ordered by time; across batches arrival decides. Rows: key,
    ts, event_id, action. With idle (an interval) actions later than that are left out,
    and a key that has been idle for longer is forgotten and starts anew; without it
    every key is kept."""
    kind = actions.schema[key].dataType.simpleString()
    if idle:
        actions = actions.withWatermark("ts", idle)

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        codes = pd.Categorical(rows["action"], categories=ACTIONS).codes.astype(np.int64)
        now = int(put_together(LEADS_TO[codes])[now])
        state.update((now,))
        if idle:
            # Due when the watermark, which trails by idle, has passed the last action.
            last = int(rows["ts"].max().timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "state": [now]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return actions.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, state int", "state int", "update", timeout)
