"""Operators over click logs: what a session's events, in order, leave behind.

Each but the step machine is an aggregation with partial sums before its one shuffle.
Order is (ts, event_id); both are needed, as times can tie. Arguments name columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hinted
from .windows import ROW, in_pieces

ORDER = ("ts", "event_id")
DONE = 4  # the state of the step machine that shows the result
LAST_STEP = 3


def _order() -> Column:
    return F.struct(*ORDER)


def multi_select(clicks: DataFrame, key: str = "user_id", option: str = "event_type") -> DataFrame:
    """(key, selected): an option is selected if it was clicked an odd number of
    times, and options stand in the order of their last clicks. That equals
    toggling click by click, without an ordered pass."""
    per_option = clicks.groupBy(key, option).agg(F.count(F.lit(1)).alias("n"), F.max(_order()).alias("last"))
    chosen = F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 1, F.struct("last", F.col(option).alias("option")))))
    return per_option.groupBy(key).agg(F.transform(chosen, lambda x: x["option"]).alias("selected"))


def single_select(clicks: DataFrame, key: str = "user_id", option: str = "event_type") -> DataFrame:
    """(key, selected): the last option clicked."""
    return clicks.groupBy(key).agg(F.max_by(option, _order()).alias("selected"))


def next_step(state: Column, action: Column) -> Column:
    """The step after an action: next stops at the result, back at the first step,
    and the result answers to reset only."""
    return (
        F.when(action == "reset", 0)
        .when(state == DONE, DONE)
        .when(action == "next", state + 1)
        .when((action == "back") & (state > 0), state - 1)
        .otherwise(state)
    )


#: Rows of a key, next to one another in order, that are folded together: 2 ** FAN_BITS at most.
FAN_BITS = 13


def step_machine(actions: DataFrame, key: str = "user_id", action: str = "action", parts: int | None = None) -> DataFrame:
    """(key, state) after all actions. Rows are sorted by key and order in ranges and cut
    into runs of a bounded number of rows. Each run is folded on its own into the state
    that it leads to from every state; runs are put together in the same way, level by
    level, so that a key's log is never one group, however busy it is."""
    rows = in_pieces(actions.select(key, *ORDER, F.col(action).alias("action")), [key], [F.asc_nulls_first(c) for c in ORDER], parts)
    every = F.array(*[F.lit(s) for s in range(DONE + 1)])
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct(ROW, "action"))), every, lambda states, x: F.transform(states, lambda s: next_step(s, x["action"])))
    place = F.shiftright(ROW, FAN_BITS)
    runs = rows.groupBy(key, place.alias("place")).agg(folded.alias("leads_to"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("place", "leads_to"))), every, lambda states, x: F.transform(states, lambda s: F.element_at(x["leads_to"], s + 1)))
    # A range has 2 ** 33 places; what is left of a key after this level is a run or few a range.
    spans = runs.groupBy(key, F.shiftright("place", FAN_BITS).alias("place")).agg(joined.alias("leads_to"))
    return spans.groupBy(key).agg(joined.alias("leads_to")).select(key, F.element_at("leads_to", 1).alias("state"))


def latch(events: DataFrame, reached: Column, key: str = "user_id") -> DataFrame:
    """(key, first_event): the first event, in order, at which reached holds."""
    return events.where(reached).groupBy(key).agg(F.min(_order()).alias("first")).select(key, F.col("first.event_id").alias("first_event"))


def threshold_state(events: DataFrame, above: Column, key: str = "user_id") -> DataFrame:
    """(key, above): whether the condition held at the last event."""
    return events.groupBy(key).agg(F.max_by(above, _order()).alias("above"))


def flip(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, open): each event flips a switch that starts off."""
    return events.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("open"))


#: Rows of a dimension that is broadcast.
BROADCAST_ROWS = 10_000


def look_up(rows: DataFrame, table: DataFrame, on: str, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of a dimension: broadcast if it is counted to have at most
    most_rows rows, else joined by a shuffle."""
    return rows.join(hinted(table, most_rows), on)


def indexed_union(first: DataFrame, second: DataFrame, n_first: int, index: str = "i") -> DataFrame:
    """Two indexed lists as one, the second's indexes after the first's."""
    return first.unionByName(second.withColumn(index, F.col(index) + n_first))
