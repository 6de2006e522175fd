"""Sessions of events, and a table function that says how far each one came."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .shared import ship_package
from .windows import lagged, running

FUNNEL = "funnel_steps"


def in_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: Column, order: Sequence[Column], name: str = "session", parts: int | None = None) -> DataFrame:
    """events with the number of their session, from 0 for each key; a new one begins after
    more than gap (in time's unit, a number) without an event. No task holds a key's
    events, however many there are. Times must not be null."""
    before = lagged(events, keys, order, F.col(time), name="__sl_before", parts=parts)
    opens = (F.col(time) - F.col("__sl_before") > gap).cast("long")
    return running(before, keys, order, {name: ("sum", F.coalesce(opens, F.lit(0)))}, parts=parts).drop("__sl_before")


@udtf(returnType="user_id bigint, session bigint, n_events bigint, depth int, reached string")
class FunnelSteps:
    """Reads one session's rows (user_id, session, event_type, in order) and gives its row:
    how many steps of the funnel were taken in order, with anything in between, and the
    last one; null if none was. The steps are the second argument, separated by commas.

    It holds four numbers, however long a session is. Defined cases: rows without a type
    are events and no step; a step that comes twice in the funnel is needed twice.
    """

    def __init__(self) -> None:
        self.key: tuple[int, int] | None = None
        self.steps: list[str] = []
        self.n = self.depth = 0

    def eval(self, row: Row, steps: str) -> None:
        if self.key is None:
            self.key, self.steps = (row["user_id"], row["session"]), steps.split(",")
        self.n += 1
        if self.depth < len(self.steps) and row["event_type"] == self.steps[self.depth]:
            self.depth += 1

    def terminate(self) -> Iterator[tuple[int, int, int, int, str | None]]:
        if self.key is not None:
            yield *self.key, self.n, self.depth, self.steps[self.depth - 1] if self.depth else None


def register_funnel(spark: SparkSession) -> None:
    """Makes the table function known to SQL:
    SELECT * FROM funnel_steps(TABLE(t) PARTITION BY (user_id, session) ORDER BY (ts), 'a,b')."""
    ship_package(spark)
    spark.udtf.register(FUNNEL, FunnelSteps)
