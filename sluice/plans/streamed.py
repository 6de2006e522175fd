"""Queries that run a stream over a table until it is read, and return what came out.

Each writes to a table below the folder that spark.checkpoint.dir names, which stays
there for the result to be read; the caller clears that folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import utc
from ..operators.shared import scratch_ready
from ..sources.tables import SCHEMAS
from ..streaming import timers


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream, with times as instants."""
    # As a pattern, the path may be of a single file.
    return spark.readStream.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events[.]parquet").withColumn("ts", utc(F.col("ts")))


def run_through(stream: DataFrame) -> DataFrame:
    """All rows that a stream gives for what its sources hold now."""
    spark = stream.sparkSession
    scratch_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    writer.start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def x05_delayed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's effect comes up to six hours after it, as event time goes on; those
    that the last watermark, a day before the latest event, has reached."""
    return run_through(timers.delayed_effects(_events(spark, sf_dir), (F.col("event_id") % 7) * 3_600_000, "1 day"))


def x07_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's views with the clicks of the same user up to two days later."""
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    views, clicks = (events.where(F.col("event_type") == x).drop("event_type") for x in ("view", "click"))
    met = timers.interval_join(views, clicks, "user_id", "2 DAYS", "1 hour")
    return run_through(met.select("user_id", F.col("event_id").alias("view_id"), F.col("r_event_id").alias("click_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"x05_delayed_effects": x05_delayed_effects, "x07_stream_join": x07_stream_join}

ORACLE_SQL: dict[str, str] = {
    "x05_delayed_effects": """
        WITH due AS (SELECT user_id, event_id, epoch_us(ts) // 1000 + (event_id % 7) * 3600000 AS due_ms FROM events)
        SELECT * FROM due WHERE due_ms <= (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM events)""",
    "x07_stream_join": """
        SELECT v.user_id, v.event_id AS view_id, c.event_id AS click_id
        FROM events v JOIN events c ON c.user_id = v.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 2 DAYS
        WHERE v.event_type = 'view' AND c.event_type = 'click'""",
}
