"""Timers, late rows and joins of streams against batches over the same events."""

from __future__ import annotations

import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.sources.tables import load
from sluice.streaming import sessions, timers

SF = "/root/testdata/sf0.001"
FILES = 6


def folder_of(spark, tmp_path_factory, name, order):
    events = sessions.zoned(load(spark, SF, "events")).orderBy("ts", "event_id").toPandas()
    folder = tmp_path_factory.mktemp(name)
    size = -(-len(events) // FILES)
    rng = random.Random(3)
    for place, k in enumerate(order):
        part = events.iloc[k * size : (k + 1) * size].sample(frac=1, random_state=rng.randrange(100))
        spark.createDataFrame(part).coalesce(1).write.parquet(str(folder / f"w{place}"))
        made = next((folder / f"w{place}").glob("part-*.parquet"))
        made.rename(folder / f"file{place}.parquet")
        os.utime(folder / f"file{place}.parquet", (1_700_000_000 + place * 60,) * 2)
    return str(folder)


@pytest.fixture(scope="module")
def straight(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory, "straight", range(FILES))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory, "shuffled", [1, 0, 3, 2, 5, 4])


def run(spark, folder, make, tmp_path, name):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "file*.parquet").parquet(folder)
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def delay():
    return (F.col("event_id") % 7) * 3_600_000


def test_effects_fire_when_due_under_shuffled_arrival(spark, shuffled, tmp_path):
    # Neighbouring files are swapped, so a bound of eleven days lets no row be late.
    got, q = run(spark, shuffled, lambda s: timers.delayed_effects(s, delay(), "11 days"), tmp_path, "effects")
    rows = got.collect()
    events = sessions.zoned(load(spark, SF, "events"))
    end = events.agg((F.unix_millis(F.max("ts")) - 11 * 86_400_000).alias("m")).first()["m"]
    want = {(r["user_id"], r["event_id"], r["due"]) for r in events.select("user_id", "event_id", (F.unix_millis("ts") + delay()).alias("due")).collect()}
    fired = [tuple(r) for r in rows]
    assert len(set(fired)) == len(fired) and set(fired) == {x for x in want if x[2] <= end}
    assert 0 < len(fired) < len(want)


def test_state_ends_with_the_last_effect(spark, straight, tmp_path):
    flood = lambda s: s.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(F.col("user_id")).cast("long"))
    got, q = run(spark, straight, lambda s: timers.delayed_effects(flood(s), F.lit(60_000), "1 hour"), tmp_path, "hot_effects")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    total = spark.read.parquet(straight + "/file*.parquet").count()
    fired = got.count()
    assert total - 40 < fired < total
    # What waits at the end is what came within the last hour, its list entries, counts and timers.
    assert kept[-1] <= 4 * (total - fired) + 4 and kept[-1] < max(kept)


def test_effects_due_at_the_watermark_and_in_many_chunks(spark, tmp_path, monkeypatch):
    """One key holds all events but one of a far key, in three files; what is due just at the
    watermark fires, what is due a millisecond later waits."""
    monkeypatch.setattr(timers.DelayedEffects, "CHUNK", 7)
    start, hour = 1_700_000_000_000, 3_600_000
    rows = [(i, start + i * 1000, 1) for i in range(300)] + [(300, start + hour + 100_000, 2)]
    for k in range(3):
        part = spark.createDataFrame(rows[k * 100 : (k + 1) * 100 + (k == 2)], "event_id long, ms long, user_id long")
        part.select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        made = next((tmp_path / f"w{k}").glob("part-*.parquet"))
        made.rename(tmp_path / f"file{k}.parquet")
        os.utime(tmp_path / f"file{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    # The watermark ends at start + 100 s; event i is due at start + i s, odd ones a millisecond later.
    got, _ = run(spark, str(tmp_path), lambda s: timers.delayed_effects(s, F.col("event_id") % 2, "1 hour"), tmp_path, "edge_effects")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(101))
    assert all(r["due_ms"] == start + r["event_id"] * 1000 + r["event_id"] % 2 for r in got.collect())


class Handle:
    """State in memory that counts what passes to and from it."""

    def __init__(self):
        self.values, self.moved, self.timers = [], 0, set()

    def getListState(self, *_):
        return self

    def get(self):
        self.moved += len(self.values)
        return iter(list(self.values))

    def put(self, values):
        self.moved += len(values)
        self.values = list(values)

    def appendValue(self, value):
        self.appendList([value])

    def appendList(self, values):
        self.moved += len(values)
        self.values += values

    def clear(self):
        self.values = []

    def registerTimer(self, at):
        self.moved += 1
        self.timers.add(at)


def test_a_hot_key_moves_its_state_once(spark):
    """A key with 4000 events: as many timers, each reading all that waits, are 8 million values."""
    handle, p = Handle(), timers.DelayedEffects("user_id")
    p.init(handle)
    clock = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    frame = pd.DataFrame({"user_id": 1, "event_id": range(4000), "due_ms": [10_000 + k * 7 % 4000 for k in range(4000)]})
    out = list(p.handleInputRows((1,), iter([frame]), clock(0)))
    for now in (12_000, 13_998, 13_999):
        while due := sorted(t for t in handle.timers if t <= now):
            out += p.handleExpiredTimer((1,), clock(now), SimpleNamespace(getExpiryTimeInMs=lambda: due[0]))
            handle.timers.remove(due[0])
        fired = pd.concat([x for x in out if len(x)])
        assert sorted(fired["event_id"]) == [k for k in range(4000) if 10_000 + k * 7 % 4000 <= now]
    assert handle.moved < 100 and not handle.values and not handle.timers


def test_on_time_and_late_rows_are_all_rows(spark, shuffled, tmp_path):
    got, _ = run(spark, shuffled, lambda s: timers.marked_late(s, 3_600_000), tmp_path, "late")
    rows = got.collect()
    events = {r["event_id"]: r for r in sessions.zoned(load(spark, SF, "events")).collect()}
    assert len(rows) == len(events) and {r["event_id"] for r in rows} == set(events)
    # Files 1, 3 and 5 come before 0, 2 and 4: a row is late if its user had one an hour later in a file before.
    order = sorted(events.values(), key=lambda r: (r["ts"], r["event_id"]))
    size = -(-len(order) // FILES)
    latest, want = {}, set()
    for k in [1, 0, 3, 2, 5, 4]:
        part = order[k * size : (k + 1) * size]
        want |= {r["event_id"] for r in part if r["user_id"] in latest and (latest[r["user_id"]] - r["ts"]).total_seconds() > 3600}
        for r in part:
            latest[r["user_id"]] = max(latest.get(r["user_id"], r["ts"]), r["ts"])
    assert {r["event_id"] for r in rows if r["is_late"]} == want and want
    most = {}
    for r in rows:
        most[r["user_id"]] = max(most.get(r["user_id"], 0), r["late_so_far"])
    assert sum(most.values()) == len(want)


def test_stream_join_equals_the_batch_join(spark, straight, tmp_path):
    def make(s):
        views = s.where("event_type = 'view'").select("user_id", "ts", "event_id")
        clicks = s.where("event_type = 'click'").select("user_id", "ts", "event_id")
        return timers.interval_join(views, clicks, "user_id", "2 DAYS", "1 hour")

    got, q = run(spark, straight, make, tmp_path, "joined")
    pairs = sorted((r["event_id"], r["r_event_id"]) for r in got.collect())
    events = sessions.zoned(load(spark, SF, "events"))
    a, b = events.where("event_type = 'view'").alias("a"), events.where("event_type = 'click'").alias("b")
    want = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("INTERVAL 2 DAYS")))
    assert pairs == sorted((r[0], r[1]) for r in want.select("a.event_id", "b.event_id").collect()) and pairs
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] < events.where("event_type IN ('view', 'click')").count() / 3
