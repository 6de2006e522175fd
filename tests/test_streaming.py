"""Streams against what a batch over the same events gives."""

from __future__ import annotations

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sluice.operators import interaction
from sluice.sources.tables import load
from sluice.streaming import sessions

SF = "/root/testdata/sf0.001"
KINDS = {"click": "next", "view": "back", "error": "reset"}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Six files by time: (in order, with neighbours swapped)."""
    events = sessions.zoned(load(spark, SF, "events")).orderBy("ts", "event_id").toPandas()
    folders = []
    for name, order in (("straight", [0, 1, 2, 3, 4, 5]), ("swapped", [1, 0, 3, 2, 5, 4])):
        folder = tmp_path_factory.mktemp(name)
        size = -(-len(events) // 6)
        for place, k in enumerate(order):
            part = spark.createDataFrame(events.iloc[k * size : (k + 1) * size])
            part.coalesce(1).write.mode("append").parquet(str(folder))
            for f in folder.glob("part-*.parquet"):
                if not f.name.startswith("part-file"):
                    f.rename(folder / f"part-file{place}.parquet")
                    os.utime(folder / f"part-file{place}.parquet", (1_700_000_000 + place * 60,) * 2)
        folders.append(str(folder))
    return folders


def run(spark, folder, make, mode, tmp_path, name):
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_latch(spark, feed, tmp_path):
    reached = F.col("value") >= 15
    want = {r[0]: r[1] for r in interaction.latch(load(spark, SF, "events"), reached).collect()}
    for k, folder in enumerate(feed):
        got = run(spark, folder, lambda s: sessions.earliest(s, reached), "complete", tmp_path, f"earliest{k}")
        assert {r[0]: r[1] for r in got.collect()} == want
    arrived = run(spark, feed[0], lambda s: sessions.first_arrivals(s, reached), "append", tmp_path, "arrivals")
    assert {r["user_id"]: r["event_id"] for r in arrived.collect()} == want


def test_step_machine(spark, feed, tmp_path):
    kind = F.col("event_type")
    action = F.when(kind == "click", "next").when(kind == "view", "back").when(kind == "error", "reset").otherwise("none")
    want = {r[0]: r[1] for r in interaction.step_machine(load(spark, SF, "events").withColumn("action", action)).collect()}
    got = run(spark, feed[0], lambda s: sessions.step_machine(s.select("user_id", "ts", "event_id", action.alias("action"))), "update", tmp_path, "steps")
    last = {}
    for r in got.collect():
        last[r["user_id"]] = r["state"]
    assert last == want


def test_maps_are_put_together():
    state = list(range(5))
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 100):
        codes = [rng.randrange(4) for _ in range(n)]
        for start in range(5):
            now = start
            for c in codes:
                now = int(sessions.LEADS_TO[c][now])
            state[start] = now
        assert sessions.put_together(sessions.LEADS_TO[codes]).tolist() == state


def test_steps_by_rule(spark):
    rows = [(s, a) for s in range(5) for a in ("next", "back", "reset", "none")]
    df = spark.createDataFrame(rows, "s int, a string")
    for s, a, to in df.select("s", "a", interaction.next_step(F.col("s"), F.col("a"))).collect():
        assert sessions.LEADS_TO[sessions.ACTIONS.index(a) if a in sessions.ACTIONS else -1][s] == to


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Five files: each a day later with a user of its own; then one late event."""
    folder = tmp_path / "days"
    files = [[(k, 10 + k, "next"), (k, 10 + k, "next")] for k in range(5)] + [[(0, 10, "next")]]
    for place, rows in enumerate(files):
        data = [(u, d * 100 + j, a, datetime(2024, 1, d, j, tzinfo=timezone.utc)) for j, (u, d, a) in enumerate(rows)]
        spark.createDataFrame(data, "user_id long, event_id long, action string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*.parquet"):
            if not f.name.startswith("part-file"):
                f.rename(folder / f"part-file{place}.parquet")
                os.utime(folder / f"part-file{place}.parquet", (1_700_000_000 + place * 60,) * 2)
    for name, make, mode in (("steps_idle", lambda s: sessions.step_machine(s, idle="2 hours"), "update"), ("latch_idle", lambda s: sessions.first_arrivals(s, F.col("action") == "next", idle="2 hours"), "append")):
        stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert max(kept) <= 3 and kept[-1] <= 1
        got = spark.table(name).collect()
        assert sorted(r["user_id"] for r in got) == [0, 1, 2, 3, 4]  # the late event changes nothing
        if mode == "update":
            assert {r["state"] for r in got} == {2}


def test_windows(spark, feed, tmp_path):
    batch = sessions.zoned(load(spark, SF, "events"))
    want = {(r[0], r[1]): r[2] for r in batch.groupBy(F.window("ts", "1 day").start.cast("string"), "event_type").count().collect()}
    got = run(spark, feed[0], lambda s: sessions.windowed_counts(s, "1 day", "1 hour"), "append", tmp_path, "daily")
    rows = {(str(r["window"]["start"]), r["event_type"]): r["n"] for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items())
    assert {k[0] for k in want} - {k[0] for k in rows} <= {max(k[0] for k in want)}
    ended = run(spark, feed[0], lambda s: sessions.session_counts(s, "1 hour", "1 hour"), "append", tmp_path, "visits")
    assert ended.count() > 0


def test_states(spark, feed, tmp_path):
    want = {r[0]: r[1] for r in interaction.threshold_state(load(spark, SF, "events"), F.col("value") > 15).collect()}
    got = run(spark, feed[1], lambda s: sessions.latest_state(s, F.col("value") > 15), "complete", tmp_path, "above")
    assert {r[0]: r[1] for r in got.collect()} == want
    picks = run(spark, feed[0], lambda s: sessions.selections(s), "complete", tmp_path, "picks")
    on = {(r["user_id"], r["event_type"]) for r in picks.where("selected").collect()}
    batch = interaction.multi_select(load(spark, SF, "events")).collect()
    assert on == {(r["user_id"], o) for r in batch for o in r["selected"]}
