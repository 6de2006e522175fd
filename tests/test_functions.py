"""Expressions against tables of cases and restatements in Python."""

from __future__ import annotations

import random
from datetime import datetime, timezone
from fractions import Fraction
from itertools import combinations

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import answers, numbers, records
from sluice.operators import interaction
from sluice.sources import forms, relations

USES = relations.QUESTIONS[0][3]


def test_classifier_on_every_input(spark):
    rows = [(list(c), s) for n in range(len(USES) + 1) for c in combinations(USES, n) for s in ("Yes", "No", "Not sure", "")]
    got = spark.createDataFrame(rows, "uses array<string>, scope string").select("uses", "scope", answers.classify("uses", "scope").alias("r")).collect()
    counts = {}
    for uses, scope, r in got:
        high = any(u in USES[:4] for u in uses)
        want = {"Not sure": "unsure", "Yes": "high" if high else "low", "No": "low", "": "unsure" if high else "low"}[scope]
        assert r == want
        counts[r] = counts.get(r, 0) + 1
    assert counts == {"high": 60, "low": 72, "unsure": 124}


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([(["prod", None],), ([],), (None,), (["cv"],)], "a array<string>")
    assert [tuple(r) for r in df.select(answers.any_of("a", ["cv"]), answers.has("a", F.lit("cv"))).collect()] == [(False, False)] * 3 + [(True, True)]


@pytest.mark.parametrize(("text", "number", "suffix"), [("5+", 5, "+"), ("4", 4, ""), ("UCD", None, None), ("5\n", None, None), ("5++", None, None), ("", None, None), ("99999999999999999999", None, "")])
def test_counter(spark, text, number, suffix):
    t = F.lit(text)
    assert tuple(spark.range(1).select(numbers.counter_number(t), numbers.counter_suffix(t)).first()) == (number, suffix)


def test_ease_out(spark):
    df = spark.createDataFrame([(float(t),) for t in (0, 100, 300, 600, 900, 1200, 2000)], "t double")
    assert [r[0] for r in df.select(numbers.eased(F.col("t"), F.lit(5.0))).collect()] == [0, 1, 3, 4, 5, 5, 5]


def test_ease_out_at_a_half_rounds_as_sql_does(spark):
    # 200 of 1200 ms leave 5 / 6; a cube that is one unit too small lifts 30439.49... to 30439.5.
    rows = [(k * 40.0, p) for k in range(1, 51) for p in (72_252.0, 108.0, 13_500.0, 27_000.0)]
    got = spark.createDataFrame(rows, "t double, p double").select(numbers.eased(F.col("t"), F.col("p"))).collect()
    with duckdb.connect() as c:
        want = [c.execute("SELECT floor((1 - pow(1 - least(?::DOUBLE / 1200.0, 1.0), 3)) * ?::DOUBLE + 0.5)::BIGINT", r).fetchone() for r in rows]
    assert [tuple(r) for r in got] == want and (30_439,) in want


def test_cubes_are_the_nearest_doubles(spark):
    rng = random.Random(5)
    xs = [0.0, 1.0, 5 / 6, -0.25, 3e49, -1e40, 1e-60, *(rng.random() for _ in range(3000)), *(rng.uniform(-1e6, 1e6) for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(numbers.cubed(F.col("x"))).collect()
    assert [r[0] for r in got] == [float(Fraction(x) ** 3) for x in xs]
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -1e200, None)], "x double").select(numbers.cubed(F.col("x"))).collect()
    assert repr([r[0] for r in odd]) == "[nan, inf, -inf, None]"


@pytest.mark.parametrize("zone", ["UTC", "Europe/Dublin", "America/New_York"])
def test_days_until_depends_on_instants_only(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cases = {"2026-08-01T00:00:00Z": 1, "2026-08-01T12:00:00Z": 1, "2026-08-02T00:00:00Z": 0, "2026-08-02T12:00:00Z": 0, "2026-11-26T22:25:00Z": -116, "2026-08-01T23:59:59.999Z": 1}
        for text, want in cases.items():
            assert spark.range(1).select(numbers.days_until(F.to_timestamp(F.lit(text)))).first()[0] == want
        ntz = spark.createDataFrame([(datetime(2026, 8, 1, 12),)], "t timestamp_ntz")
        assert ntz.select(numbers.days_until(numbers.utc(F.col("t")))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_query_flag(spark):
    urls = {"https://a.example/c?success=true&success=false": True, "https://a.example/c?success=%74rue": True, "https://a.example/c?success=": False, "https://a.example/c?success=True": False, "https://a.example/c": False, "https://a.example/a b?success=true": False, None: False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(records.query_flag(F.col("u"), "success")).collect()
    assert [r[0] for r in got] == list(urls.values())


def test_form_sink(spark, tmp_path):
    rows = [("a", "a@b.example", "", "hi", "", "contact"), ("a", "a@b.example", "", "hi", "bot", "contact"), ("", "a@b.example", "", "hi", "", "contact"), ("a", "nope", "", "hi", "", "contact"), ("a", "a@b.example", None, " ", None, "contact"), (None, None, None, None, None, "contact")]
    df = spark.createDataFrame(rows, forms.SUBMISSION)
    for kind in ("parquet", "json", "csv"):
        forms.write_submissions(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2


def test_styles_and_json(spark):
    one = spark.range(1)
    got = one.select(
        records.with_class(records.with_class(F.array(F.lit("a")), "x", F.lit(True)), "x", F.lit(True)),
        records.with_class(F.array(F.lit("a"), F.lit("x")), "x", F.lit(False)),
        records.link_style(F.lit("/"), F.lit("/"), F.lit(True)),
        records.link_style(F.lit("/"), F.lit("/x"), F.lit(False)),
        records.or_default(F.lit(""), F.lit("d")),
        records.to_record_json({"a": F.lit(None).cast("string"), "b": F.lit("")}),
        answers.at(F.array(F.lit("q")), F.lit(3)),
    ).first()
    assert tuple(got) == (["a", "x"], ["a"], "current", "on_dark", "d", '{"a":null,"b":""}', None)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abc"), st.sampled_from(["next", "back", "reset"])), max_size=40))
def test_logs_against_loops(spark, log):
    rows = [(u, i, datetime(2024, 1, 1 + i // 9, tzinfo=timezone.utc), o, a) for i, (u, o, a) in enumerate(log)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp, event_type string, action string")
    selected, states, folds = {}, {}, {}
    for u, _, _, o, a in rows:
        now = selected.setdefault(u, [])
        now.remove(o) if o in now else now.append(o)
        s = states.get(u, 0)
        states[u] = 0 if a == "reset" else s if s == 4 else s + 1 if a == "next" else max(0, s - 1)
        folds.setdefault(u, []).append(o)
    assert {r[0]: r[1] for r in interaction.multi_select(df).collect()} == selected
    assert {r[0]: r[1] for r in interaction.step_machine(df).collect()} == states
    clicks = spark.createDataFrame(list(folds.items()), "user_id int, clicks array<string>")
    assert {r[0]: r[1] for r in clicks.select("user_id", answers.toggled_all("clicks")).collect()} == selected


def test_addresses_of_any_length(spark):
    texts = {"x@" + "a." * 30_000 + "com": True, "x@" + "a" * 63 + ".com": True, "x@" + "a" * 64 + ".com": False, "x" * 60_000 + "@b.com": True, "x@" + "a." * 30_000: False, "x@a-.com": False, "x@a--b.c": True, "x@" + "a-" * 30_000: False}
    df = spark.createDataFrame([(t,) for t in texts], "email string").repartition(2)
    assert {r["email"]: r["ok"] for r in df.select("email", records.is_email(F.col("email")).alias("ok")).collect()} == texts


def test_lookup_broadcasts_what_is_counted_small(spark):
    rows, table = spark.range(30).withColumn("k", F.col("id") % 7), spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for most in (10, 3):
        got = interaction.look_up(rows, table, "k", most)
        assert {(r["id"], r["v"]) for r in got.collect()} == {(i, i % 7 * 2) for i in range(30)}
    assert "ResolvedHint" not in interaction.look_up(rows, table, "k", 3)._jdf.queryExecution().analyzed().toString()


def test_step_machine_of_one_busy_key(spark, monkeypatch):
    import random

    monkeypatch.setattr(interaction, "FAN_BITS", 3)
    rng = random.Random(7)
    log = [(1 if rng.random() < 0.95 else 2, i, rng.choice(["next", "back", "reset", "other", None])) for i in range(3000)]
    states = {}
    for u, _, a in log:
        s = states.get(u, 0)
        states[u] = 0 if a == "reset" else s if s == 4 else s + 1 if a == "next" else max(0, s - 1) if a == "back" else s
    # All at the same time: the ids give the order.
    df = spark.createDataFrame(log, "user_id int, event_id int, action string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).repartition(4)
    for parts in (1, 6):
        assert {r[0]: r[1] for r in interaction.step_machine(df, parts=parts).collect()} == states
