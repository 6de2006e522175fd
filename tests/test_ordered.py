"""Joins on order, running windows and groups' first rows against DuckDB, with hot keys."""

from __future__ import annotations

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from sluice.operators import cubes, joins, sessions, topk, windows
from sluice.plans import ordered, streamed

SF = "/root/testdata/sf0.001"
PARTS = 7


def same(df, sql, **tables):
    """df has the rows of sql over Arrow tables, columns by name."""
    with duckdb.connect() as c:
        for name, t in tables.items():
            c.register(name, t)
        found = c.sql(sql)
        names, want = found.columns, found.fetchall()
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def table_of(rows, names):
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)})


def hot_log(seed, n=1500):
    """(k, t, v, i): nine tenths of the rows have one key, times tie, keys and values are null now and then."""
    rng = random.Random(seed)
    rows = [(rng.choice([1] * 18 + [2, None]), rng.choice([None, *range(60)]) if rng.random() < 0.5 else rng.randrange(5000), rng.choice([None, *range(50)]), i) for i in range(n)]
    return table_of(rows, "ktvi")


def spark_table(spark, table):
    return spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()], ", ".join(f"{c} long" for c in table.column_names)).repartition(5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_with_a_hot_key(spark, strict):
    a, b = hot_log(1), hot_log(2, 700)
    df = joins.as_of(spark_table(spark, a), spark_table(spark, b), "t", ["k"], {"v": "bv", "i": "bi"}, strict=strict, tie="i", parts=PARTS)
    sign = ">" if strict else ">="
    latest = "SELECT k, t, max(i) AS i, arg_max(struct_pack(v := v), i).v AS v FROM b WHERE k IS NOT NULL AND t IS NOT NULL GROUP BY k, t"
    same(df, f"SELECT a.*, b.v AS bv, b.i AS bi FROM a ASOF LEFT JOIN ({latest}) b ON a.k = b.k AND a.t {sign} b.t", a=a, b=b)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_as_of_without_right_rows(spark):
    a = hot_log(3, 40)
    empty = spark_table(spark, a).limit(0)
    assert joins.as_of(spark_table(spark, a), empty, "t", ["k"], {"v": "bv"}).where("bv IS NULL").count() == 40
    assert joins.as_of(empty, spark_table(spark, a), "t", ["k"], {"v": "bv"}).count() == 0


def spans(seed, n):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        b = rng.randrange(-3000, 3000) if rng.random() < 0.7 else 100
        made.append((rng.choice([1, 1, 1, 2, None]), b, b + rng.choice([-1, 0, 1, 2, 3, 7, 8, 9, 60, 500, 10**12 if rng.random() < 0.1 else 5]), i))
    made += [(1, None, 5, n), (1, 5, None, n + 1), made[0]]
    return table_of(made, "kbei")


@pytest.mark.parametrize("by", [["k"], []])
def test_overlaps_with_very_long_intervals(spark, by):
    a, b = spans(4, 400), spans(5, 300)
    df = joins.overlaps(spark_table(spark, a), spark_table(spark, b), ("b", "e"), ("b", "e"), by, {"i": "j"})
    key = "a.k = b.k AND" if by else ""
    same(df, f"SELECT a.*, b.i AS j FROM a JOIN b ON {key} a.b < b.e AND b.b < a.e AND a.b < a.e AND b.b < b.e", a=a, b=b)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_overlap_work_follows_the_pairs(spark):
    """Short intervals side by side, and some that cover all: rows that meet are few."""
    short = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") * 10).alias("b"), (F.col("id") * 10 + 3).alias("e"))
    long = spark.range(20).select(F.col("id").alias("j"), (F.lit(-5) - F.col("id")).alias("b"), F.lit(10**15).cast("long").alias("e"))
    every = short.withColumnRenamed("i", "j").unionByName(long)
    df = joins.overlaps(short, every, ("b", "e"), ("b", "e"), (), {"j": "j"})
    assert df.count() == 4000 + 4000 * 20
    met = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in met


def shuffled_rows(spark, df):
    """Rows that all jobs of df's run write to shuffles."""
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, spark._jvm.PythonUtils.toSeq([0.5]).toArray(spark._jvm.scala.reflect.ClassTag.Double()), None)
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    n = df.count()
    found = stages()
    return n, sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in seen)


def test_overlaps_are_never_broadcast(spark):
    """Rows for each bin or block are many more than the table's size says."""
    t = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 10).alias("b"), (F.col("id") * 10 + F.when(F.col("id") % 50 == 0, 100_000).otherwise(F.col("id") % 40 + 1)).alias("e"))
    df = joins.overlaps(t, t.withColumnRenamed("i", "j"), ("b", "e"), ("b", "e"), (), {"j": "j"})
    assert "Broadcast" not in plan(df)


def test_wide_ranges_go_to_few_blocks(spark):
    """Each row has 900 matches, which are 14 blocks of 64 rows."""
    t = spark.range(9000).select(F.col("id").alias("i"), F.col("id").alias("t"))
    made = joins.in_range(t, t, "t", F.col("t") + 1, F.col("t") + 900, take={"i": "j"})
    n, moved = shuffled_rows(spark, made)
    assert n == sum(min(900, 8999 - i) for i in range(9000)) and moved < 5 * 9000


def test_odd_values_in_ranges(spark):
    """NaN is greater than all numbers, texts have their bytes' order, and no value is in a range without ends that meet."""
    nan = float("nan")
    a = spark.createDataFrame([(0, 1.0, nan), (1, nan, nan), (2, 3.0, 2.0), (3, -0.0, 0.0), (4, None, 1.0)], "i int, lo double, hi double")
    b = spark.createDataFrame([(0, 0.0), (1, 1.5), (2, nan), (3, None), (4, float("inf"))], "j int, x double")
    for parts in (None, 3):
        got = joins.in_range(a, b, "x", F.col("lo"), F.col("hi"), take={"j": "j"}, parts=parts).collect()
        assert sorted((r["i"], r["j"]) for r in got) == [(0, 1), (0, 2), (0, 4), (1, 2), (3, 0)]
        words = spark.createDataFrame([("z",), ("\u00e9",), ("\U0001f600",), ("\uffff",), ("",), (None,)], "w string")
        got = joins.in_range(words, words, "w", F.col("w"), None, take={"w": "v"}, closed=(False, True), parts=parts).collect()
        order = ["", "z", "\u00e9", "\uffff", "\U0001f600"]
        assert sorted((r["w"], r["v"]) for r in got) == sorted((x, y) for k, x in enumerate(order) for y in order[k + 1 :])


@pytest.mark.parametrize("closed", [(True, True), (False, True), (True, False), (False, False)])
def test_ranges_over_dense_and_hot_values(spark, closed):
    a, b = hot_log(6, 250), hot_log(7, 300)
    low, high = (F.col("t") - F.col("v")), (F.col("t") + 2)
    df = joins.in_range(spark_table(spark, a), spark_table(spark, b), "t", low, high, ["k"], {"i": "j", "t": "u"}, closed, PARTS)
    left, right = (">=" if closed[0] else ">"), ("<=" if closed[1] else "<")
    same(df, f"SELECT a.*, b.i AS j, b.t AS u FROM a JOIN b ON a.k = b.k AND b.t {left} a.t - a.v AND b.t {right} a.t + 2", a=a, b=b)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


@pytest.mark.parametrize("by", [["k"], []])
def test_inequalities(spark, by):
    a, b = hot_log(8, 60), hot_log(9, 50)
    key = "a.k = b.k AND" if by else ""
    df = joins.in_range(spark_table(spark, a), spark_table(spark, b), "t", F.col("t"), None, by, {"i": "j"}, (False, True), PARTS)
    same(df, f"SELECT a.*, b.i AS j FROM a JOIN b ON {key} b.t > a.t", a=a, b=b)
    df = joins.in_range(spark_table(spark, a), spark_table(spark, b), "t", None, F.col("t"), by, {"i": "j"}, parts=PARTS)
    same(df, f"SELECT a.*, b.i AS j FROM a JOIN b ON {key} b.t <= a.t", a=a, b=b)
    assert joins.in_range(spark_table(spark, a).limit(0), spark_table(spark, b), "t", None, F.col("t")).count() == 0


def cube_rows(seed, n=600):
    rng = random.Random(seed)
    return table_of([(rng.choice([1, 1, 1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice([None, *range(40), 10**15, -5]), i) for i in range(n)], "abvi")


def test_cube_with_exact_distinct_counts(spark):
    t = cube_rows(13)
    df = cubes.cube(spark_table(spark, t), ["a", "b"], "v", {"s": F.col("i")})
    same(df, "SELECT a, b, GROUPING(a, b) AS grouping_id, count(*) AS n, count(DISTINCT v) AS n_distinct, sum(i)::BIGINT AS s FROM t GROUP BY CUBE (a, b)", t=t)
    assert "Expand" not in plan(df)
    total = cubes.cube(spark_table(spark, t).limit(0), ["a", "b"], "v").collect()
    assert [tuple(r) for r in total] == [(None, None, 3, 0, 0)]
    one = cubes.cube(spark_table(spark, t), [], "v")
    same(one, "SELECT 0::BIGINT AS grouping_id, count(*) AS n, count(DISTINCT v) AS n_distinct FROM t", t=t)


def test_cube_over_many_buckets(spark):
    t = spark.range(100_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("v"))
    got = {r["k"]: r["n_distinct"] for r in cubes.cube(t, ["k"], "v").collect()}
    assert got == {None: 100_000, 0: 33_334, 1: 33_333, 2: 33_333}


def test_sessions_over_a_hot_key(spark):
    t = hot_log(14).filter(pa.compute.is_valid(hot_log(14)["t"]))
    df = sessions.in_sessions(spark_table(spark, t), ["k"], "t", F.lit(20), [F.asc("t"), F.asc("i")], parts=PARTS)
    opens = "coalesce(t - lag(t) OVER (PARTITION BY k ORDER BY t, i) > 20, false)::INT"
    same(df, f"SELECT * EXCLUDE o, (sum(o) OVER (PARTITION BY k ORDER BY t, i))::BIGINT AS session FROM (SELECT *, {opens} AS o FROM t)", t=t)


def test_funnel_of_odd_sessions(spark):
    sessions.register_funnel(spark)
    rows = [(1, 0, k, x) for k, x in enumerate(["buy", "see", "buy", None, "add", "see", "buy"])] + [(None, 1, 0, "see"), (2, 0, 0, None)]
    spark.createDataFrame(rows, "user_id long, session long, us long, event_type string").createOrReplaceTempView("odd_sessions")
    q = "SELECT * FROM funnel_steps(TABLE(odd_sessions) PARTITION BY (user_id, session) ORDER BY (us), 'see,add,buy')"
    assert sorted(map(repr, (tuple(r) for r in spark.sql(q).collect()))) == sorted(map(repr, [(1, 0, 7, 3, "buy"), (None, 1, 1, 1, "see"), (2, 0, 1, 0, None)]))
    assert spark.sql(q.replace("odd_sessions", "(SELECT * FROM odd_sessions WHERE us > 99)")).collect() == []


def test_running_windows_over_a_hot_key(spark):
    t = hot_log(10)
    order = [F.asc_nulls_first("t"), F.asc("i")]
    wanted = {x: (x, F.col("v")) for x in ("sum", "count", "min", "max", "last")}
    df = windows.running(spark_table(spark, t), ["k"], order, wanted, parts=PARTS).withColumnsRenamed({x: f"r_{x}" for x in wanted})
    sql = ", ".join(f"{'last_value' if x == 'last' else x}(v{' IGNORE NULLS' if x == 'last' else ''}) OVER w AS r_{x}" for x in wanted)
    over = "FROM t WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, i ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    same(df.withColumn("r_sum", F.col("r_sum").cast("long")), f"SELECT *, {sql} {over.format('CURRENT ROW')}".replace("sum(v) OVER w AS", "(sum(v) OVER w)::BIGINT AS"), t=t)
    before = windows.running(spark_table(spark, t), ["k"], order, {"s": ("sum", F.col("v"))}, include_row=False, parts=PARTS)
    same(before, f"SELECT *, (sum(v) OVER w)::BIGINT AS s {over.format('1 PRECEDING')}", t=t)


@pytest.mark.parametrize("offset", [1, 3, 700])
def test_lag_over_a_hot_key(spark, offset):
    t = hot_log(11)
    df = windows.lagged(spark_table(spark, t), ["k"], [F.asc_nulls_first("t"), F.asc("i")], F.col("v"), offset, parts=PARTS)
    same(df, f"SELECT *, lag(v, {offset}) OVER (PARTITION BY k ORDER BY t NULLS FIRST, i) AS lag FROM t", t=t)


def test_no_window_holds_the_hot_key(spark):
    hot = spark.range(8000).select(F.lit(1).alias("k"), F.lit(7).alias("t"), F.col("id"))
    sizes = windows.in_pieces(hot, ["k"], [F.asc("t")], PARTS).groupBy("k", windows.PART).count()
    assert sizes.agg(F.max("count")).first()[0] < 4000
    assert windows.running(hot, ["k"], [F.asc("t")], {"n": ("count", F.lit(1))}, parts=PARTS).agg(F.max("n")).first()[0] == 8000


def test_windows_of_nothing(spark):
    none = spark.range(0).withColumn("k", F.lit(1))
    assert windows.running(none, ["k"], [F.asc("id")], {"n": ("count", F.lit(1))}).collect() == []
    assert windows.lagged(none, ["k"], [F.asc("id")], F.col("id")).collect() == []


@pytest.mark.parametrize("held", [50, 50_000])
def test_first_rows_of_hot_groups(spark, monkeypatch, held):
    monkeypatch.setattr(topk, "HELD_ROWS", held)
    t = hot_log(12)
    df = topk.top_per_group(spark_table(spark, t), ["k"], [("v", True), ("t", False), ("i", True)], 7)
    sql = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, t NULLS LAST, i DESC) AS rank FROM t) WHERE rank <= {}"
    same(df, sql.format(7), t=t)
    assert topk.top_per_group(spark_table(spark, t), ["k"], [("i", True)], 0).count() == 0
    assert topk.top_per_group(spark_table(spark, t).limit(0), ["k"], [("i", True)], 3).count() == 0


def test_few_rows_of_a_group_are_shuffled(spark):
    t = spark.range(20_000, numPartitions=6).select((F.col("id") % 2).alias("k"), F.col("id"))
    held = topk.top_per_group(t, ["k"], [("id", True)], 5)
    held.collect()
    numbers = spark.range(4).select(F.lit("x").alias("k"), F.array(F.lit(float("nan")), F.lit(1.0), F.lit(None), F.lit(-0.5))[F.col("id").cast("int")].alias("x"))
    down = topk.top_per_group(numbers, ["k"], [("x", True)], 4).orderBy("rank").collect()
    assert [repr(r["x"]) for r in down] == ["nan", "1.0", "-0.5", "None"]
    assert [r["id"] for r in held.where("k = 0").orderBy("rank").collect()] == [19998, 19996, 19994, 19992, 19990]


QUERIES, ORACLE_SQL = ordered.QUERIES | streamed.QUERIES, ordered.ORACLE_SQL | streamed.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_sql(spark, name):
    with duckdb.connect() as c:
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = c.sql(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    assert {c: str(want[c].type) for c in want.column_names} == {c: str(got[c].type) for c in got.column_names}
    assert sorted(map(repr, got.select(want.column_names).to_pylist())) == sorted(map(repr, want.to_pylist()))
    assert got.num_rows
