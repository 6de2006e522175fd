"""Cubes with exact distinct counts, rolled up from the finest grouping set.

Spark's cube copies every row once for each grouping set, and a distinct count doubles
that. Here rows are grouped once, by all dimensions. Distinct values are numbered, and
each group holds them as bitmaps of 32,768 numbers; a coarser set is the union of the
bitmaps of a set that has one dimension more, so raw rows are read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hinted, ranked, settled

#: Distinct values and their numbers are broadcast up to this many.
BROADCAST_VALUES = 500_000


def cube(df: DataFrame, dims: Sequence[str], distinct: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per group of each subset of dims: dims (null where left out), grouping_id
    (a bit per dimension, the first one highest, set where it is left out), n (rows),
    n_distinct (different values of the column `distinct` that aren't null), and sums.

    Defined cases: null is a value of a dimension like any other, told from a left-out one
    by grouping_id; a sum without any value is null. An empty table gives the one row of the
    grand total, as SQL's cube does. Repeated rows count each.
    """
    sums = dict(sums or {})
    rows = df.select(*dims, F.col(distinct).alias("__sl_value"), *[c.alias(f"__sl_{name}") for name, c in sums.items()])
    values = rows.select("__sl_value").where("__sl_value IS NOT NULL").distinct()
    numbers = settled(ranked(values, F.asc("__sl_value"), name="__sl_number").withColumn("__sl_number", F.col("__sl_number") + 1))
    numbered = rows.join(hinted(numbers, BROADCAST_VALUES), "__sl_value", "left")
    bucket = F.bitmap_bucket_number("__sl_number").alias("__sl_bucket")
    own = [F.sum(f"__sl_{name}").alias(f"__sl_{name}") for name in sums]
    # Counts and sums are of rows, bitmaps of values; a row without a value has the bucket null.
    finest = settled(numbered.groupBy(*dims, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__sl_number")).alias("__sl_bits"), F.count(F.lit(1)).alias("n"), *own))
    made: dict[tuple[str, ...], DataFrame] = {tuple(dims): finest}
    for size in range(len(dims) - 1, -1, -1):
        for kept in combinations(dims, size):
            # From a set with one dimension more, the one that comes first.
            parent = made[next(p for p in made if len(p) == size + 1 and set(kept) <= set(p))]
            rolled = parent.groupBy(*kept, "__sl_bucket").agg(F.bitmap_or_agg("__sl_bits").alias("__sl_bits"), F.sum("n").alias("n"), *own)
            made[kept] = settled(rolled) if size else rolled
    parts = []
    for kept, table in made.items():
        gid = sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in kept)
        n_distinct = F.coalesce(F.sum(F.when(F.col("__sl_bucket").isNotNull(), F.bitmap_count("__sl_bits"))), F.lit(0)).cast("long")
        grouped = table.groupBy(*kept).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), n_distinct.alias("n_distinct"), *[F.sum(f"__sl_{name}").alias(name) for name in sums])
        shown = [F.col(d) if d in kept else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims]
        parts.append(grouped.select(*shown, F.lit(gid).cast("long").alias("grouping_id"), "n", "n_distinct", *sums))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


