"""Running windows where one key may hold most of the rows.

Spark's window gives all rows of a key to one task. Here rows are sorted by key and
order in ranges, and a window is a key within a range: a piece. What a piece needs of
those before it is one row, found in three steps:

1. every piece is summed up on its own;
2. of keys that lie in several pieces, at most two a range, the sums are put together
   in the order of the pieces, which are as few as there are ranges;
3. every row has the running value within its piece, and what was carried in.

parts names the number of ranges; without it there are as many as Spark shuffles to, and
small neighbours are put together by their bytes.

Defined cases: null keys are one key. Rows with equal keys and order stand in the order
that the row's number gives, so name an order that is unique where that matters; equal
rows may be split between ranges. Null values are left out by sum, count, min, max
and last. An empty table gives an empty result. All columns of the input are
kept; new ones are named by the caller and may not clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import null_safe_join, piece_of, pieces

PART, ROW = "__sl_part", "__sl_row"
#: The key of a window over all rows.
ALL = "__sl_all"
FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _joined(a: Column, b: Column, fold: str) -> Column:
    """What two neighbouring stretches have together; null is a stretch without values."""
    both = {"sum": a + b, "count": a + b, "min": F.least(a, b), "max": F.greatest(a, b), "last": b}[fold]
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """df with PART, its range's number, and ROW, its place within all ranges."""
    # The row's number spreads rows that are equal in key and order over the ranges.
    numbered = df.withColumn(ROW, F.monotonically_increasing_id())
    rows = pieces(numbered, *[F.col(k).asc_nulls_first() for k in keys], *order, F.asc(ROW), parts=parts)
    return rows.withColumns({PART: piece_of(), ROW: F.col("__sl_at")}).drop("__sl_at")


def _carried(rows: DataFrame, keys: Sequence[str], sums: Sequence[Column], carry: Mapping[str, Column]) -> DataFrame:
    """(keys, PART and the columns of carry) of each piece that follows another one of
    its key. carry is made, over the pieces of a key in order, from the columns of sums."""
    per_piece = rows.groupBy(*keys, PART).agg(*sums)
    spread = rows.groupBy(*keys).agg(F.min(PART).alias("__sl_first"), F.max(PART).alias("__sl_last")).where("__sl_first < __sl_last")
    # At most two keys of a range reach into another one: the first and the last.
    few = null_safe_join(per_piece, F.broadcast(spread), keys)
    w = Window.partitionBy(*keys).orderBy(PART)
    made = few.withColumns({name: c.over(w.rowsBetween(Window.unboundedPreceding, -1)) for name, c in carry.items()})
    return made.where(F.col(PART) > F.col("__sl_first")).select(*keys, PART, *carry)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: Mapping[str, tuple[str, Column]], include_row: bool = True, parts: int | None = None) -> DataFrame:
    """df with a column per wanted name: its fold (sum, count, min, max or last) of a
    column over the rows of the key up to this one, itself included or not. As in SQL a
    sum, min, max or last without any value is null, and a count is 0."""
    values = {f"__sl_v_{name}": c for name, (_, c) in wanted.items()} | ({} if keys else {ALL: F.lit(0)})
    keys = keys or [ALL]
    rows = in_pieces(df.withColumns(values), keys, order, parts)
    ordered = Window.partitionBy(*keys, PART).orderBy(ROW)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if include_row else -1)
    # The last value in a piece is the one with the greatest place, so partial sums give it.
    sums = [(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(ROW))) if fold == "last" else FOLDS[fold](v)).alias(f"__sl_s_{name}") for name, (fold, _) in wanted.items() for v in [f"__sl_v_{name}"]]
    carry = {f"__sl_c_{name}": (F.sum if fold == "count" else FOLDS[fold])(F.col(f"__sl_s_{name}")) for name, (fold, _) in wanted.items()}
    joined = null_safe_join(rows, F.broadcast(_carried(rows, keys, sums, carry)), [*keys, PART], "left")
    own = {name: FOLDS[fold](F.col(f"__sl_v_{name}")).over(frame) for name, (fold, _) in wanted.items()}
    out = {name: _joined(F.col(f"__sl_c_{name}"), c, wanted[name][0]) for name, c in own.items()}
    out = {name: F.coalesce(c, F.lit(0).cast("long")) if wanted[name][0] == "count" else c for name, c in out.items()}
    return joined.withColumns(out).select(*df.columns, *wanted)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, offset: int = 1, name: str = "lag", parts: int | None = None) -> DataFrame:
    """df with the value of the row that is offset rows before in its key, or null."""
    if offset < 1:
        raise ValueError("offset must be 1 or more")
    rows = in_pieces(df.withColumns({"__sl_v": value} | ({} if keys else {ALL: F.lit(0)})), keys or [ALL], order, parts)
    keys = keys or [ALL]
    w = Window.partitionBy(*keys, PART)
    # Of a piece the last `offset` rows can be looked back at from another one.
    at_end = rows.withColumn("__sl_back", F.row_number().over(w.orderBy(F.desc(ROW)))).where(F.col("__sl_back") <= offset)
    sums = [F.sort_array(F.collect_list(F.struct(ROW, F.col("__sl_v").alias("v")))).alias("__sl_tail")]
    spread = rows.groupBy(*keys).agg(F.min(PART).alias("__sl_first"), F.max(PART).alias("__sl_last")).where("__sl_first < __sl_last")
    tails = null_safe_join(at_end, F.broadcast(spread), keys).groupBy(*keys, PART).agg(*sums)
    # So many pieces before this one hold enough rows, as none is empty.
    before = F.flatten(F.collect_list("__sl_tail").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(-offset, -1)))
    carried = tails.withColumn("__sl_before", before).select(*keys, PART, "__sl_before")
    joined = null_safe_join(rows, F.broadcast(carried), [*keys, PART], "left")
    place = F.row_number().over(w.orderBy(ROW))
    inside = F.lag("__sl_v", offset).over(w.orderBy(ROW))
    # Row number p of its piece looks back at the (offset - p + 1)th from the end of what was before.
    outside = F.try_element_at("__sl_before", F.col("__sl_place") - F.lit(offset + 1))["v"]
    out = joined.withColumns({"__sl_place": place, "__sl_in": inside})
    return out.withColumn(name, F.when(F.col("__sl_place") > offset, F.col("__sl_in")).otherwise(outside)).select(*df.columns, name)
