"""Exact dedup by splitting heavy hitters from the rest.

A Misra-Gries style frequent-items sketch (approx_top_k, partial on each task
and merged) names the digests that may be frequent. Exact partial counts verify
them; the verified winners, at most `counters` of them by the sketch's
construction, are broadcast and their rows are settled on the map side. Only the
remaining digests go through a shuffle, summed per digest before it.

Defined cases: a null text is the empty text, so null and empty texts are equal.
Null ids come after all others. Repeated rows are rows of their own: of a group
exactly one row is kept, also if its id occurs twice. An empty table gives an
empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, one_spaced, settled

#: Counters of the sketch: a digest with more than about 1/counters of all rows is found.
COUNTERS = 1024
#: A verified winner has at least this share of all rows.
HEAVY_SHARE = 1 / 512
#: Groups of two and more that aren't heavy are broadcast up to this many (about 100 bytes each).
BROADCAST_GROUPS = 100_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The text is read and hashed once; all that follows works on 32-byte digests.
    """
    rows = settled(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(one_spaced(F.col(text_col)), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    # The group's order: ids ascending, nulls last, then rows as they were read.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row"))

    least = rows.count() * heavy_share
    named = (
        rows.select(F.xxhash64("digest").alias("mark"))
        .agg(F.expr(f"approx_top_k(mark, {counters // 2}, {counters})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where(F.col("t.count") >= least)
        .select(F.col("t.item").alias("mark"))
    )
    heavy = settled(
        rows.withColumn("mark", F.xxhash64("digest"))
        .join(F.broadcast(named), "mark", "left_semi")
        .groupBy("digest")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where((F.col("group_size") >= least) & (F.col("group_size") > 1))
    )
    settled_here = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # Partial sums before the shuffle, kept apart from the join back, whose large
    # partitions can then be split. A digest that occurs once is its own group.
    groups = settled(rest.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    alone = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row")
    shuffled = rest.join(hinted(groups, BROADCAST_GROUPS), "digest", "left").withColumns({"first": F.coalesce("first", alone), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return settled_here.unionByName(shuffled.select(*settled_here.columns)).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of equal texts one row of its least id.
    Where that id is repeated within the group, the first text by code point stays, and
    of rows that have the same text too, the first by a hash of their columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__sl_id"), F.col("text_sha256").alias("__sl_sha"))
    marked = docs.select(F.struct("*").alias("__sl_row"), F.sha2(one_spaced(F.col(text_col)), 256).alias("__sl_sha"))
    row = F.col("__sl_row")
    of_kept = marked.join(kept, row[id_col].eqNullSafe(F.col("__sl_id")) & (marked["__sl_sha"] == kept["__sl_sha"]), "left_semi")
    plain = [row[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = F.min_by("__sl_row", F.struct(row[text_col], F.xxhash64(*plain))).alias("__sl_row")
    return of_kept.groupBy("__sl_sha").agg(one).select("__sl_row.*")
