"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, get weights 1, 2, 3, repeating. Together
they may take as many words as all documents have; a source stops at `most` times
its own size and what it leaves is shared again by weight among the others.

Within a source every document is expected target / size times. The documents
stand in a fixed order (size class, bucket by a digest of id and text, size, id), the
expected copies are summed from the start of the source, one random offset is
added, and a document is emitted once for every whole number that its step
crosses. As the order runs through sizes, the words taken come near the target.

No task holds a source: the order's running counts come from counts per (source,
size class, bucket), at most BUCKETS per source and class however many rows there
are, and only a bucket's own rows are numbered together. Rows that share an id, or
have none, lie in different buckets as their texts differ.

Defined cases: a null or empty text has size 0 and can still be emitted; it takes
no words. A null source is a source of its own, last in order. Null ids are ids
like others, first in order. Repeated rows are rows of their own; rows with the
same id and size are ordered by their text's hash and each is emitted on its own
account. A source without words has target 0. An empty table gives an empty
result. Extra columns are ignored by the plan and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, ranked, settled, ship_code, tidy, word_counts

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20_240_229
#: Buckets and offsets come from the first three hexadecimal digits of a digest. Offsets
#: are odd multiples of 1 / (2 * BUCKETS), so that sums with ranks stay exact.
BUCKETS = 4096
BROADCAST_SOURCES = 100_000


def digits(*parts: Column) -> Column:
    """A number below BUCKETS from the parts' digest; null parts are empty."""
    return F.conv(F.left(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), F.lit(3)), 16, 10).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), tie (the text's hash), bucket, kept in the checkpoint folder."""
    ship_code(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array(word_counts(b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "tie", "bucket")), sizes], ["doc_id", "source", "tie", "bucket", "size"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("tie"), digits(F.col(id_col), F.col(text_col)).alias("bucket"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return settled(rows.mapInArrow(tidy(count), f"doc_id {kind}, source string, tie long, bucket int, size long"))


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: source, source_size, target."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ranked(sums, F.col("source").isNull(), F.col("source"), name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = settled(order.withColumn("weight", weight))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # A source is full at the level (words per weight) at which its share reaches its most.
    full_at, room = F.col("source_size") * float(most) / F.col("weight"), F.col("source_size") * float(most)
    level, full = 0.0, -1
    while True:
        is_full = full_at < F.lit(level)
        n, taken, left = table.agg(F.count_if(is_full), F.sum(F.when(is_full, room).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not left:
            break
        full, level = n, (total - taken) / left
    return table.select("source", "source_size", F.when(is_full, room).otherwise(F.col("weight") * level).alias("target"))


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """rows (see `sized`) with source_size, target and how often each is emitted."""
    rows = rows.select(
        "*",
        F.col("source").isNull().alias("nil"),
        F.coalesce("source", F.lit("")).alias("src"),
        # Two classes for each power of two, by the first two binary digits.
        (F.length(F.bin(F.col("size") + 1)) * 2 + F.coalesce(F.substring(F.bin(F.col("size") + 1), 2, 1).try_cast("int"), F.lit(0))).alias("class"),
    ).drop("source")
    chunk = ["nil", "src", "class", "bucket"]
    # Null-safe join on two plain columns, so that it stays an equi-join.
    targets = source_targets(rows.withColumn("source", F.when(~F.col("nil"), F.col("src"))), weights, most).select(
        F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("src"), "source_size", "target"
    )
    before = Window.partitionBy("nil", "src").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (digits(F.lit(seed), F.col("nil").cast("int"), F.col("src")) + 0.5) / float(BUCKETS)
    chunks = (
        rows.groupBy(*chunk)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(hinted(targets, BROADCAST_SOURCES), ["nil", "src"])
        .withColumns({"rate": F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0), "offset": offset})
        .drop("n")
    )
    own = F.row_number().over(Window.partitionBy(*chunk).orderBy("size", "doc_id", "tie")) - 1
    rank = F.col("before") + F.col("own")
    crossed = F.floor(F.col("offset") + (rank + 1) * F.col("rate")) - F.floor(F.col("offset") + rank * F.col("rate"))
    return (
        rows.withColumn("own", own)
        .join(chunks, chunk)
        .select("doc_id", "tie", F.when(~F.col("nil"), F.col("src")).alias("source"), "size", "source_size", "target", F.least(crossed, F.ceil("rate")).cast("long").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as it is emitted. Rows with the same
    id, text and source share what they are due evenly; who gets one more is decided
    by a hash of all columns, so that reruns agree."""
    names = {"doc_id": "__sl_id", "tie": "__sl_tie", "source": "__sl_source"}
    due = copies(sized(docs, id_col, text_col, source_col), **how).groupBy(*[F.col(c).alias(n) for c, n in names.items()])
    due = due.agg(F.sum("copies").alias("__sl_due"), F.count(F.lit(1)).alias("__sl_rows")).where("__sl_due > 0")
    marked = docs.withColumn("__sl_hash", F.xxhash64(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col("__sl_id")) & (F.col("__sl_hash") == F.col("__sl_tie")) & F.col(source_col).cast("string").eqNullSafe(F.col("__sl_source"))
    joined = marked.join(due, on)
    alone = joined.where("__sl_rows = 1").withColumn("__sl_times", F.col("__sl_due"))
    whole = F.xxhash64(*[F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    place = F.row_number().over(Window.partitionBy("__sl_id", "__sl_tie", "__sl_source").orderBy(whole))
    shared = joined.where("__sl_rows > 1").withColumn("__sl_times", F.floor(F.col("__sl_due") / F.col("__sl_rows")) + (place <= F.col("__sl_due") % F.col("__sl_rows")).cast("long"))
    out = alone.unionByName(shared)
    return out.withColumn("__sl_one", F.explode(F.array_repeat(F.lit(1), F.col("__sl_times").cast("int")))).select(*docs.columns)
