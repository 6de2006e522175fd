"""Benchmark decontamination by a broadcast set of test windows, in DataFrame expressions.

Texts are normalised to words: A-Z in lower case, then digits, letters and whatever is
not ASCII. A benchmark item's windows are its runs of WIDTH words; an item of fewer
words is one window.

1. The windows' 64-bit hashes are broadcast as a set of numbers. The scan makes each
   document's windows, of the lengths that the benchmark has, hashes them and looks
   them up, all in one compiled stage; only windows that are found leave it, with
   their words, beside one row per document. Of more than BROADCAST_WINDOWS hashes the
   set is cut into blocks by hash, and the documents are scanned once for each block.
2. Hits are verified: their words are joined with the windows' words, so that equal
   hashes of different words count for nothing.
3. Per document the verified windows become spans of words, which are counted, or
   removed from the text, or make the document go.

Defined cases: a null text or one without words has no windows, and neither has such
an item. Items that repeat are counted once, by id; items without an id make hits and
spans but are not among n_items. Rows that repeat an id and a text have a row each, with the
same result. An empty benchmark contaminates nothing, an empty table gives an empty
result. Extra columns are ignored by contamination and kept by decontaminated. Of a
document of any length one row holds the words, and its verified windows are
gathered in one row too, never those of other documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, lower_ascii, settled, small_enough

WIDTH = 10
#: A word of a text in lower case, and of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Hashes of windows (8 bytes each) are broadcast up to this many at a time.
BROADCAST_WINDOWS = 2_000_000
#: Windows' words (about 100 bytes each) and documents with hits are broadcast up to this many.
BROADCAST_BODIES, BROADCAST_DOCS = 200_000, 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def test_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, size, mark, body) of each distinct window of each item."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("size", F.least(F.size("w"), F.lit(width)))
    each = sized.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
    own = F.slice("w", F.col("i"), F.col("size"))
    return each.select("item", "size", F.xxhash64(own).alias("mark"), F.array_join(own, " ").alias("body")).distinct()


def scanned(docs: DataFrame, marks: DataFrame, sizes: list[int], with_rows: bool, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, tie: the text's hash, n_words, code, body) of each window whose hash is
    in marks, and with_rows of each document, with code 0. A code is made of the
    first word's place, times width + 1, and the window's size."""
    stride = width + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    starts = [F.when(n >= s, F.sequence(F.lit(stride + s), (n - s + 1) * stride + s, F.lit(stride))).otherwise(F.array().cast("array<int>")) for s in sizes]
    codes = F.concat(F.array(F.lit(0)) if with_rows else F.array().cast("array<int>"), *starts)
    each = rows.select("doc_id", "tie", "w", n.cast("long").alias("n_words"), F.explode(codes).alias("code"))
    own = F.slice("w", F.floor(F.col("code") / stride).cast("int"), F.col("code") % stride)
    marked = each.withColumn("mark", F.when(F.col("code") > 0, F.xxhash64(own)))
    met = marked.join(F.broadcast(marks.select("mark", F.lit(True).alias("known"))), "mark", "left").where((F.col("code") == 0) | F.col("known"))
    return met.select("doc_id", "tie", "n_words", "code", F.when(F.col("code") > 0, F.array_join(own, " ")).alias("body"))


def merged_spans(codes: Column, width: int) -> Column:
    """Sorted codes of windows as disjoint spans of words: begin from 0, and end."""
    stride = width + 1

    def put(acc: Column, code: Column) -> Column:
        begin = F.floor(code / stride) - 1
        end = begin + code % stride
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], end).alias("end"))
        return F.when(last["end"] >= begin, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(F.struct(begin.alias("begin"), end.alias("end")))))

    return F.aggregate(codes, F.array().cast("array<struct<begin: bigint, end: bigint>>"), put)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, tie (the text's hash), n_words, spans (of words that
    lie in a test window; null without any) and items (sorted ids; null without any)."""
    windows = settled(test_windows(benchmark, item_col, "text", width))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    marks = settled(windows.select("mark").distinct())
    blocks = 1 if small_enough(marks, BROADCAST_WINDOWS) else -(-marks.count() // BROADCAST_WINDOWS) * 2
    parts = [scanned(docs, marks.where(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == k) if blocks > 1 else marks, sizes, k == 0, id_col, text_col, width) for k in range(blocks)]
    found = settled(reduce(DataFrame.unionByName, parts))
    bodies = windows.select("body").distinct()
    hits = settled(found.where("code > 0").select("doc_id", "tie", "code", "body").join(hinted(bodies, BROADCAST_BODIES), "body", "left_semi"))
    spans = hits.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    named = hits.select("doc_id", "tie", "body").distinct().join(hinted(windows.select("body", "item").where("item IS NOT NULL").distinct(), BROADCAST_BODIES), "body")
    items = named.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = found.where("code = 0").select("doc_id", "tie", "n_words")
    for part in (spans, items):
        own = hinted(settled(part.withColumnsRenamed({"doc_id": "__sl_id", "tie": "__sl_tie"})), BROADCAST_DOCS)
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("__sl_id")) & F.col("tie").eqNullSafe(F.col("__sl_tie")), "left").drop("__sl_id", "__sl_tie")
    return rows.select("doc_id", "tie", "n_words", F.when(F.size("codes") > 0, merged_spans(F.col("codes"), width)).alias("spans"), "items")


def words_hit(spans: Column) -> Column:
    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<begin: bigint, end: bigint>>")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words of spans, each with what follows it up to the next word."""
    gaps = F.split(text, RAW_WORD, -1)
    hit = lambda k: F.exists(spans, lambda s: (s["begin"] <= k) & (k < s["end"]))
    kept = F.transform(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), lambda w, k: F.when(hit(k), F.lit("")).otherwise(F.concat(w, F.get(gaps, k + 1))))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that have a test window, or (remove="spans") with those
    windows' words cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    hit = contamination(docs, benchmark, id_col, text_col, **how).where("spans IS NOT NULL")
    hit = settled(hit.select(F.col("doc_id").alias("__sl_id"), F.col("tie").alias("__sl_tie"), F.col("spans").alias("__sl_spans")).dropDuplicates(["__sl_id", "__sl_tie"]))
    on = F.col(id_col).eqNullSafe(F.col("__sl_id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__sl_tie"))
    if remove == "documents":
        return docs.join(hinted(hit, BROADCAST_DOCS), on, "left_anti")
    joined = docs.join(hinted(hit, BROADCAST_DOCS), on, "left")
    text = F.when(F.col("__sl_spans").isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col("__sl_spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)
