"""Line dedup by winnowing: repeated runs of lines are kept where they come first.

A line's hash ignores white space at its ends and runs of it inside. From every
line of a document a window of lines begins that has at least LEAST words (the
fewest lines that do; lines without words don't count), and at every line such a
window ends. The line with a window's least hash is a fingerprint; a document gives
each of its fingerprints once, with the windows that chose it. Two documents that
share a run of LEAST words or more share a window, hence a fingerprint.

1. Fingerprints are counted by hash. Those that occur once, which are most, go, and
   their windows with them: only positions that meet another one are looked at again.
2. At the positions left, a match is extended both ways, window by window around the
   fingerprint: a window that occurs before (order: id, text hash, place), anywhere, is
   deleted whole. That deletes exactly the lines that lie in a run of whole lines, of
   LEAST words or more, that occurs before: a line of such a run lies in the window
   that begins there, if that ends within the run, and else in the window that ends
   with the run. Both have occurred before with the run, and what makes a window the
   shortest is in its own lines, so it is a window there too. A passage's longer
   variants therefore need no partner of their own.

In step 2 windows are told apart by fingerprint and whole lines' hash, 128 bits, and
each is compared with its first occurrence alone: a line that many documents share
costs a row for each of its windows, not their pairs. Partial sums come before both
shuffles, and joins are with tables of their own, so that large partitions can be split.

Defined cases: a null text has no lines and stays null; an empty text stays empty.
Rows with the same id and the same text are one document: they are edited alike
(whole copies of a row are exact dedup's work). Rows with a null id come first in
order. Runs are found within a document too. An empty table gives an empty
result. Extra columns are kept by drop_repeated_lines. Of a document all line
hashes are held, never its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, settled, ship_code, small_enough, tidy

#: Words that a repeated run has at least.
LEAST = 50
#: Fingerprints (8 bytes each) and ids with their texts' hashes (16 bytes or an id's length) are broadcast up to this many.
BROADCAST_PRINTS, BROADCAST_IDS = 500_000, 500_000


def line_marks(text: str) -> tuple[list[int], list[int]]:
    """Per line (split at \\n): a 64-bit hash of its words, and how many they are."""
    marks, sizes = [], []
    for line in text.split("\n"):
        words = line.split()
        sizes.append(len(words))
        marks.append(xxhash.xxh3_64_intdigest(" ".join(words).encode(errors="surrogatepass")) - (1 << 63) if words else 0)
    return marks, sizes


def windows(marks: list[int], sizes: list[int], least: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(hash, place, windows) of each fingerprint over the worded lines. windows: (first
    place, last place, hash) of those that chose it: the shortest that begin at a line,
    and the shortest that end at one. Of equal least hashes the last place is chosen."""
    places = [i for i, n in enumerate(sizes) if n]
    spans = set()
    end = words = 0
    for begin in range(len(places)):
        while end < len(places) and words < least:
            words += sizes[places[end]]
            end += 1
        if words < least:
            break
        spans.add((begin, end))
        words -= sizes[places[begin]]
    begin = words = 0
    for end in range(len(places)):
        words += sizes[places[end]]
        while words - sizes[places[begin]] >= least:
            words -= sizes[places[begin]]
            begin += 1
        if words >= least:
            spans.add((begin, end + 1))
    own = [marks[i] for i in places]
    raw = np.array(own, np.int64).tobytes()
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in sorted(spans):
        at = min(range(begin, end), key=lambda k: (own[k], -k))
        chosen.setdefault(at, []).append((places[begin], places[end - 1], xxhash.xxh3_64_intdigest(raw[8 * begin : 8 * end]) - (1 << 63)))
    for at, found in chosen.items():
        yield own[at], places[at], found


WINDOW = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("window", pa.int64())])
PRINT = pa.struct([("print", pa.int64()), ("place", pa.int32()), ("windows", pa.list_(WINDOW))])


def line_table(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Per document (id and text): doc_id, tie, prints (its fingerprints: hash, place
    among the worded lines, windows)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = []
            for text in b.column("text").to_pylist():
                both = [(m, n) for m, n in zip(*line_marks(text), strict=True) if n]
                m, n = [x[0] for x in both], [x[1] for x in both]
                prints.append([{"print": p, "place": i, "windows": [{"begin": a, "end": z, "window": w} for a, z, w in found]} for p, i, found in windows(m, n, least)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(prints, pa.list_(PRINT))], ["doc_id", "tie", "prints"])

    return rows.mapInArrow(tidy(marked), f"doc_id {kind}, tie long, prints array<struct<print: long, place: int, windows: array<struct<begin: int, end: int, window: long>>>>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per document that has any: doc_id, tie (its text's hash) and gone (sorted places,
    among its worded lines, of those to delete)."""
    ship_code(docs.sparkSession)
    table = settled(line_table(docs, id_col, text_col, least))
    prints = table.select("doc_id", "tie", F.explode("prints").alias("p")).select("doc_id", "tie", "p.print", "p.windows")
    # 1. Fingerprints that occur at several positions.
    shared = settled(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"))
    met = settled(prints.join(hinted(shared, BROADCAST_PRINTS), "print"))
    # 2. Their windows, as far as these occur before.
    around = met.select("doc_id", "tie", "print", F.explode("windows").alias("w")).select("doc_id", "tie", "print", "w.begin", "w.end", "w.window")
    spot = F.struct("doc_id", "tie", "begin")
    firsts = settled(around.groupBy("print", "window").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("print", "window", "first"))
    later = (
        around.join(firsts, ["print", "window"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")) & (F.col("begin") == F.col("first.begin"))))
        .select("doc_id", "tie", "begin", "end")
    )
    spans = F.collect_set(F.struct("begin", "end"))
    return later.groupBy("doc_id", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["begin"], x["end"]))))).alias("gone"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs, every column as it was, with __sl_text (the text without repeated runs),
    __sl_lines (worded lines deleted) and __sl_words (their words)."""
    gone = repeated_lines(docs, id_col, text_col, least).withColumnsRenamed({"doc_id": "__sl_id", "tie": "__sl_tie", "gone": "__sl_gone"})
    gone = settled(gone)
    marked = docs.withColumn("__sl_hash", F.xxhash64(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col("__sl_id")) & (F.col("__sl_hash") == F.col("__sl_tie"))
    # Only texts that lose lines move and go through Python, where their ids can be broadcast.
    ids = gone.select("__sl_id", "__sl_tie")
    if small_enough(ids, BROADCAST_IDS):
        losing, same = marked.join(F.broadcast(ids), on, "left_semi").join(gone, on), marked.join(F.broadcast(ids), on, "left_anti")
    else:
        joined = marked.join(gone, on, "left")
        losing, same = joined.where("__sl_gone IS NOT NULL"), joined.where("__sl_gone IS NULL")
    extra = ["__sl_id", "__sl_tie", "__sl_hash", "__sl_gone"]

    @F.arrow_udf("struct<text string, lines long, words long>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            lines, drop, left, place, words = text.split("\n"), set(gone), [], 0, 0
            for line in lines:
                if n := len(line.split()):
                    if place in drop:
                        words += n
                    else:
                        left.append(line)
                    place += 1
                else:
                    left.append(line)
            whole = "\n".join(left)
            out.append({"text": whole if whole.strip() else "", "lines": len(drop), "words": words})
        return pa.array(out, pa.struct([("text", pa.string()), ("lines", pa.int64()), ("words", pa.int64())]))

    changed = losing.withColumn("__sl_cut", cut(F.col(text_col), F.col("__sl_gone")))
    changed = changed.withColumns({"__sl_text": F.col("__sl_cut.text"), "__sl_lines": F.col("__sl_cut.lines"), "__sl_words": F.col("__sl_cut.words")}).drop("__sl_cut", *extra)
    same = same.drop(*extra).withColumns({"__sl_text": F.col(text_col), "__sl_lines": F.lit(0).cast("long"), "__sl_words": F.lit(0).cast("long")})
    return changed.unionByName(same)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, least: int = LEAST) -> DataFrame:
    """docs with later repeated runs deleted from the text. Documents of which nothing
    is left go, those that had no words before stay. length_col, if named, is set to
    the new text's length."""
    cut = without_lines(docs, id_col, text_col, least).where((F.col("__sl_lines") == 0) | (F.col("__sl_text") != ""))
    out = {text_col: F.col("__sl_text")} | ({length_col: F.when(F.col("__sl_lines") == 0, F.col(length_col)).otherwise(F.length("__sl_text"))} if length_col else {})
    return cut.withColumns(out).select(*docs.columns)
