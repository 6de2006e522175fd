"""Phrases that keep company: n-grams mined by SON partitioning, scored by their weakest cut.

Phrases are runs of 1 to LONGEST words within a piece of text (between punctuation marks or
line ends), counted per language.

1. Documents are dealt into SHARDS shards by hash. A phrase with `support` occurrences in a
   language has at least its share of them in some shard: support times the shard's share
   of the language's words, rounded up. Each shard is mined completely at that lowered
   support: words, then pairs of locally frequent words, then longer runs in which all
   pairs are locally frequent. Counts are partial sums of 64-bit hashes.
2. The union of all shards' locally frequent phrases are the candidates.
3. All candidates are counted exactly over all documents. A shard that has counted a
   candidate has counted all its occurrences there, so its sum is taken from step 1; one
   pass over the documents counts the candidates in the shards whose mining passed them
   over. Those that have `support` occurrences stay.
4. They are spelled from samples of the documents, which grow until each is found. So no
   task sends on a row for every phrase that is frequent elsewhere.

What a step needs of the one before it, which phrases are frequent, reaches the tasks as
a Bloom filter of BLOOM_BITS bits, whatever their number. A filter lets some others
pass, never fewer; these are counted in vain and don't reach the result. A shard is a number
in the key of a sum, not a task: any number of tasks mine it, and none holds it. Phrases are
told apart by 64-bit hashes, seeded by language: of F frequent phrases among D different ones,
some two share one with a probability of F * D / 2**64.

Defined cases: a null text has no words, a null language is `und`. Null ids need no care;
rows that repeat are documents of their own. Ties in score and count are broken by the
phrase's bytes, ties of cuts by the shortest first part. An empty table gives an empty
result. Extra columns are ignored. Long texts are held a few at a time, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_per_group
from .common import hinted, settled, ship_code, text_bytes, tidy
from .neardup import BYTE_VALUES, PLACES, POWER, mixed, parts

SHARDS, LONGEST, SUPPORT, TOP = 4, 5, 100, 2000
UND = "und"
#: Bits of a filter (8 MB); it is full of use up to some ten million phrases.
BLOOM_LOG, BLOOM_HASHES = 26, 4
BLOOM_BITS = 1 << BLOOM_LOG
#: Language codes share so many cells, so that thresholds are at most CELLS * SHARDS rows. Languages that share a cell have the lower of their thresholds.
CELLS = 4096
#: Phrases counted together before their sums are sent on, and hashes that a task remembers to have spelled.
HELD, HELD_PHRASES = 2_000_000, 500_000
#: Phrases are spelled from every 64th document, then those not found there from every 8th, then from all.
SAMPLES = (64, 8, 1)
#: Frequent phrases are broadcast up to this many (about 100 bytes each).
BROADCAST_PHRASES = 200_000
#: A word, for counting alone: what neither parts words nor pieces.
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"

_random = np.random.default_rng(29)
PROBES = _random.integers(1, 2**63, BLOOM_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CELL_FACTOR = np.uint64(0x9E3779B97F4A7C15)
GAP = np.isin(np.arange(256), [0x20, 0x09])
BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])


class Words:
    """The words of a column of texts: bytes in lower case, where each word begins and
    ends, the piece it lies in, and the row."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        cut = BREAK[data]
        out = GAP[data] | cut
        before = np.empty_like(out)
        before[1:] = out[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(before & ~out)
        self.data, self.out = data, out
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(cut, dtype=np.int64)[self.starts] + self.row
        # A word ends at a gap or with its text.
        stop = np.flatnonzero(out)
        at = np.searchsorted(stop, self.starts)
        ends = np.where(at < len(stop), stop[np.minimum(at, max(len(stop) - 1, 0))] if len(stop) else len(data), len(data))
        self.ends = np.minimum(ends, offsets[self.row + 1])

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = np.diff(np.r_[0, self.starts, len(self.data)])
        place = np.arange(len(self.data)) - np.repeat(np.r_[0, self.starts], size)
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, POWER, np.uint64))
        values = BYTE_VALUES[self.data] * powers[place]
        values[self.out] = 0
        return mixed(np.add.reduceat(values, self.starts))

    def runs(self, k: int) -> np.ndarray:
        """Which words begin a run of k words within a piece."""
        ok = np.zeros(len(self.starts), bool)
        if len(ok) >= k:
            ok[: len(ok) - k + 1] = self.piece[k - 1 :] == self.piece[: len(ok) - k + 1]
        return ok

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + k].tolist(), self.ends[at : at + k].tolist(), strict=True)).decode()


def phrase_hashes(words: np.ndarray, seeds: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Of 1 to longest words: sums, to be mixed, over the run that begins at each word
    (shorter by the words that none begins at). seeds tell languages apart."""
    total = seeds + words * PLACES[1]
    yield total
    for k in range(2, longest + 1):
        total = total[:-1] + words[k - 1 :] * PLACES[k]
        yield total


def language_seeds(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    seeds = np.array([xxhash.xxh3_64_intdigest((x or "").encode()) for x in coded.dictionary.to_pylist()] or [0], np.uint64)
    return seeds[coded.indices.to_numpy()]


def bits_of(keys: np.ndarray, probe: int) -> np.ndarray:
    return ((keys * PROBES[probe]) >> np.uint64(64 - BLOOM_LOG)).astype(np.int64)


def is_in(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that the filter lets pass."""
    at = np.arange(len(keys))
    for probe in range(BLOOM_HASHES):
        bit = bits_of(keys, probe)
        ok = (bloom[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        at, keys = at[ok], keys[ok]
    return at


def in_cell(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Keys for a filter, of hashes within their cells."""
    return hashes ^ (cells.astype(np.uint64) * CELL_FACTOR)


def filter_of(keys: DataFrame, by_cell: bool) -> np.ndarray:
    """A Bloom filter of the hashes in keys, each within its cell or alone."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("hash").to_numpy().view(np.uint64)
            own = in_cell(own, b.column("cell").to_numpy()) if by_cell else own
            bits = np.sort(np.concatenate([bits_of(own, k) for k in range(BLOOM_HASHES)]))
            index, first = np.unique(bits >> 6, return_index=True)
            longs = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(longs.view(np.int64))], ["at", "bits"])

    made = keys.select("hash", *["cell"][:by_cell]).mapInArrow(tidy(spread), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    # At most BLOOM_BITS / 64 rows.
    found = made.toArrow()
    bloom = np.zeros(BLOOM_BITS // 64, np.uint64)
    bloom[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bloom


def dealt(docs: DataFrame, id_col: str, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """(lang, cell, mark, text): a document's shard and mark follow from its id and text."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UND))
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    cell = F.pmod(F.xxhash64(lang), F.lit(CELLS)) * shards + F.pmod(own, F.lit(shards))
    mark = F.shiftrightunsigned(own, 32)
    return docs.select(lang.alias("lang"), cell.cast("int").alias("cell"), mark.alias("mark"), F.col(text_col).alias("text")).where("text IS NOT NULL")


#: A level of the mining: the lengths of its phrases, and a filter of the frequent runs (of
#: so many words) that all runs within such a phrase are found in; none for words.
Level = tuple[tuple[int, ...], int, np.ndarray | None]


def shard_counts(rows: DataFrame, levels: list[Level], candidates: np.ndarray | None = None) -> DataFrame:
    """(hash, cell, n), as partial sums: how often the phrases of these levels occur in each
    cell. With candidates: of those in that filter, the ones that their level leaves out there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def sums() -> pa.RecordBatch:
            found = [(cell, *np.unique(np.concatenate(own), return_counts=True)) for cell, own in held.items()]
            cells = np.repeat([cell for cell, _, _ in found], [len(h) for _, h, _ in found])
            arrays = (np.concatenate([h for _, h, _ in found]).view(np.int64), cells, np.concatenate([n for _, _, n in found]))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["hash", "cell", "n"])

        for b in (p for whole in batches for p in parts(whole)):
            # In order of the cells, so that each one's words lie together.
            b = b.take(pa.array(np.argsort(b.column("cell").to_numpy(), kind="stable")))
            w = Words(b.column("text"))
            if not len(w.starts):
                continue
            cell = b.column("cell").to_numpy()[w.row]
            seeds = language_seeds(b.column("lang"))[w.row]
            totals = list(phrase_hashes(w.hashes(), seeds, max(k for lengths, _, _ in levels for k in lengths)))
            for lengths, inner, bloom in levels:
                good = np.ones(len(w.starts), bool)
                if bloom is not None:
                    at = np.flatnonzero(w.runs(inner))
                    good[:] = False
                    good[at[is_in(bloom, in_cell(mixed(totals[inner - 1][at]), cell[at]))]] = True
                for k in lengths:
                    runs = w.runs(k)
                    ok = runs.copy()
                    for j in range(k - inner + 1):
                        ok[: len(ok) - j] &= good[j:]
                    at = np.flatnonzero(ok if candidates is None else runs & ~ok)
                    h = mixed(totals[k - 1][at])
                    if candidates is not None:
                        known = is_in(candidates, h)
                        at, h = at[known], h[known]
                    if len(at):
                        cuts = np.r_[0, np.flatnonzero(np.diff(cell[at])) + 1]
                        for c, own in zip(cell[at[cuts]].tolist(), np.split(h, cuts[1:]), strict=True):
                            held.setdefault(c, []).append(own)
                        size += len(at)
            if size >= HELD:
                yield sums()
                held, size = {}, 0
        if size:
            yield sums()

    return rows.select("lang", "cell", "text").mapInArrow(tidy(counted), "hash long, cell int, n long")


def spellings(rows: DataFrame, longest: int, bloom: np.ndarray) -> DataFrame:
    """(hash, lang, words, phrase) of the phrases in the filter; a task tells each about once."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for b in (p for whole in batches for p in parts(whole)):
            w = Words(b.column("text"))
            if not len(w.starts):
                continue
            seeds = language_seeds(b.column("lang"))[w.row]
            hashes, spots, lengths = [], [], []
            for k, total in enumerate(phrase_hashes(w.hashes(), seeds, longest), 1):
                at = np.flatnonzero(w.runs(k))
                h = mixed(total[at])
                ok = is_in(bloom, h)
                hashes.append(h[ok])
                spots.append(at[ok])
                lengths.append(np.full(len(ok), k))
            h, first = np.unique(np.concatenate(hashes), return_index=True)
            new = ~np.isin(h, known, assume_unique=True)
            h, spot, length = h[new], np.concatenate(spots)[first[new]], np.concatenate(lengths)[first[new]]
            known = np.union1d(known if len(known) < HELD_PHRASES else known[:0], h)
            langs = b.column("lang").to_pylist()
            texts = [w.text(s, k) for s, k in zip(spot.tolist(), length.tolist(), strict=True)]
            arrays = (h.view(np.int64), [langs[r] for r in w.row[spot].tolist()], length, texts)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["hash", "lang", "words", "phrase"])

    return rows.select("lang", "text").mapInArrow(tidy(told), "hash long, lang string, words int, phrase string")


def spelled(rows: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """(lang, words, phrase, n) of frequent, which has (hash, n)."""
    left, found = frequent, []
    for every in SAMPLES:
        sample = rows.where(F.col("mark") % every == 0)
        one = F.min(F.struct("lang", "words", "phrase")).alias("one")
        found.append(settled(spellings(sample, longest, filter_of(left, False)).groupBy("hash").agg(one).join(left, "hash").select("hash", "one.*", "n")))
        left = settled(left.join(found[-1].select("hash"), "hash", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).drop("hash")


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of at most `longest` words that occur
    `support` times or more in their language; and (lang, n): each language's words."""
    ship_code(docs.sparkSession)
    rows = dealt(docs, id_col, text_col, lang_col, shards)
    sizes = settled(rows.groupBy("lang", "cell").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("own")))
    totals = settled(sizes.groupBy("lang").agg(F.sum("own").alias("n")))
    # A whole number: the least count that a phrase frequent in the language has in some cell.
    share = F.expr(f"cast((cast(own as decimal(20,0)) * {support} + n - 1) div n as long)")
    in_shards = range(shards)
    row, shard = F.expr(f"cell div {shards}"), F.col("cell") % shards
    # At most CELLS rows: the thresholds of the cells' shards.
    least = sizes.where("own > 0").join(hinted(totals, BROADCAST_PHRASES), "lang").withColumn("least", F.greatest(share, F.lit(1)))
    least = settled(least.groupBy(row.alias("row")).agg(*[F.min(F.when(shard == s, F.col("least"))).alias(f"least_{s}") for s in in_shards]))

    def mined(counts: DataFrame) -> DataFrame:
        """(hash, n, cells): phrases that are frequent in some cells, and their counts in all."""
        own = counts.repartition("hash").groupBy("hash", row.alias("row")).agg(F.sum("n").alias("n"), *[F.sum(F.when(shard == s, F.col("n"))).alias(f"n_{s}") for s in in_shards])
        cells = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") >= F.col(f"least_{s}"), (F.col("row") * shards + s).cast("int")) for s in in_shards]))
        some = reduce(Column.__or__, [F.coalesce(F.col(f"n_{s}") >= F.col(f"least_{s}"), F.lit(False)) for s in in_shards])
        return settled(own.join(F.broadcast(least), "row").where(some).select("hash", "n", cells.alias("cells")))

    def local(found: DataFrame) -> np.ndarray:
        return filter_of(found.select("hash", F.explode("cells").alias("cell")), True)

    candidates = [mined(shard_counts(rows, [((1,), 0, None)]))]
    levels: list[Level] = []
    for inner, lengths in ((1, (2,)), (2, tuple(range(3, longest + 1)))):
        if longest > inner:
            levels.append((lengths, inner, local(candidates[-1])))
            candidates.append(mined(shard_counts(rows, levels[-1:])))
    union = reduce(DataFrame.unionByName, candidates).select("hash", "n")
    if levels:
        rest = shard_counts(rows, levels, filter_of(union, False)).groupBy("hash").agg(F.sum("n").alias("more"))
        union = union.join(rest, "hash", "left").select("hash", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return spelled(rows, settled(union.where(F.col("n") >= support)), longest), totals


def all_parts(words: Column, n: Column) -> Column:
    """The phrases of two words and more within a phrase of n words, itself left out."""
    inside = F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))
    return F.when(n > 2, F.array_distinct(F.flatten(inside))).otherwise(F.array().cast("array<string>"))


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more that lie in no
    longer one of the same count. l, r: the parts at the cut of the lowest score."""
    words = F.split("phrase", " ")
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), words.alias("w"))
    inside = candidates.select("lang", F.explode(all_parts(F.col("w"), F.col("words"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ").alias("tail"))
    known = hinted(settled(frequent.select("lang", "phrase", "n")), BROADCAST_PHRASES)
    head, tail = (known.select("lang", F.col("phrase").alias(at), F.col("n").alias(name)) for at, name in (("head", "l"), ("tail", "r")))
    both = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(hinted(totals, BROADCAST_PHRASES), "lang")
    exact = F.expr("cast((cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    best = F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, **how) -> DataFrame:
    """Each language's first `top` phrases: lang, rank (from 1), phrase, a, l, r, n, score."""
    rows = scored(*frequent_phrases(docs, id_col, text_col, lang_col, **how))
    best = top_per_group(rows, ["lang"], [("score", True), ("a", True), ("phrase", False)], top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
