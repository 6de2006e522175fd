"""Near-duplicate groups by MinHash and a multi-index Hamming join.

A document's set holds the 64-bit hashes of its distinct word shingles. Its
signature has SYMBOLS b-bit symbols, one per MinHash function. Two sets of
similarity 0.8 differ in a fifth of the symbols on average, and in more than
LIMIT = 19 of 40 about once in 100,000 times.

The signature is split into CHUNKS chunks of WIDE symbols. By the pigeonhole
principle two signatures that differ in at most LIMIT = CHUNKS * (ERRORS + 1) - 1
symbols have a chunk that differs in at most ERRORS = 1 of its symbols. For each
chunk a document therefore has a key per place of the allowed error, which leaves
that place out: any two signatures within LIMIT share a key, without fail.

Documents with the same set are one node, the class, and only classes are
compared. Candidates are confirmed on full sets in three steps, of which each one
skips what is connected already, so that large groups don't cost all their pairs:
1. every class with the nearest first member of its keys;
2. for each two groups that still meet under a key within LIMIT, their nearest pair;
3. all pairs that meet under a key within LIMIT and still lie in different groups.
In 2 and 3 a pair is left out if its sets can't be similar enough: two sets share
at most the shingles that are not in one of them alone, and none whose bit the other
set's bitmap lacks. That spares the pairs of groups whose members are all near one
text but not near each other, and drops no link.
Whatever step 3 leaves unconfirmed is not a link, so the groups are those of all
links. Groups are found by contraction of the links, in tables.

Defined cases: a document without words, or with a null text, has an empty set and
is linked with nothing. A document of fewer words than a shingle has its whole
sequence as its only shingle. Rows with a null id get a null component_id and kept
null (they stay). Rows that repeat an id are one node with all their sets and get
the same component_id. An empty table gives an empty result. Extra columns of the
input are ignored by near_groups and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, let_go, settled, ship_code, text_bytes, tidy, word_starts
from .graph import components

SYMBOLS, CHUNKS, ERRORS = 40, 10, 1
WIDE = SYMBOLS // CHUNKS
LIMIT = CHUNKS * (ERRORS + 1) - 1
#: Keys are made of SYMBOL_BITS-bit symbols; distances are counted on their low 8 bits, which never exceeds them.
SYMBOL_BITS = 16
SIMILAR_PERCENT = 80
#: Ids of documents that take part in a candidate pair are broadcast up to this many (8 bytes each).
BROADCAST_IDS = 500_000
#: Pairs of one document that are confirmed by one task at most, each group with its own copy of that document's set.
GROUP = 512
#: Keys that several classes have are broadcast up to this many (8 bytes each).
BROADCAST_KEYS = 500_000
#: Bytes of text that are hashed together.
PART_BYTES = 500_000

_random = np.random.default_rng(11)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
FACTORS = _random.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts: the hashes of all their shingles, and where each text's begin (with the end)."""
    data, offsets = text_bytes(column)
    starts = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # A word's bytes, each times a power by its place in the word, summed.
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, POWER, np.uint64))
    values = BYTE_VALUES[data] * powers[place]
    values[space] = 0
    words = mixed(np.add.reduceat(values, starts))
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begins = np.r_[0, np.cumsum(size)]
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], size) + np.repeat(first[:-1], size)
    spans = np.repeat(np.minimum(count, width), size)
    out = spans.astype(np.uint64) * PLACES[0]
    for k in range(width):
        inside = spans > k
        out[inside] += words[at[inside] + k] * PLACES[k + 1]
    return mixed(out), begins


def parts(b: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text (or one row)."""
    _, offsets = text_bytes(b.column(column))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
        yield b.slice(at, end - at)
        at = end


def distinct_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, but sorted and without repeats within a text."""
    hashes, begins = shingles(column, width)
    sets = [np.unique(hashes[a:z]) for a, z in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def set_marks(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set that don't depend on its order."""
    def total(x: np.ndarray) -> np.ndarray:
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]
        return mixed(sums[begins[1:]] - sums[begins[:-1]])

    return total(mixed(sets ^ FLIPS[0])).view(np.int64), total(mixed(sets ^ FLIPS[1])).view(np.int64)


def signatures(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS symbols for sets that aren't empty."""
    out = np.empty((len(begins) - 1, SYMBOLS), np.uint64)
    for k in range(SYMBOLS):
        out[:, k] = np.minimum.reduceat((sets ^ FLIPS[k]) * FACTORS[k], begins[:-1])
    return mixed(out) & np.uint64((1 << SYMBOL_BITS) - 1)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Per signature its CHUNKS * WIDE keys, each a chunk without one place."""
    keys = []
    for c in range(CHUNKS):
        chunk = symbols[:, c * WIDE : (c + 1) * WIDE]
        for hole in range(WIDE):
            key = np.full(len(symbols), c * WIDE + hole + 1, np.uint64) * PLACES[9]
            for k in range(WIDE):
                if k != hole:
                    key += (chunk[:, k] + np.uint64(1)) * PLACES[10 + k]
            keys.append(mixed(key))
    return np.stack(keys, axis=1).view(np.int64)


BITS = 1024
BIT_LONGS = [f"b{k}" for k in range(BITS // 64)]
LONGS = [f"s{k}" for k in range(SYMBOLS // 8)]
SIGNED = f"n long, h1 long, h2 long, {', '.join(f'{s} long' for s in LONGS)}, keys array<long>"


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per document: doc_id, n (set size), h1, h2 (marks of the set), s0.. (the
    signature's low bytes, 8 in a long), keys (null for an empty set)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            sets, begins = distinct_sets(b.column("text"), width)
            n = np.diff(begins)
            some = np.flatnonzero(n > 0)
            h1, h2 = set_marks(sets, begins)
            low = np.zeros((len(n), SYMBOLS), np.uint8)
            keys = np.zeros((0, CHUNKS * WIDE), np.int64)
            if len(some):
                symbols = signatures(sets, np.r_[begins[:-1][some], begins[-1]])
                low[some] = symbols.astype(np.uint8)
                keys = chunk_keys(symbols)
            ends = np.r_[0, np.cumsum(n > 0)] * (CHUNKS * WIDE)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
            longs = low.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(LONGS))), lists],
                ["doc_id", "n", "h1", "h2", *LONGS, "keys"],
            )

    return rows.mapInArrow(tidy(sign), f"doc_id {kind}, {SIGNED}")


def distance(a: str, b: str) -> Column:
    """How many of the signatures' low bytes differ."""
    total = F.lit(0)
    for s in LONGS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(0x0101010101010101))
    return total


def sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent


def bitmaps(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per set BITS bits, as longs, of which each element sets one."""
    out = np.zeros((len(begins) - 1, BITS), bool)
    out[np.repeat(np.arange(len(begins) - 1), np.diff(begins)), (mixed(sets ^ FLIPS[2]) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.int64)


def bounded(open_sets: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per rep of open_sets what bounds the shingles that it shares with others among
    them: common (its shingles that any other of them has) and a bitmap of its set; or
    several, if it stands for several sets: then neither bounds anything."""
    ids = settled(open_sets.select("rep").distinct().join(classes.select("rep", "h1"), "rep"))
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(hinted(ids, BROADCAST_IDS), "rep").select("rep", "h1", "text")
    kind = texts.schema["rep"].dataType.simpleString()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            sets, begins = distinct_sets(b.column("text"), width)
            # An id that is repeated brings other texts along; the mark tells which is meant.
            meant = pa.array(set_marks(sets, begins)[0] == b.column("h1").to_numpy())
            bits = bitmaps(sets, begins)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("h1"), lists, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(BIT_LONGS)))], ["rep", "h1", "shingles", *BIT_LONGS]
            ).filter(meant)

    spelled_out = settled(texts.mapInArrow(tidy(spelled), f"rep {kind}, h1 long, shingles array<long>, {', '.join(f'{c} long' for c in BIT_LONGS)}"))
    # Rows that repeat an id and a set count twice, which leaves a bound that is too high, and safe.
    once = spelled_out.select("rep", "h1", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("rep").alias("rep"), F.min("h1").alias("h1"), F.count(F.lit(1)).alias("sets")).where("sets = 1")
    own = once.groupBy("rep", "h1").agg(F.count(F.lit(1)).alias("own"))
    each = spelled_out.select("rep", "h1", F.size("shingles").alias("size"), *BIT_LONGS).join(own, ["rep", "h1"], "left")
    common = F.max(F.col("size") - F.coalesce("own", F.lit(0))).alias("common")
    return each.groupBy("rep").agg((F.min("h1") != F.max("h1")).alias("several"), common, *[F.max(c).alias(c) for c in BIT_LONGS])


def most_shared(a: str, b: str) -> Column:
    """What two sets can share at most. An element whose bit the other set lacks isn't shared."""
    only_a, only_b = F.lit(0), F.lit(0)
    for c in BIT_LONGS:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        only_a = only_a + F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
        only_b = only_b + F.bit_count(y.bitwiseAND(F.bitwise_not(x)))
    return F.least(F.col(f"{a}.n") - only_a, F.col(f"{b}.n") - only_b, f"{a}.common", f"{b}.common")


def shipped_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, h, set) of the documents whose (id, h) are in wanted: a set's sorted hashes
    as bytes. An id that is repeated with other texts has a row for each."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(hinted(wanted.select("id").distinct(), BROADCAST_IDS), "id", "left_semi")
    kind = texts.schema["id"].dataType.simpleString()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            sets, begins = distinct_sets(b.column("text"), width)
            marks = set_marks(sets, begins)[0]
            # Rows that repeat an id and a set are one.
            first = sorted({x: k for k, x in reversed(list(enumerate(zip(b.column("id").to_pylist(), marks.tolist(), strict=True))))}.values())
            raw = [sets[begins[k] : begins[k + 1]].tobytes() for k in first]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(first, pa.int64())), pa.array(marks[first]), pa.array(raw, pa.binary())], ["id", "h", "set"])

    return texts.mapInArrow(tidy(spelled), f"id {kind}, h long, set binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Of pairs (u, v) of classes, those whose full sets are similar enough.

    A pair is turned so that u is the end with more pairs. Its set then goes once to
    each GROUP of its pairs, and of a pair only v's set moves, as hashes: no text, and
    no hub's set for every one of its partners.
    """
    ends = pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))
    marks = settled(ends.join(classes.select(F.col("rep").alias("id"), F.col("h1").alias("h")), "id"))
    u, v = (marks.select(F.col("id").alias(x), F.struct("id", "h", "pairs").alias(f"{x}_")) for x in "uv")
    both = pairs.select("u", "v").join(u, "u").join(v, "v")
    more = (F.col("u_.pairs") > F.col("v_.pairs")) | ((F.col("u_.pairs") == F.col("v_.pairs")) & (F.col("u") < F.col("v")))
    turned = both.select(F.when(more, F.col("u_")).otherwise(F.col("v_")).alias("hub"), F.when(more, F.col("v_")).otherwise(F.col("u_")).alias("leaf"))
    group = F.pmod(F.xxhash64("leaf.id"), F.ceil(F.col("hub.pairs") / GROUP)).alias("part")
    turned = settled(turned.select(F.col("hub.id").alias("hub"), F.col("hub.h").alias("mark"), group, F.col("leaf.id").alias("id"), F.col("leaf.h").alias("h")))
    hubs = turned.select("hub", "mark", "part", F.lit(False).alias("other"), F.col("hub").alias("id"), F.col("mark").alias("h")).distinct()
    needed = settled(hubs.unionByName(turned.withColumn("other", F.lit(True))))
    rows = needed.join(shipped_sets(docs, marks, id_col, text_col, width), ["id", "h"]).select("hub", "mark", "part", "other", "id", "set")
    dealt = rows.repartition("hub", "mark", "part").sortWithinPartitions("hub", "mark", "part", "other")
    kind = rows.schema["id"].dataType.simpleString()

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            others, sets = b.column("other").to_pylist(), b.column("set")
            for k, other in enumerate(others):
                own = np.frombuffer(sets[k].as_buffer(), np.uint64)
                if not other:
                    mine = own.copy()
                elif min(len(own), len(mine)) * 100 >= percent * max(len(own), len(mine)):
                    # Of a shared hash the merged row has two, side by side.
                    merged = np.concatenate([own, mine])
                    merged.sort(kind="stable")
                    shared = int((merged[1:] == merged[:-1]).sum())
                    keep[k] = 100 * shared >= percent * (len(merged) - shared)
            yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("id")], ["u", "v"]).filter(pa.array(keep))

    return dealt.mapInArrow(tidy(similar), f"u {kind}, v {kind}")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    ship_code(docs.sparkSession)
    table = settled(signed(docs, id_col, text_col, width))
    some = table.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = F.min(F.struct("doc_id", *LONGS, "keys")).alias("first")
    classes = settled(some.groupBy("h1", "h2", "n").agg(first).select("h1", "h2", "n", F.col("first.doc_id").alias("rep"), *[F.col(f"first.{s}").alias(s) for s in LONGS], F.col("first.keys").alias("keys")))
    sign = classes.select("rep", "n", *LONGS)
    members = table.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
    # An id whose rows have different sets joins their classes.
    several = settled(members.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("m")).where("u <> m").select("doc_id", "u"))
    links = settled(members.join(hinted(several, BROADCAST_IDS), "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct())

    keys = classes.select(F.explode("keys").alias("key"), "rep")
    shared = settled(keys.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key"))
    sharing = settled(keys.join(hinted(shared, BROADCAST_KEYS), "key"))
    # Kept apart from the join, so that a hot key's partition can be split.
    pivots = settled(sharing.groupBy("key").agg(F.min("rep").alias("pivot")))
    met = sharing.join(hinted(pivots, BROADCAST_KEYS), "key")

    def near(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) within the limit, with their distance."""
        u, v = (sign.select(F.col("rep").alias(x), F.struct("n", *LONGS).alias(f"{x}_")) for x in "uv")
        both = pairs.join(u, "u").join(v, "v").where(sizes_allow("u_", "v_", percent))
        return both.select("u", "v", distance("u_", "v_").alias("d")).where(F.col("d") <= LIMIT)

    def confirm(pairs: DataFrame) -> DataFrame:
        let_go(docs.sparkSession)
        return confirmed(pairs, classes, docs, id_col, text_col, width, percent)

    def labelled(frame: DataFrame, labels: DataFrame, at: str, name: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(at), F.col("label").alias(name)), at, "left").withColumn(name, F.coalesce(name, at))

    # 1. Every class with the nearest of its keys' first members.
    to_pivots = near(met.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct())
    done = settled(to_pivots.groupBy("v").agg(F.min(F.struct("d", "u")).alias("to")).select(F.col("to.u").alias("u"), "v"))
    links = settled(links.unionByName(confirm(done)))
    labels = components(links)

    # What still meets under a key within the limit, in different groups.
    grouped = labelled(sharing, labels, "rep", "label")
    open_keys = grouped.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    x = settled(grouped.join(open_keys, "key", "left_semi"))
    let_go(docs.sparkSession)
    bounds = bounded(x, classes, docs, id_col, text_col, width)
    # Columns known not to be null keep the compiled comparison small enough to be fast.
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "common", *LONGS, *BIT_LONGS)] + [F.coalesce("several", F.lit(True)).alias("several")]
    # Similar sets share percent of either set at least: a class that has fewer shingles
    # in common with all others together is linked with none, and is compared with none.
    able = bounds.join(sign.select("rep", "n"), "rep").where(F.col("several") | (F.col("common") * 100 >= F.col("n") * percent)).drop("n")
    theirs = x.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    x = settled(x.join(sign, "rep").join(able, "rep").join(theirs, "rep").select("key", "rep", "label", "keys", *numbers))
    still = x.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    x = settled(x.join(still, "key", "left_semi"))
    a, b = x.alias("a"), x.alias("b")
    # Similar sets share percent / (100 + percent) of both sizes together.
    may_share = F.col("a.several") | F.col("b.several") | (most_shared("a", "b") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.label") != F.col("b.label"))
    # A pair that meets under several keys counts at the least of them.
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    meeting = a.join(b, apart & sizes_allow("a", "b", percent) & (distance("a", "b") <= LIMIT) & may_share & once)
    waiting = settled(
        meeting.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"), F.col("a.label").alias("lu"), F.col("b.label").alias("lv"), distance("a", "b").alias("d"))
        .distinct()
        .join(done.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    )
    if not waiting.isEmpty():
        # 2. The nearest pair of each two groups.
        between = [F.least("lu", "lv").alias("la"), F.greatest("lu", "lv").alias("lb")]
        nearest = settled(waiting.groupBy(*between).agg(F.min(F.struct("d", "u", "v")).alias("to")).select("to.u", "to.v"))
        links = settled(links.unionByName(confirm(nearest)))
        labels = components(links)
        # 3. All pairs that are still apart.
        rest = waiting.select("u", "v").join(nearest, ["u", "v"], "left_anti")
        rest = settled(labelled(labelled(rest, labels, "u", "lu"), labels, "v", "lv").where("lu <> lv").select("u", "v"))
        if not rest.isEmpty():
            labels = components(settled(links.unionByName(confirm(rest))))

    found = members.join(hinted(labels.select(F.col("node").alias("rep"), "label"), BROADCAST_IDS), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group, the one with the least id; rows without an id stay."""
    gone = near_groups(docs, id_col, text_col, **how).where("NOT kept").select(F.col("doc_id").alias("__sl_id")).distinct()
    left = docs.join(hinted(settled(gone), BROADCAST_IDS), F.col(id_col) == F.col("__sl_id"), "left_anti")
    return left
