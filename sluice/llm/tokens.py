"""Token counts of a byte-level BPE vocabulary with word ends, merged in numpy.

Text parts at white space; each part is normalised and cut into pre-tokens by the
vocabulary's pattern. Pre-tokens not seen before are encoded together: their
symbols stand one after another in one array, with the start of each sequence
beside it. In a round every sequence finds its pair of lowest rank and replaces
all its occurrences at once, from the left where they overlap; sequences without
a known pair leave. The symbols that survive are the tokens. A pair that holds a
merged symbol always ranks after the merge that made the symbol, so the rounds
give what merging one pair at a time gives.

Sequences of more than LONG symbols take their rounds each on its own, as they have
many: their pairs wait by rank, and a round looks up only the pairs beside its merges,
so that all rounds together take little more time than the symbols there are.

Counts are kept per part in a cache of the Python worker, bounded in entries and
characters.

Defined cases: a null text counts as empty and has 0 bytes and tokens. Special
strings inside texts are found before normalising and count as one token each, as
the library does by default. Rows are independent, so repeated rows, ties and null
ids need no care; an empty table gives an empty result; extra columns of the input
are ignored. Texts are held a batch at a time.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache, ship_code, tidy

#: White space as the vocabulary's normaliser has it.
SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() also parts at these, which the vocabulary takes as symbols.
SEPARATOR_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
CACHE_PARTS, CACHE_CHARS = 1_000_000, 32_000_000
#: Symbols of a sequence that is merged on its own.
LONG = 400
OVER = 2048
NEVER = np.int64(1) << 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankMerger:
    """Counts what a vocabulary file with merges makes of texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = byte_symbols()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([(a << 20) | b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([m for _, _, m in pairs], dtype=np.int64)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.space = regex.compile(f"[{SPACE_CLASS}]+")
        self.counts: dict[str, int] = {}  # by part of text
        self.words: dict[str, int] = {}  # by pre-token
        self.held = 0  # characters in both

    def pretokens(self, section: str) -> list[str]:
        text = section if section.isascii() else unicodedata.normalize("NFC", section)
        # Letter by letter: str.lower() looks around a final sigma, the vocabulary doesn't.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return [text] if text.isalpha() else self.pattern.findall(text)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each of the words (none empty) is left with."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= LONG)
        if len(short):
            out[short] = self.merge_together([words[i] for i in short.tolist()])
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.merge_alone(words[i])
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_alone(self, word: bytes) -> int:
        """How many symbols a long word is left with: a chain of symbols, whose pairs wait
        by rank. What has changed since a pair was put there is seen by its rank."""
        data = np.frombuffer(word, np.uint8)
        n = len(data)
        symbols = self.inner[data]
        symbols[-1] = self.final[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(n + 1, NEVER)  # of the pair that begins at a place; the last has none
        ranks[: n - 1] = self.pair_ranks(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] < NEVER]
            places = places[np.argsort(ranks[places], kind="stable")]
            own = ranks[places]
            for part in np.split(places, np.flatnonzero(np.diff(own)) + 1) if len(places) else ():
                rank = int(ranks[part[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        wait(np.arange(n - 1))
        left = n
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[ranks[places] == rank]
            if not len(places):
                continue
            # Of pairs that overlap (x x x), every second one from the left.
            head = np.r_[True, after[places[:-1]] != places[1:]]
            number = np.arange(len(places))
            first = np.maximum.accumulate(np.where(head, number, 0))
            places = places[(number - first) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[rank]
            ranks[gone] = NEVER
            after[places] = after[gone]
            inside = after[places] < n
            before[after[places[inside]]] = places[inside]
            left -= len(places)
            beside = np.unique(np.r_[places, before[places][before[places] >= 0]])
            follower = after[beside]
            ends = follower >= n
            ranks[beside] = np.where(ends, NEVER, self.pair_ranks(symbols[beside], symbols[np.where(ends, 0, follower)]))
            wait(beside)
        return left

    def merge_together(self, words: list[bytes]) -> np.ndarray:
        """merge for words of which none is long."""
        n = len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(length)
        symbols[ends - 1] = self.final[data[ends - 1]]
        out = length.copy()
        who = np.repeat(np.arange(n), length)  # the word of each symbol still in play
        while len(symbols) > 1:
            rank = np.where(who[:-1] == who[1:], self.pair_ranks(symbols[:-1], symbols[1:]), NEVER)
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NEVER], starts)
            size = np.diff(np.r_[starts, len(who)])
            hit = np.r_[(rank == np.repeat(best, size)[:-1]) & (rank < NEVER), False]
            # Of pairs that overlap (x x x), every second one from the left.
            run = np.flatnonzero(hit)
            if not len(run):
                break
            head = np.r_[True, np.diff(run) != 1]
            first = run[np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))]
            run = run[(run - first) % 2 == 0]
            symbols[run] = self.made[rank[run]]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[run + 1] = True
            np.subtract.at(out, who[run], 1)
            # Words without a known pair are done.
            live = np.repeat(best < NEVER, size) & ~gone
            symbols, who = symbols[live], who[live]
        return out

    def learn(self, parts: set[str]) -> None:
        """Fills the cache for parts of text without white space."""
        plan: list[tuple[str, int, list[str]]] = []
        for part in parts:
            sections, fixed = [part], 0
            if "<|" in part:
                fixed = len(self.special.findall(part))
                sections = self.special.split(part)
            plan.append((part, fixed, [w for s in sections if s for w in self.pretokens(s)]))
        known = self.words
        fresh = list({w for _, _, words in plan for w in words}.difference(known))
        if fresh:
            known.update(zip(fresh, self.merge([w.encode() for w in fresh]).tolist(), strict=True))
            self.held += sum(map(len, fresh))
        self.held += sum(map(len, parts))
        for part, fixed, words in plan:
            self.counts[part] = fixed + (known[words[0]] if len(words) == 1 else sum(map(known.__getitem__, words)))

    def parts(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATOR_CONTROLS):
            return [p for p in self.space.split(text) if p]
        return text.split()

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        done = 0
        while done < len(texts):
            # So many texts at a time that the parts in hand stay bounded.
            batch, size = [], 0
            while done < len(texts) and size < 500_000:
                batch.append(self.parts(texts[done]))
                size += len(texts[done])
                done += 1
            if max(len(self.counts), len(self.words)) > CACHE_PARTS or self.held > CACHE_CHARS:
                self.counts.clear()
                self.words.clear()
                self.held = 0
            unseen = set().union(*batch).difference(self.counts)
            if unseen:
                self.learn(unseen)
            out += [sum(map(self.counts.__getitem__, parts)) for parts in batch]
        return out


def merger(path: str) -> RankMerger:
    cache = process_cache("rank_mergers")
    if path not in cache:
        cache[path] = RankMerger(path)
    return cache[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, over: int = OVER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `over`)."""
    ship_code(docs.sparkSession)
    path = path or default_tokenizer()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            counts = m.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(counted, "rank_mergers"), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > over)
