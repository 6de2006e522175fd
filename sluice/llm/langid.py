"""Language identification of words and documents by a linear-chain CRF.

Every word with a letter gets a label, a language. A word speaks for labels by
hashed features (its character 1- to 3-grams with word ends marked, hence its
affixes too, and longer prefixes and suffixes) and by the languages whose lexicon
has it; neighbours speak for each other by learned transitions. Labels are summed
over all sequences by forward-backward, so that a word in code-switched text gets
the probability of each language there; a document's language is the one with the
greatest mean probability over its words, which is the score.

Forward-backward is exact and runs on blocks of BLOCK words at once: each block is
first reduced to one transfer matrix, entries and exits of blocks are then carried
along the documents, and last all blocks are filled in together.

Training maximises the CRF's likelihood on a bounded sample: of each language the
PER_LANGUAGE labelled documents whose ids have the least hashes, whole texts, as far as
they fit its share of MOST_CHARS; each word is labelled with its document's language.
However frequent other languages are, and however long their documents, a language
among the MOST_LANGUAGES most frequent has a document at least. A quarter of
the sample is spliced, two documents of different languages in turns of TURN words, so
that moves between languages are learned too. Weights start from the words'
smoothed log odds. Sampling and training take the same time at any input size.

Defined cases: a null text, or one without a letter, is `und` with score 0. A null
id isn't held out and isn't learned from. Rows are independent, so repeated rows
and ties need no care; of equal scores the first language by name wins. Without
labelled rows every document is `und`. An empty table gives an empty result. Extra
columns of the input are ignored by predict and kept by drop_unidentified.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.topk import top_per_group
from .common import let_go, process_cache, ship_code, tidy

UND = "und"
PER_LANGUAGE = 150
#: The sample's other bounds: labels, the most frequent first, and characters, which the labels share equally.
MOST_LANGUAGES, MOST_CHARS = 256, 1_500_000
#: Held out: crc32 of the id as text, modulo FOLDS, is HELD_OUT.
FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 15
BLOCK = 64
#: One in so many documents of a language is spliced with one of another, in turns of so many words.
SPLICED, TURN = 4, 25
STEPS = 12
LEARNING_RATE = 0.15
DECAY = 0.02
LEXICON = 3000
CACHE_WORDS = 300_000
#: Words whose features are found together.
PART_WORDS = 8000
#: A pipeline keeps documents whose language has at least this mean probability.
MIN_SCORE = 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)
EDGES = " \t.,;:!?\"'()[]{}<>#*$%&|-_/\\=+@0123456789"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def word_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, where each worded token's begin, which tokens have letters)."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    who = np.repeat(np.arange(len(tokens)), lengths)
    keep = letters()[points]
    points, who = points[keep].astype(np.uint64), who[keep]
    worded = np.unique(who)
    if not len(worded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), worded
    # Each word between the marks 2 and 3, all words in one row.
    size = np.bincount(who, minlength=len(tokens))[worded]
    begins = np.r_[0, np.cumsum(size + 2)]
    row = np.zeros(begins[-1], np.uint64)
    row[begins[:-1]], row[begins[1:] - 1] = 2, 3
    inner = np.arange(len(points)) + 2 * np.searchsorted(worded, who) + 1
    row[inner] = points
    ends = np.repeat(begins[1:], size + 2)
    at = np.arange(len(row))
    code = np.zeros(len(row), np.uint64)
    found, owner = [], []
    head = np.zeros(len(row), bool)
    head[begins[:-1]] = True
    for n in range(1, 5):
        inside = at + n <= ends
        code = np.where(inside, code * MIX + row[np.minimum(at + n - 1, len(row) - 1)] + np.uint64(n), 0)
        # All n-grams up to 3; of 4, those that begin or end the word.
        use = inside & ((n < 4) | head | (at + n == ends))
        hashed = code[use] ^ (code[use] >> np.uint64(29))
        found.append(((hashed * MIX) >> np.uint64(64 - 15)).astype(np.int64))
        owner.append(at[use])
    order = np.argsort(np.concatenate(owner), kind="stable")
    buckets, owner = np.concatenate(found)[order], np.concatenate(owner)[order]
    return buckets, np.searchsorted(owner, begins[:-1]), worded


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Of sequences end to end (first: where each begins, with the end), whose labels
    have scores and whose neighbours have moves: each word's label probabilities,
    and with pairs the expected number of each move."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(moves)
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    doc = np.repeat(np.arange(len(count)), blocks)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[doc] + rank * BLOCK
    size = np.minimum(BLOCK, first[doc + 1] - begin)
    opens = rank == 0
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")

    def step(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = order[: alive[t]]
        return b, e[begin[b] + t], opens[b]

    # 1. A transfer matrix per block; before a sequence's first word any label moves alike.
    whole = np.empty((len(doc), k, k))
    for t in range(BLOCK):
        b, et, op = step(t)
        if not len(b):
            break
        m = np.where(op[:, None, None], 1.0, a[None]) * et[:, None, :] if t == 0 else (whole[b] @ a) * et[:, None, :]
        whole[b] = m / m.sum(axis=(1, 2), keepdims=True)
    # 2. Along the documents, block by block.
    entry, leave = np.full((len(doc), k), 1.0 / k), np.ones((len(doc), k))
    at_rank = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[at_rank], np.arange(rank.max() + 2 if len(rank) else 1))
    for r in range(1, len(bounds) - 1):
        b = at_rank[bounds[r] : bounds[r + 1]]
        v = np.einsum("bi,bij->bj", entry[b - 1], whole[b - 1])
        entry[b] = v / v.sum(axis=1, keepdims=True)
    for r in range(len(bounds) - 2, 0, -1):
        b = at_rank[bounds[r] : bounds[r + 1]]
        v = np.einsum("bij,bj->bi", whole[b], leave[b])
        leave[b - 1] = v / v.sum(axis=1, keepdims=True)
    # 3. Within all blocks.
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    now = entry.copy()
    for t in range(BLOCK):
        b, et, op = step(t)
        if not len(b):
            break
        v = (np.where(op[:, None], 1.0, now[b] @ a) if t == 0 else now[b] @ a) * et
        now[b] = v / v.sum(axis=1, keepdims=True)
        alpha[begin[b] + t] = now[b]
    back = leave.copy()
    for t in range(BLOCK - 1, -1, -1):
        b, et, _ = step(t)
        if not len(b):
            continue
        beta[begin[b] + t] = back[b]
        v = (back[b] * et) @ a.T
        back[b] = v / v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not pairs:
        return gamma, None
    inner = np.ones(n, bool)
    inner[first[:-1][count > 0]] = False
    t = np.flatnonzero(inner)
    right = beta[t] * e[t]
    weight = 1.0 / np.maximum(np.einsum("ni,ij,nj->n", alpha[t - 1], a, right, optimize=True), 1e-300)
    return gamma, a * ((alpha[t - 1] * weight[:, None]).T @ right)


@dataclass
class Tagger:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    lexicon_weights: np.ndarray  # languages x languages
    moves: np.ndarray
    lexicon: dict[str, list[int]]
    mark: str = ""
    rows: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __reduce__(self):
        return Tagger, (self.languages, self.weights, self.lexicon_weights, self.moves, self.lexicon, self.mark)

    def learn_words(self, tokens: list[str]) -> None:
        """Adds tokens to the cache: the row of their label scores, or -1 without letters."""
        buckets, begins, worded = word_features(tokens)
        made = np.add.reduceat(self.weights[buckets], begins, axis=0) if len(worded) else np.zeros((0, len(self.languages)), np.float32)
        base = len(self.scores)
        row = np.full(len(tokens), -1)
        row[worded] = base + np.arange(len(worded))
        for i, k in enumerate(worded.tolist()):
            if known := self.lexicon.get(tokens[k].strip(EDGES)):
                made[i] += self.lexicon_weights[known].sum(axis=0)
        self.scores = np.concatenate([self.scores, made]) if base else made
        self.rows.update(zip(tokens, row.tolist(), strict=True))

    def word_probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all worded tokens, and where each text's begin."""
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.scores = {}, np.zeros((0, 0))
        split = [(t or "").lower().split() for t in texts]
        unseen = list(set().union(*split).difference(self.rows))
        for k in range(0, len(unseen), PART_WORDS):
            self.learn_words(unseen[k : k + PART_WORDS])
        rows = [[r for r in map(self.rows.__getitem__, tokens) if r >= 0] for tokens in split]
        first = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        if not first[-1]:
            return np.zeros((0, len(self.languages))), first
        flat = np.fromiter((r for part in rows for r in part), np.int64, first[-1])
        return forward_backward(self.scores[flat].astype(np.float64), first, self.moves)[0], first

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 250_000):
                size += len(texts[end] or "")
                end += 1
            p, first = self.word_probabilities(texts[at:end])
            # Each text is summed on its own, so that its score depends on it alone.
            n = np.diff(first)
            mass = np.zeros((len(n), len(self.languages)))
            if len(p):
                mass[n > 0] = np.add.reduceat(p, first[:-1][n > 0], axis=0)
            for m, k in zip(mass, n.tolist(), strict=True):
                best = int(m.argmax()) if k else 0
                yield (self.languages[best], min(1.0, max(0.0, float(m[best] / k)))) if k else (UND, 0.0)
            at = end


def spliced(seqs: list[np.ndarray], gold: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences of all words of seqs, and each word's label. Chosen documents of two
    labels take turns in one sequence; all others stay as they are."""
    turn, chosen = Counter(), []
    for i, g in enumerate(gold):
        turn[g] += 1
        if turn[g] % SPLICED == 0:
            chosen.append((turn[g], g, i))
    # Sorted by turn, neighbours are of different labels.
    chosen.sort()
    pairs = [(a[2], b[2]) for a, b in zip(chosen[::2], chosen[1::2], strict=False) if a[1] != b[1]]
    used = {i for pair in pairs for i in pair}
    words = [seqs[i] for i in range(len(seqs)) if i not in used]
    labels = [np.full(len(seqs[i]), gold[i]) for i in range(len(seqs)) if i not in used]
    for pair in pairs:
        parts = [(k // TURN, side, seqs[i][k : k + TURN], gold[i]) for side, i in enumerate(pair) for k in range(0, len(seqs[i]), TURN)]
        parts.sort(key=lambda x: x[:2])
        if parts:
            words.append(np.concatenate([x[2] for x in parts]))
            labels.append(np.concatenate([np.full(len(x[2]), x[3]) for x in parts]))
    return words, labels


def train(texts: list[str], labels: list[str]) -> Tagger | None:
    """A tagger from labelled texts, or None if no text has a word."""
    languages = sorted(set(labels))
    k = len(languages)
    split = [t.lower().split() for t in texts]
    vocabulary = list(dict.fromkeys(w for words in split for w in words))
    if not vocabulary:
        return None
    buckets, begins, worded = word_features(vocabulary)
    if not len(worded):
        return None
    number = dict(zip((vocabulary[i] for i in worded.tolist()), range(len(worded)), strict=True))
    seqs = [np.array([number[w] for w in words if w in number], np.int64) for words in split]
    seqs, gold_words = spliced(seqs, [languages.index(x) for x in labels])
    words, gold = np.concatenate(seqs), np.concatenate(gold_words)
    first = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
    # Counts of each word by language, features' smoothed log odds, lexicons.
    n_words = len(worded)
    counts = np.stack([np.bincount(words[gold == x], minlength=n_words) for x in range(k)], axis=1).astype(float)
    owner = np.repeat(np.arange(n_words), np.diff(np.r_[begins, len(buckets)]))

    def to_features(per_word: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(buckets, weights=per_word[owner, x], minlength=BUCKETS) for x in range(k)], axis=1)

    seen = to_features(counts)
    share = (seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS)
    logs = np.log(share)
    weights = (logs - logs.mean(axis=1, keepdims=True)) * 0.15
    lexicon: dict[str, list[int]] = {}
    for x in range(k):
        totals = Counter()
        for i in np.flatnonzero(counts[:, x] >= 3).tolist():
            totals[vocabulary[worded[i]].strip(EDGES)] += counts[i, x]
        for w, _ in totals.most_common(LEXICON):
            lexicon.setdefault(w, []).append(x)
    known = np.zeros((n_words, k))
    for i, v in enumerate(worded.tolist()):
        known[i, lexicon.get(vocabulary[v].strip(EDGES), [])] = 1.0
    lexicon_weights, moves = np.eye(k) * 0.5, np.eye(k) * 0.5
    # Gradient ascent with per-weight step sizes.
    states = [[weights, 0, 0], [lexicon_weights, 0, 0], [moves, 0, 0]]
    gold_moves = np.zeros((k, k))
    for g in gold_words:
        np.add.at(gold_moves, (g[:-1], g[1:]), 1)
    for step in range(1, STEPS + 1):
        word_scores = np.add.reduceat(weights[buckets], begins, axis=0) + known @ lexicon_weights
        gamma, expected = forward_backward(word_scores[words], first, moves, pairs=True)
        residual = counts - np.stack([np.bincount(words, weights=gamma[:, x], minlength=n_words) for x in range(k)], axis=1)
        slopes = [to_features(residual), known.T @ residual, gold_moves - expected]
        for state, slope in zip(states, slopes, strict=True):
            value, m, v = state
            slope = slope / len(words) - DECAY * value / BUCKETS
            state[1], state[2] = 0.8 * m + 0.2 * slope, 0.95 * v + 0.05 * slope**2
            value += LEARNING_RATE * (state[1] / (1 - 0.8**step)) / (np.sqrt(state[2] / (1 - 0.95**step)) + 1e-8)
    mark = hashlib.sha256(weights.tobytes() + moves.tobytes() + "\n".join(languages).encode()).hexdigest()
    return Tagger(languages, weights.astype(np.float32), lexicon_weights.astype(np.float32), moves, lexicon, mark)


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(text, lang): of each of the most_languages most frequent labels at most per_language
    different documents, from the folds that aren't held out, in the order of their ids'
    hashes as long as their whole texts fit the label's share of most_chars. A label of
    which no document fits that share gives its shortest one."""
    usable = docs.where((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.xxhash64(F.col(id_col), F.lit(7)).alias("place"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    names = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    if not names:
        return usable.select("text", "lang").limit(0)
    share = most_chars // len(names)
    # Which rows are taken is settled on narrow rows, a few per label and task; texts follow.
    over = F.greatest(F.length("text") - share, F.lit(0)).cast("long")
    spots = usable.where(F.col("lang").isin(*names)).select("lang", over.alias("over"), "place", "tie", F.length("text").cast("long").alias("chars"))
    near = top_per_group(spots, ["lang"], [("over", False), ("place", False), ("tie", False)], per_language)
    # Repeated rows are one document of the sample.
    once = near.groupBy("lang", "over", "place", "tie").agg(F.min("rank").alias("rank"), F.max("chars").alias("chars"))
    so_far = F.sum("chars").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    taken = once.withColumns({"so_far": so_far, "first": first}).where((F.col("so_far") <= share) | (F.col("first") == 1)).select("lang", "place", "tie")
    # At most per_language * most_languages rows of three numbers.
    texts = usable.join(F.broadcast(taken), ["lang", "place", "tie"]).dropDuplicates(["lang", "place", "tie"])
    return texts.orderBy("lang", "place", "tie").select("text", "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Tagger | None:
    rows = training_sample(docs, id_col, text_col, lang_col, per_language).collect()
    tagger = train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None
    del rows
    let_go(docs.sparkSession)
    return tagger


def shared_tagger(tagger: Tagger) -> Tagger:
    """The copy of tagger, with its cache, that this Python worker has used before."""
    cache = process_cache("taggers")
    if tagger.mark not in cache:
        cache.clear()
        cache[tagger.mark] = tagger
    return cache[tagger.mark]


def predict(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    if tagger is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_tagger(tagger)
        for b in batches:
            made = list(own.predict(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(tidy(predicted, "taggers"), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label_words(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, str, float]]]:
    """Per text: (word, language, probability) of each of its words with a letter."""
    p, first = tagger.word_probabilities(texts)
    out = []
    for i, text in enumerate(texts):
        words = [w for w in (text or "").split() if tagger.rows[w.lower()] >= 0]
        own = p[first[i] : first[i + 1]]
        out.append([(w, tagger.languages[int(q.argmax())], float(q.max())) for w, q in zip(words, own, strict=True)])
    return out


def drop_unidentified(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows whose text is `und` or has no language above min_score."""
    if tagger is None:
        return docs.limit(0)

    ship_code(docs.sparkSession)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_tagger(tagger)
        for whole in batches:
            for b in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                made = own.predict(b.column(text_col).to_pylist())
                yield b.filter(pa.array([lang != UND and score >= min_score for lang, score in made], pa.bool_()))

    return docs.mapInArrow(tidy(known, "taggers"), docs.schema)
