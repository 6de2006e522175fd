"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary file is read here, without a library: pieces, scores, kinds and the
normaliser's flags. Pieces lie in a double-array trie over their UTF-8 bytes. A
batch of segments is encoded together: all positions walk the trie at once, which
lists every piece that begins anywhere, then the best path is extended position by
position over all segments (of equal scores the longest last piece wins), and the
paths are read back. A character without a piece costs the least score minus 10
and is written as its UTF-8 bytes' pieces. Decoding turns pieces back into bytes,
the white-space mark into a space, and drops the space put before the text.

Segments: no piece holds the mark after another character, so every place where a
mark follows one is a piece boundary on any path; nor can a character that no
longer piece holds be joined to its neighbours. A text's best path is therefore
the best paths of its segments put together, and segments seen before come from a
bounded cache of the Python worker. If a vocabulary lacks that property, the
whole text is one segment.

Scores are summed in double precision. A file whose scores are ranks of a merge
vocabulary serves as well: they are log scores up to scale, which leaves the best
path as it is.

Defined cases: a null text counts as empty and has no pieces. Rows are
independent, so repeated rows, ties and null ids need no care; an empty table
gives an empty result; extra columns of the input are ignored. A long segment
takes memory in proportion to its own length.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache, ship_code, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 60_000
#: Segments whose best paths are found together.
PART_SEGMENTS = 4000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message, one level deep."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class DoubleArray:
    """A trie of byte strings: child of s by byte b is base[s] + b if check of it is s."""

    #: How many free slots are tried for a state with several children before the end of the array is taken.
    TRIES = 48

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        used = bytearray(1 << 16)
        used[0] = 1
        base, check, value = {}, {0: -2}, {}
        lone, many = 1, 1  # where to look for a free slot
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, first, last, depth = todo.pop()
            while first < last and len(keys[order[first]]) == depth:
                value[state] = order[first]
                first += 1
            if first == last:
                continue
            groups: list[tuple[int, int, int]] = []
            for at in range(first, last):
                byte = keys[order[at]][depth]
                if groups and groups[-1][0] == byte:
                    groups[-1] = (byte, groups[-1][1], at + 1)
                else:
                    groups.append((byte, at, at + 1))
            least = groups[0][0]
            slot = max(least + 1, lone if len(groups) == 1 else many)
            for _ in range(self.TRIES):
                slot = used.find(0, slot)
                if slot < 0 or slot + 256 >= len(used):
                    used += bytes(len(used))
                    slot = used.find(0, 0 if slot < 0 else slot)
                if not any(used[slot - least + g[0]] for g in groups):
                    break
                slot += 1
            else:
                slot = used.rfind(1) + 1 + least
                if slot + 256 >= len(used):
                    used += bytes(len(used))
            if len(groups) == 1:
                lone = slot
            else:
                many = max(many, slot - 256)
            start = base[state] = slot - least
            for byte, a, z in groups:
                used[start + byte] = 1
                check[start + byte] = state
                todo.append((start + byte, a, z, depth + 1))
        size = used.rfind(1) + 512
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for to, found in ((self.base, base), (self.check, check), (self.value, value)):
            to[np.fromiter(found, np.int64, len(found))] = np.fromiter(found.values(), np.int64, len(found))

    def matches(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of every key that begins at any position i of data and
        ends at limit[i] at the latest."""
        start = np.arange(len(data))
        state, at = np.zeros(len(data), np.int64), start.copy()
        found = []
        while len(start):
            inside = at < limit[start]
            start, state, at = start[inside], state[inside], at[inside]
            to = self.base[state] + data[at]
            ok = (self.base[state] > 0) & (self.check[to] == state)
            start, state, at = start[ok], to[ok], at[ok] + 1
            hit = self.value[state] >= 0
            found.append((start[hit], at[hit], self.value[state[hit]]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


class Pieces:
    """A SentencePiece vocabulary as a unigram model."""

    def __init__(self, path: str):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.dummy_prefix, self.one_space, self.mark_spaces = True, True, True
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(struct.unpack("<f", piece[2])[0])
                self.kind.append(piece[3])
            elif field == 3:
                flags = dict(_fields(value))
                if flags.get(2):
                    raise ValueError("a vocabulary with a character map isn't supported")
                self.dummy_prefix, self.one_space, self.mark_spaces = bool(flags.get(3, 1)), bool(flags.get(4, 1)), bool(flags.get(5, 1))
        kinds = np.array(self.kind)
        self.scores = np.array(self.score)
        self.listed = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
        self.trie = DoubleArray([self.text[i].encode() for i in self.listed])
        normal = self.scores[kinds == NORMAL]
        self.unknown_score = float(normal.min()) - UNKNOWN_PENALTY
        # A piece given by the user wins over any other way to write its characters.
        top = float(normal.max())
        for i in np.flatnonzero(kinds == USER):
            self.scores[i] = len(self.text[i]) * top - 0.1
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(self.text[i][3:5], 16)] = i
        self.spells = (kinds == BYTE).tolist()
        self.has_bytes = bool((kinds == BYTE).any())
        self.bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(MARK, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.bytes[self.unknown] = b" \xe2\x81\x87 "
        long = [self.text[i] for i in self.listed if len(self.text[i]) > 1]
        if any(MARK in t.lstrip(MARK) for t in long):
            self.segment = re.compile(r".+", re.S)
        else:
            joined = "".join(re.escape(c) for c in sorted(set("".join(long)) - {MARK}))
            self.segment = re.compile(f"{MARK}*[{joined}]+|{MARK}+|[^{MARK}{joined}]")
        self.cache: dict[str, tuple[bytes, int, int, float, bytes]] = {}

    def normal(self, text: str) -> str:
        """The text with white space marked, ready to be cut into segments."""
        if self.one_space:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.mark_spaces else text

    def viterbi(self, segments: list[str]) -> list[tuple[list[int], float]]:
        """The ids and the score of each segment's best path; no segment is empty."""
        raw = [s.encode() for s in segments]
        n = len(raw)
        size = np.fromiter(map(len, raw), np.int64, n)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        limit = np.repeat(ends, size)
        start, end, key = self.trie.matches(data, limit)
        ids = self.listed[key]
        # Where no piece is just the one character, that character may stand alone.
        head = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.r_[head[1:], len(data)]
        width = np.zeros(len(data), np.int64)
        width[head] = after - head
        single = np.zeros(len(data), bool)
        single[start[end - start == width[start]]] = True
        lone = head[~single[head]]
        start, end = np.r_[start, lone], np.r_[end, lone + width[lone]]
        score = np.r_[self.scores[ids], np.full(len(lone), self.unknown_score)]
        ids = np.r_[ids, np.full(len(lone), -1)]
        # Position by position, every segment at once. Node i + segment number lies before byte i.
        who = np.repeat(np.arange(n), size)
        node_from, node_to = start + who[start], end + who[start]
        best = np.full(len(data) + n, -np.inf)
        came = np.full(len(data) + n, -1, np.int64)
        best[begins + np.arange(n)] = 0.0
        place = start - begins[who[start]]
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(int(size.max()) + 1))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            m = order[a:z]
            reached = best[node_from[m]] + score[m]
            better = reached > best[node_to[m]]
            m = m[better]
            best[node_to[m]], came[node_to[m]] = reached[better], m
        # Back from every segment's end.
        at = ends + np.arange(n)
        total = best[at]
        goal = begins + np.arange(n)
        live = np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            m = came[at[live]]
            steps.append((live, m))
            at[live] = node_from[m]
            live = live[at[live] > goal[live]]
        paths: list[list[int]] = [[] for _ in range(n)]
        for live, m in reversed(steps):
            for k, i, piece in zip(live.tolist(), m.tolist(), ids[m].tolist(), strict=True):
                if piece >= 0:
                    paths[k].append(piece)
                elif self.has_bytes:
                    paths[k] += self.byte_ids[data[start[i] : end[i]]].tolist()
                else:
                    paths[k].append(self.unknown)
        return list(zip(paths, total.tolist(), strict=True))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.decode_bytes(ids))

    def plain(self, data: bytes) -> str:
        """The text of all of a document's decoded bytes."""
        text = data.decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def cut(self, text: str) -> list[str]:
        return self.segment.findall(self.normal(text))

    def learn(self, segments: set[str]) -> None:
        """Fills the cache: packed ids, number, bytes spelled out, score, decoded bytes."""
        fresh = list(segments)
        spells = self.spells.__getitem__
        for k in range(0, len(fresh), PART_SEGMENTS):
            part = fresh[k : k + PART_SEGMENTS]
            for s, (ids, score) in zip(part, self.viterbi(part), strict=True):
                self.cache[s] = (struct.pack(f"<{len(ids)}i", *ids), len(ids), sum(map(spells, ids)), score, self.decode_bytes(ids))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, int, int, float, bool]]:
        """Per text: ids (little-endian 32-bit), their number, bytes spelled out, the
        path's score, and whether decoding all of them gives the text itself."""
        done = 0
        while done < len(texts):
            batch, size, at = [], 0, done
            while done < len(texts) and size < 300_000:
                batch.append(self.cut(texts[done]))
                size += len(texts[done])
                done += 1
            if len(self.cache) > CACHE_SEGMENTS:
                self.cache.clear()
            unseen = set().union(*batch).difference(self.cache)
            if unseen:
                self.learn(unseen)
            for text, segments in zip(texts[at:done], batch, strict=True):
                got = list(map(self.cache.__getitem__, segments))
                if not got:
                    yield b"", 0, 0, 0.0, text == ""
                    continue
                ids, number, spelled, score, back = zip(*got, strict=True)
                yield b"".join(ids), sum(number), sum(spelled), sum(score), self.plain(b"".join(back)) == text


def pieces(path: str) -> Pieces:
    cache = process_cache("pieces")
    if path not in cache:
        cache[path] = Pieces(path)
    return cache[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_pieces, n_bytes_spelled, score, ids_sha256,
    decodes (whether decoding gives the text), and with with_ids the ids themselves
    as binary (little-endian 32-bit)."""
    ship_code(docs.sparkSession)
    path = path or default_model()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_pieces", "n_bytes_spelled", "score", "ids_sha256", "decodes"] + ["ids"] * with_ids

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for whole in batches:
            for b in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                number, spelled, score, digest, back, ids = [], [], [], [], [], []
                for packed, n, m, total, ok in p.encode_batch(b.column("text").to_pylist()):
                    number.append(n), spelled.append(m), score.append(total), back.append(ok)
                    digest.append(hashlib.sha256(packed).hexdigest())
                    if with_ids:
                        ids.append(packed)
                out = [b.column("doc_id"), pa.array(number, pa.int64()), pa.array(spelled, pa.int64()), pa.array(score, pa.float64()), pa.array(digest, pa.string()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)

    return rows.mapInArrow(tidy(encoded, "pieces"), f"doc_id {kind}, n_pieces long, n_bytes_spelled long, score double, ids_sha256 string, decodes boolean" + ", ids binary" * with_ids)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row of encoded: doc_id, text. Null ids give an empty text."""
    ship_code(encoded.sparkSession)
    path = path or default_model()
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = [p.decode(np.frombuffer(x, "<i4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(tidy(decoded, "pieces"), f"doc_id {kind}, text string")
