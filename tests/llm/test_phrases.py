"""Mined phrases against counting all of them in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import phrases
from sluice.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, n long, h long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(docs, longest=5):
    found, totals = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                found.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return found, totals


def expected(docs, support, top):
    found, totals = counts(docs)
    frequent = {x: n for x, n in found.items() if n >= support}
    swallowed = {(lang, w[i : i + m]) for (lang, w), n in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if n >= frequent[lang, w[i : i + m]]}
    rows = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in swallowed:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k, frequent[lang, w[:k]], frequent[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n))
    return [(lang, rank, p.decode(), -a, l, r, n, -s) for lang, own in rows.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1)]


def case(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "日本", "\x00", "A", "a"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["once upon a time there was", "A a a a a", "the  quick\tbrown fox"]
    say = lambda: "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r", "\x0b"]) for x in rng.choices(vocabulary, weights, k=rng.randint(0, 30)))
    docs = [(k, f"{say()}{rng.choice(fixed)}{rng.choice(['', ' ', '! '])}{say()}", rng.choice(["en", "de", "en", "en", None])) for k in range(n)]
    return [*docs, (None, None, "en"), (1000, "", None), (1001, "lone", "zz"), (1002, " . \n", "de"), (1003, "x" * 100_000 + " " + "ab cd " * 2000, "de"), docs[0], docs[0], (5, "other", "en")]


@pytest.mark.parametrize("seed, support, shards", [(1, 20, 8), (2, 5, 3), (3, 60, 1)])
def test_equals_counting_all(spark, seed, support, shards):
    docs = case(seed)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], SCHEMA)
    got = [tuple(r) for r in phrases.collocations(d, support=support, shards=shards, top=25).collect()]
    want = expected(docs, support, 25)
    assert sorted(got) == sorted(want)
    assert len(want) > 10
    frequent, totals = phrases.frequent_phrases(d, support=support, shards=shards)
    found, sizes = counts(docs)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in frequent.collect()} == {x: n for x, n in found.items() if n >= support}
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(sizes)


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    docs = case(4)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], SCHEMA)
    bloom = np.full(phrases.BLOOM_BITS // 64, np.uint64(2**64 - 1))
    monkeypatch.setattr(phrases, "filter_of", lambda keys, by_cell: bloom)
    assert sorted(tuple(r) for r in phrases.collocations(d, support=20, top=25).collect()) == sorted(expected(docs, 20, 25))


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_with_nothing_frequent(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "en", 1, 1)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op11_phrase_collocation"](spark, str(tmp_path)).collect() == []


def test_counts_are_exact_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", 2, "a b", 10**13), ("en", 1, "a", 10**13 + 7), ("en", 1, "b", 3 * 10**13)], "lang string, words int, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    row = phrases.scored(frequent, totals).first()
    assert row["score"] == 1000 * 10**13 * (10**14 + 3) // ((10**13 + 7) * 3 * 10**13)


def test_words_of_odd_texts():
    texts = ["A b", None, "", " \tc", "d.e", "\x0bf  g\t", "é"]
    w = phrases.Words(pa.array(texts))
    assert [w.text(i, 1) for i in range(len(w.starts))] == ["a", "b", "c", "d", "e", "f", "g", "é"]
    assert np.flatnonzero(w.runs(2)).tolist() == [0, 5]
    assert w.text(5, 2) == "f g"


def test_a_task_sends_on_no_row_for_each_frequent_phrase(spark, monkeypatch):
    """Rows with spelled phrases that leave the Python tasks: they grew as tasks times phrases."""
    tasks, run = 32, " ".join(f"v{i}" for i in range(60))
    docs = [(k, f"{run}. u{k}", "en") for k in range(4 * tasks)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], SCHEMA).repartition(tasks)
    kind, made = type(d), spark.sparkContext.accumulator(0)
    plain = kind.mapInArrow

    def watched(self, step, schema, *rest, **more):
        def counted(batches):
            for b in step(batches):
                made.add(b.num_rows)
                yield b

        return plain(self, counted if "phrase string" in str(schema) else step, schema, *rest, **more)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    frequent = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in phrases.frequent_phrases(d)[0].collect()}
    assert frequent == {x: n for x, n in counts(docs)[0].items() if n >= 100}
    assert len(frequent) == 60 + 59 + 58 + 57 + 56
    assert len(frequent) <= made.value < tasks * len(frequent) / 4


def test_shards_that_passed_a_candidate_over_are_counted_too(spark, monkeypatch):
    docs = case(1)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], SCHEMA)
    plain, rest = phrases.shard_counts, []

    def watched(rows, levels, candidates=None):
        found = plain(rows, levels, candidates)
        rest.extend([found] if candidates is not None else [])
        return found

    monkeypatch.setattr(phrases, "shard_counts", watched)
    frequent = phrases.frequent_phrases(d, support=20, shards=8)[0]
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in frequent.collect()} == {x: n for x, n in counts(docs)[0].items() if n >= 20}
    assert rest[0].count() > 0
