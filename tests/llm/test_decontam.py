"""Decontamination against a brute-force restatement."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

from sluice.llm import decontam
from sluice.llm.queries import QUERIES


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


def hit_places(own, item, width=10):
    size = min(len(item), width)
    wanted = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
    return {i + k for i in range(len(own) - size + 1) if tuple(own[i : i + size]) in wanted for k in range(size)}


def expected(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item, body in items:
            if places := hit_places(own, words(body)):
                hit |= places
                names |= {str(item)} if item is not None else set()
        out.append((doc_id, len(own), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "É", "ß", "x1", "日本", "don"]
    say = lambda n: rng.choice([" ", ", ", "-", "\n", "\x00", "'"]).join(rng.choices(vocabulary, k=n))
    items = [(k, say(n)) for k, n in enumerate([3, 9, 10, 11, 40, 25, 14])] + [(7, None), (8, ""), (9, " .. "), (None, say(12)), (4, say(15)), (10, "a B")]
    docs = [(k, rng.choice([say(rng.randint(0, 30)), f"{say(6)} {items[rng.randrange(7)][1].upper()}, {say(4)}"])) for k in range(80)]
    docs += [(100, None), (101, ""), (None, items[4][1]), (None, None), (102, (items[3][1] + " zz ") * 3000), docs[0], docs[0], (docs[1][0], "another")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, True, "x") for r in docs], "doc_id long, text string, known boolean, mark string")
    return d, spark.createDataFrame(items, "item_id int, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, seed):
    docs, items = case(seed)
    d, b = frames(spark, docs, items)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in QUERIES["op13_decontamination"](spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(docs, items)))
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_a_set_in_blocks_finds_the_same(spark, monkeypatch):
    docs, items = case(3)
    d, b = frames(spark, docs, items)
    show = lambda: sorted(map(repr, decontam.contamination(d, b).collect()))
    whole = show()
    for name in ("BROADCAST_WINDOWS", "BROADCAST_BODIES", "BROADCAST_DOCS"):
        monkeypatch.setattr(decontam, name, 20)
    assert show() == whole


def test_spans_and_documents_go(spark):
    docs, items = case(4)
    d, b = frames(spark, docs, items)
    dirty = {(r[0], t) for r, (_, t) in zip(expected(docs, items), docs, strict=True) if r[-1]}
    left = decontam.decontaminated(d, b)
    assert left.columns == d.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, (x for x in docs if x not in dirty)))
    cut = decontam.decontaminated(d, b, remove="spans").collect()
    assert len(cut) == len(docs)
    want = []
    for doc_id, text in docs:
        own = words(text)
        hit = set().union(*(hit_places(own, words(body)) for _, body in items))
        want.append((doc_id, [w for k, w in enumerate(own) if k not in hit] if text is not None else None))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], words(r["text"]) if r["text"] is not None else None)) for r in cut)
    assert {r["text"] for r in cut if (r["doc_id"], r["text"]) not in dirty} >= {t for i, t in docs if (i, t) not in dirty}


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c")]), ([(1, "a b c"), (2, None)], [])])
def test_empty_tables(spark, docs, items):
    d, b = frames(spark, docs, items)
    got = decontam.contamination(d, b).collect()
    assert len(got) == len(docs) and all(r["spans"] is None and r["items"] is None for r in got)
    assert decontam.decontaminated(d, b, remove="spans").count() == len(docs)


def test_no_python_on_the_main_path(spark, tmp_path):
    d, b = frames(spark, *case(5))
    plan = decontam.scanned(d, decontam.test_windows(b).select("mark").distinct(), [10], True, "doc_id", "text", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
