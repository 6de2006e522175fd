"""Token counts of long unbroken words equal the library's, in time that follows their length."""

from __future__ import annotations

import random
import time

import pytest
import tokenizers

from sluice.llm import tokens


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "aaab", "étà日本x", "a", "the", "0123456789abcdef", "-_=+"])
def test_long_words(library, alphabet):
    rng = random.Random(alphabet)
    m = tokens.RankMerger(tokens.default_tokenizer())
    for n in (tokens.LONG - 1, tokens.LONG, tokens.LONG + 1, 5000):
        words = ["".join(rng.choices(alphabet, k=n)), (alphabet * n)[:n]]
        want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
        assert m.count(words) == want
        raw = [w.encode() for w in words if m.pretokens(w) == [w]]
        if raw:
            assert [m.merge_alone(w) for w in raw] == m.merge_together(raw).tolist()


def test_a_very_long_word(library):
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=320_000))
    m = tokens.RankMerger(tokens.default_tokenizer())
    began = time.perf_counter()
    got = m.count([word])
    assert time.perf_counter() - began < 10
    assert got == [len(library.encode(word, add_special_tokens=False).ids)]


def test_the_cache_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 1000)
    m = tokens.RankMerger(tokens.default_tokenizer())
    first = m.count(["x" * 5000 + " y", "a b c"])
    assert m.held > 1000 and m.count(["b c"]) == [2] and m.held < 10
    assert m.count(["x" * 5000 + " y", "a b c"]) == first
