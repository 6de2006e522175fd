"""Nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sluice.llm import chat, exact, langid, lines, mixing, neardup, pieces, pii, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep string, label long, key string, size string, tie string, copies string, digest string, row long, gone string, kept string"
LONG = "word " * 60_000
BODY = "The same sentence stands here again, with enough words to be a passage of its own in every text. " * 4


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, BODY), (1, BODY), (2, BODY + "x"), (None, BODY), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, "no ids\x00\x01 <|endoftext|> ẞ 🙂"), (8, "???"), (1, "another text under an id that is taken already, quite different from it")]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "src", None, *[None] * 11) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


PER_ROW = {
    "mixing": lambda d: mixing.copies(mixing.sized(d)),
    "neardup": lambda d: neardup.near_groups(d),
    "tokens": lambda d: tokens.token_counts(d),
    "exact": lambda d: exact.exact_groups(d),
    "lines": lambda d: lines.without_lines(d),
    "quality": lambda d: quality.quality(d),
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "pii": lambda d: pii.with_surrogates(d),
    "pieces": lambda d: pieces.encode(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_row(odd, name):
    assert len(PER_ROW[name](odd).collect()) == odd.count()


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(odd, name):
    assert PER_ROW[name](odd.limit(0)).collect() == []


def test_near_groups_of_odd_rows(odd):
    got = sorted((tuple(r) for r in neardup.near_groups(odd).collect()), key=repr)
    by_id = {}
    for i, n, c, k in got:
        by_id.setdefault(i, []).append((n > 0, c, k))
    assert {x[1:] for x in by_id[1]} == {(1, True)} and by_id[2] == [(True, 1, False)]
    assert {x[1:] for x in by_id[None]} == {(None, None)} or all(x[2] is None for x in by_id[None])
    assert all(by_id[i] == [(False, i, True)] for i in (3, 4, 5))


def test_exact_groups_of_odd_rows(odd):
    got = exact.exact_groups(odd).collect()
    body = [r for r in got if r["doc_id"] == 1 and r["group_size"] == 3]
    assert sorted(r["kept"] for r in body) == [False, True]
    assert [r["kept"] for r in got if r["doc_id"] == 3] == [True]  # before the null id with no text


def test_undetermined_language(odd):
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(odd)).where("doc_id IN (3, 4, 8)").collect()}
    assert {(r["lang_pred"], r["score"]) for r in got.values()} == {("und", 0.0)}
    assert langid.fit(odd.where("lang IS NULL")) is None


def test_nulls_stay_null(odd):
    assert [r["text"] for r in pii.with_surrogates(odd).where("doc_id IN (3, 4)").orderBy("doc_id").collect()] == [None, ""]
    assert {r["text"] for r in lines.drop_repeated_lines(odd).where("doc_id IN (3, 4)").collect()} == {None, ""}


def test_decisions_keep_columns(odd):
    for out in (exact.drop_exact_duplicates(odd), lines.drop_repeated_lines(odd), neardup.drop_near_duplicates(odd), mixing.mix(odd), langid.drop_unidentified(odd, langid.fit(odd))):
        assert out.columns == odd.columns
        out.collect()


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (1, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["n_turns"]) == (3, 200_000, 1)
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
    assert chat.conversation_texts(chat.format_turns(df)).count() == 2


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(stages["language_id"]) == 200
    assert set(stages["minhash_neardup"]) <= set(stages["line_dedup"]) <= set(stages["language_id"])
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == docs.count() and out.where("NOT decodes").count() == 0
