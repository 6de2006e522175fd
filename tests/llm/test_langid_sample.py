"""The tagger's sample is fair to rare languages, and switches are learned."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def corpus(spark, frequent, rare, long_words=700):
    """Long documents of one language, short ones of another with its own words."""
    en = spark.range(frequent, numPartitions=4).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(long_words)), lambda k: F.element_at(F.split(F.lit("the and of with his great house water road under"), " "), (F.pmod(F.xxhash64("id", k), F.lit(10)) + 1).cast("int")))).alias("text"), F.lit("en").alias("lang"))
    xx = spark.range(10**6, 10**6 + rare, numPartitions=2).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.element_at(F.split(F.lit("zuk kwaz jyx qoz vux wuz zaj kyz"), " "), (F.pmod(F.xxhash64("id", k), F.lit(8)) + 1).cast("int")))).alias("text"), F.lit("xx").alias("lang"))
    return en.unionByName(xx).withColumnRenamed("id", "doc_id")


@pytest.mark.parametrize("frequent", [200, 8000])
def test_rare_labels_are_learned_beside_frequent_ones(spark, frequent):
    docs = corpus(spark, frequent, 30)
    sample = langid.training_sample(docs, "doc_id", "text", "lang").collect()
    n = {x: sum(r["lang"] == x for r in sample) for x in ("en", "xx")}
    assert n["xx"] == docs.where((langid.fold("doc_id") != langid.HELD_OUT) & (F.col("lang") == "xx")).count()
    assert 100 < n["en"] <= langid.PER_LANGUAGE and sum(len(r["text"]) for r in sample if r["lang"] == "en") <= langid.MOST_CHARS // 2
    tagger = langid.fit(docs)
    assert tagger.languages == ["en", "xx"]
    assert {r["lang_pred"] for r in langid.predict(docs.where("lang = 'xx'"), tagger).collect()} == {"xx"}


def test_every_label_has_a_document(spark):
    rows = [(k, "w" * (3000 if k % 3 else 30_000), f"l{k % 40}") for k in range(400)] + [(9, "copy", "same")] * 500 + [(None, "no id", "null"), (3, None, "text"), (4, "t", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sample = langid.training_sample(docs, "doc_id", "text", "lang", per_language=5, most_chars=41 * 4000).collect()
    labels = [r["lang"] for r in sample]
    learnable = {r["lang"] for r in docs.where((langid.fold("doc_id") != langid.HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect()}
    assert set(labels) == learnable and max(labels.count(x) for x in labels) <= 5 and labels.count("same") == 1
    assert sample == langid.training_sample(docs.repartition(7), "doc_id", "text", "lang", per_language=5, most_chars=41 * 4000).collect()


def test_spliced_sequences_keep_all_words():
    rng = random.Random(5)
    seqs = [np.array([rng.randrange(100) for _ in range(rng.choice([0, 1, 24, 25, 26, 80]))], np.int64) for _ in range(60)]
    gold = [rng.randrange(3) for _ in seqs]
    words, labels = langid.spliced(seqs, gold)
    flat = lambda ws, gs: sorted((int(w), int(g)) for a, b in zip(ws, gs, strict=True) for w, g in zip(a, b, strict=True))
    assert flat(words, labels) == flat(seqs, [np.full(len(s), g) for s, g in zip(seqs, gold, strict=True)])
    assert any(len(set(g.tolist())) == 2 for g in labels)
    alone, same = langid.spliced(seqs, [0] * len(seqs))
    assert len(alone) == len(seqs) and all((g == 0).all() for g in same)


def test_switches_are_learned(spark):
    docs = corpus(spark, 200, 200, 60)
    tagger = langid.fit(docs)
    moves = np.exp(tagger.moves)
    share = moves / moves.sum(axis=1, keepdims=True)
    assert 0 < share[0, 1] < 0.5 and 0 < share[1, 0] < 0.5
    mixed = "the house of water zuk kwaz jyx qoz vux under the great road"
    assert [x[1] for x in langid.label_words([mixed], tagger)[0]] == ["en"] * 4 + ["xx"] * 5 + ["en"] * 4
