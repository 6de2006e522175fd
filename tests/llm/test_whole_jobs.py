"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import exact, lines, pieces, quality
from sluice.llm.common import settled


# 6. Quality


def test_boilerplate_counts_as_lost(spark):
    furniture = ["click here", "sign up", "accept cookies", "read more"]
    bad = [f"Please {k} {furniture[k % 4]} for {k + 50} more." for k in range(19)]  # no 5 words twice
    clean = "One clean line of words that nobody objects to ends here."
    cookies = "We value your privacy, so accept cookies now or read our cookie policy, our privacy policy and our terms of service before you go on to any other page of ours."
    prose = "The committee met for several hours to discuss copyright in the age of printing, and its members agreed on very little, as they had in all of the years before that one."
    texts = ["\n".join([*bad, clean]), f"{cookies}\n{clean}", prose, f"{clean}\nAll rights reserved."]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in range(4)] == [False, False, True, True]
    assert [got[k]["lines_removed"] for k in range(4)] == [19, 1, 0, 1]
    assert [got[k]["lost_words"] for k in range(4)] == [sum(len(x.split()) for x in bad), len(cookies.split()), 0, 3]
    assert got[0]["clean_text"] == clean


# 5. Line dedup


def all_pairs_left(data, least=50):
    """Lines outside all maximal runs that are shared with any earlier place."""
    split = {i: [" ".join(x.split()) for x in t.split("\n") if x.split()] for i, t in data}
    gone = {i: set() for i in split}
    for i in split:
        for j in (j for j in split if j <= i):
            mine, other = split[i], split[j]
            for shift in range(1 if i == j else 1 - len(other), len(mine)):
                a = max(0, shift)
                while a < len(mine) and a - shift < len(other):
                    z = a
                    while z < len(mine) and z - shift < len(other) and mine[z] == other[z - shift]:
                        z += 1
                    if sum(len(x.split()) for x in mine[a:z]) >= least:
                        gone[i] |= set(range(a, z))
                    a = z + 1
    return {i: [x for k, x in enumerate(split[i]) if k not in gone[i]] for i in split}


def test_longer_variants_of_a_hot_passage(spark):
    hot, tail, head = "hot " * 60, "tail " * 10, "head " * 10
    data = [(0, f"{hot}\nown end 0"), (1, f"{head}\n{hot}\n{tail}\nown end 1"), (2, f"own start 2\n{head}\n{hot}\n{tail}\nown end 2")]
    rng = random.Random(11)
    pool = [" ".join(f"w{k}" for _ in range(n)) for k, n in enumerate([3, 8, 12, 20, 30, 55])]
    data += [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(3, 90)]
    got = {r["doc_id"]: [" ".join(x.split()) for x in r["__sl_text"].split("\n") if x.split()] for r in lines.without_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = all_pairs_left(data)
    assert want[2] == ["own start 2", "own end 2"]
    assert got == want


# 4. Exact dedup


def test_drop_keeps_one_row_of_each_group(spark):
    data = [(1, "a b", 5), (1, "a  b", 6), (2, "a\tb", 7), (3, "c", 8), (3, "c", 8), (None, "d", 9), (None, None, 1), (4, "", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, n long")
    got = sorted((tuple(r) for r in exact.drop_exact_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, "a  b", 6), (3, "c", 8), (None, "d", 9), (4, "", 2)], key=repr)
    groups = {r["doc_id"]: r["group_size"] for r in exact.exact_groups(df).where("kept AND doc_id IS NOT NULL").collect()}
    assert groups == {1: 3, 3: 2, 4: 2}


# Tables kept between steps


def test_self_joins_plan_in_constant_time(spark):
    """Size estimates of settled tables don't grow from round to round."""
    df = settled(spark.range(50).select("id", (F.col("id") + 1).alias("to")))
    for _ in range(12):
        df = settled(df.join(df.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.coalesce("next", "to").alias("to")))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert size <= 64 and df.count() >= 0


# Pipeline


def test_stages_on_odd_and_empty_tables(spark):
    body = "The same sentence stands here again, with enough words to be a passage of its own in every text. " * 4
    texts = [(1, body), (1, body), (2, body + "x"), (None, body), (None, None), (3, None), (4, ""), (5, " \t\n"), (1, "another text under an id that is taken already, quite different from it")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else "src", None) for k, (i, t) in enumerate(texts)], schema)
    for start in (odd, odd.limit(0), odd.where("lang IS NULL")):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema)
            assert docs.columns == start.columns
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= {1, 2, None} and (start is odd or not ids)


# 10. Pieces


def test_decodes_compares_whole_texts():
    own = pieces.Pieces(pieces.default_model())
    texts = ["a\u2581b", "\u2581", "plain words", " led by a space", "two  spaces ", "", "\u65e5\u672c \U0001fae0"]
    made = list(own.encode_batch(texts))
    assert [m[4] for m in made] == [own.decode(np.frombuffer(m[0], "<i4").tolist()) == t for m, t in zip(made, texts, strict=True)]
    assert [m[4] for m in made] == [False, False, True, True, True, True, True]
