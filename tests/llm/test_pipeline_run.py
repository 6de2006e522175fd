"""The whole pipeline, written and read between stages, on odd, empty and unlabelled tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of with his great house water road under stone river".split(), "xx": "zuk kwaz jyx qoz vux wuz zaj kyz oz uzk jaw vaz".split()}


def say(lang, k, n):
    own = WORDS[lang]
    return " ".join(own[(k * 7 + i * i * (k % 5 + 1) + i // 3) % len(own)] + ("." if i % 9 == 8 else "") for i in range(n))


def rows():
    out = [(k, say(lang, k, 60 + k), lang, f"s{k % 2}") for k, lang in enumerate(["en", "xx"] * 20)]
    passage = say("en", 99, 70)
    out += [(100 + k, f"{say('en', 200 + k, 30)}\n{passage}\n{say('en', 300 + k, 30)}", "en", "s0") for k in range(2)]
    out += [(110, out[0][1], "en", "s1"), (111, out[1][1], None, None), (112, None, "en", "s0"), (113, "", "xx", "s1"), (114, " \n\t ", None, None), (115, "12 34 !!", "en", "s0"), (None, say("en", 400, 50), "en", "s0"), out[2]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


def ran(spark, tmp_path, table):
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_odd_tables(spark, tmp_path):
    got = ran(spark, tmp_path, rows())
    ids = Counter(r["doc_id"] for r in got)
    texts = {r[0]: r[1] for r in rows()}
    # Rejected: texts without a letter. Gone: copies of documents 0 and 1.
    assert not {112, 113, 114, 115, 110, 111} & set(ids)
    assert set(ids) <= set(texts) and len(ids) > 25
    assert all(r["decodes"] and r["n_pieces"] > 0 for r in got)
    # Line dedup takes the later passage out: what is encoded is shorter than the text was.
    spelled = {r["doc_id"]: r["n_bytes_spelled"] for r in got}
    assert all(n <= len(texts[i].encode()) + 1 for i, n in spelled.items() if i is not None)
    if 101 in spelled:
        assert spelled[101] < len(texts[101].encode()) * 0.7


def test_empty_and_unlabelled_tables(spark, tmp_path):
    assert ran(spark, tmp_path / "empty", []) == []
    assert ran(spark, tmp_path / "unlabelled", [(k, say("en", k, 60), None, "s", 300) for k in range(5)]) == []
