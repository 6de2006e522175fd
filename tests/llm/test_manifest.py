"""The Merkle manifest against a plain restatement that builds whole trees."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sluice.llm import manifest as m
from sluice.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def spelled(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """(root, per leaf its siblings' digests, level by level) of a list of digests."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(proofs):
            run = level[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
            p.append((run[: at[k] % 8], run[at[k] % 8 + 1 :]))
            at[k] //= 8
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], proofs


def expected(rows):
    """op12's rows from (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return digest(*map(spelled, (r[0], r[3], r[2], r[4], text)))

    def low(t):
        return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    nil = lambda x: (x is not None, x if x is not None else 0)
    by_lang = {}
    for r in sorted(rows, key=lambda r: (nil(r[0]), leaf(r, r[1]))):
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: tree([leaf(r, r[1]) for r in by_lang[x]]) for x in names}
    root, tops = tree([built[x][0] for x in names]) if names else ("", [])
    out = []
    for x, top in zip(names, tops, strict=True):
        for r, own in zip(by_lang[x], built[x][1], strict=True):
            node = leaf(r, r[1])
            row = [r[0], node, built[x][0], root, digest(*(d for a, z in own + top for d in a + z))]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, low(r[1]))
            for a, z in own + top:
                node = digest(*a, node, *z)
            out.append((*row, node, node == root))
    return out


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(spark, folder):
    return [tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_merkle_manifest"](spark, folder).collect()]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"Text {k} É" if k % 5 else None, rng.choice(["de", "en", "", "ü"]), rng.choice([None, "s"]), k or None) for k in range(700)]
    rows += [(None, None, None, None, None), (None, "", None, "", 0), *rows[:20], *rows[:3], (3, "another text", "en", None, 3), (900, "Lone", "zz", "a", 4), (901, "L" * 200_000, "en", "a", 200_000)]
    got = found(spark, written(spark, tmp_path, rows))
    assert sorted(map(repr, got)) == sorted(map(repr, expected(rows)))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 8, 9, 513])
def test_sizes_at_borders(spark, tmp_path, n):
    rows = [(k, f"T{k}", "en", "s", 2) for k in range(n)]
    got = found(spark, written(spark, tmp_path, rows))
    assert sorted(got) == sorted(expected(rows))


def test_small_blocks_give_the_same_trees(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.col("id")).alias("text"), F.when(F.col("id") < 200, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 17)).alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    want = {r[0]: r[1:5] for r in expected([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()])}
    made = m.manifest(docs, block_levels=1).withColumns({"proof": m.proof_digest(), "back": m.folded(F.col("leaf"))}).collect()
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof"]) for r in made} == want
    assert all(r["back"] == r["root"] for r in made)
    assert {len(r["before"]) for r in made if r["group"] == "a"} == {3 + 2}


def test_a_changed_column_changes_the_fold(spark):
    docs = spark.createDataFrame([(k, "same", "en", "s", 4) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    other = m.leaf_digest(F.col("doc_id"), F.lit("t"), F.col("lang"), F.col("n_chars"), F.col("text"))
    rows = m.manifest(docs, candidate=other).select("root", m.folded(F.col("candidate")).alias("back")).collect()
    assert all(r["root"] != r["back"] for r in rows) and len(rows) == 30
