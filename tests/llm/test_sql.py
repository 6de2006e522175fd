"""The SQL of line dedup and chat formatting against the operators, on odd rows."""

from __future__ import annotations

import random

import duckdb
import pytest

from sluice.llm.queries import QUERIES
from sluice.llm.sql import ORACLE_SQL


def same_rows(spark, folder, name, table):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = c.sql(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, str(folder)).toArrow()
    assert {c: str(want[c].type) for c in want.column_names} == {c: str(got[c].type) for c in got.column_names}
    assert sorted(map(repr, got.select(want.column_names).to_pylist())) == sorted(map(repr, want.to_pylist()))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_turns_with_marks_and_backslashes(spark, tmp_path, seed):
    rng = random.Random(seed)
    bits = ["\\", "\\\\", "<", "[", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "INST]", "s>", " ", "\n", "a", "é", "𝄞"]
    roles = ["user", "assistant", "system", None, "", "tool", "to\\", "a<<ROLE>>", "<", "\\<"]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 7)))])) for c in [None, *range(40)] for t in [None, *range(6)]]
    rows += rows[:5] + [(50, 0, "user", "<s>"), (50, 0, "user", "=")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = same_rows(spark, tmp_path, "op7_chat_formatting", "conversations")
    assert got.num_rows == 43


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_that_repeat_in_runs(spark, tmp_path, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 5, 12, 30, 60]))) for _ in range(25)]
    texts = []
    for _ in range(60):
        at = rng.randrange(20)
        texts.append("\n".join([rng.choice(["own line ", ""]) + rng.choice(pool), "", "  " + " ".join(pool[at].split()), *pool[at + 1 : at + rng.randint(1, 5)], " \t"]))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " \n\t"), (103, texts[0]), (104, "\n".join(pool[:3] * 3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = same_rows(spark, tmp_path, "op5_line_dedup", "documents")
    assert 0 < sum(got["lines_removed"].to_pylist())
