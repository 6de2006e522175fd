"""Queries run over whole tables: results against loops over every row."""

from __future__ import annotations

import pytest

from sluice.plans import registry
from sluice.sources import relations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def selected(spark):
    """Per user what all clicks leave selected, toggled one by one."""
    made: dict[int, list[str]] = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        now, option = made.setdefault(r["user_id"], []), registry.USES[r["event_id"] % len(registry.USES)]
        if option in now:
            now.remove(option)
        else:
            now.append(option)
    return made


def _result(user, chosen):
    high, scope = bool(set(chosen) & set(relations.HIGH_RISK_USES)), registry.SCOPES[user % 4]
    if scope == "Not sure":
        return "unsure"
    if high and scope == "Yes":
        return "high"
    return "low" if not high or scope == "No" else "unsure"


@pytest.mark.parametrize("name", ["r03_rule_classifier", "r12_result_lookup"])
def test_rules_see_every_click(spark, selected, name):
    got = {r["user_id"]: r["result"] for r in registry.QUERIES[name](spark, SF).collect()}
    assert got == {u: _result(u, c) for u, c in selected.items()}


def test_answers_see_every_click(spark, selected):
    first, second = registry.USES[:2]

    def rows(name):
        return {r["user_id"]: r for r in registry.QUERIES[name](spark, SF).collect()}

    high, edits, done, shown = map(rows, ("r04_any_of", "r05_array_edits", "r08_can_advance", "r09_is_selected"))
    assert set(high) == set(edits) == set(done) == set(shown) == set(selected)
    for u, chosen in selected.items():
        left = [x for x in chosen if x != first]
        assert high[u]["any_high_risk"] == bool(set(chosen) & set(relations.HIGH_RISK_USES))
        assert (edits[u]["has_option"], edits[u]["dropped"], edits[u]["appended"]) == (first in chosen, ";".join(left), ";".join([*chosen, first]))
        assert edits[u]["toggled"] == ";".join(left if first in chosen else [*chosen, first])
        assert (done[u]["uses_complete"], done[u]["scope_complete"]) == (bool(chosen), registry.SCOPES[u % 4] != "")
        assert shown[u]["is_selected"] == (second in chosen if u % 2 == 0 else registry.SCOPES[u % 4] == "Yes")


def test_every_position_is_mapped(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        want |= {(r["vec_id"], i, i * 80, "accent" if i >= 6 else "plain") for i in range(len(r["embedding"]))}
    rows = registry.QUERIES["r27_indexed_map"](spark, SF).collect()
    assert len(rows) == len(want) and {(r["vec_id"], r["i"], r["delay_ms"], r["colour"]) for r in rows} == want
    assert all(r["opacity"] == (0.6 + r["i"] * 0.06 if r["i"] < 6 else 1.0) for r in rows)
