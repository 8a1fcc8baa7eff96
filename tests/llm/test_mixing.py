"""Mixing: windows of every block, deviation below one block, exhausted sources, odd rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoalcount.llm import mixing

DOCS = "doc_id bigint, text string, source string, slot string, h string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_blocks_keep_their_windows(sizes):
    weights = {f"s{i}": w for i, w in enumerate(sizes)}
    total, done = sum(sizes), dict.fromkeys(weights, 0)
    for slot, (s, j) in enumerate(mixing.cycle(weights)):
        assert j == done[s] and j * total // weights[s] <= slot < -(-(j + 1) * total // weights[s])
        done[s] += 1
        assert all(abs(done[x] * total - (slot + 1) * weights[x]) < total for x in weights)
    assert done == weights


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", "h") for r in rows], DOCS)


def test_schedule_and_order(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"small{i % 2}") for i in range(600)]
    docs = docs_of(spark, rows)
    weights = {"big": 3, "small0": 2, "small1": 1}
    plan = mixing.schedule(docs, weights, block_rows=4).collect()
    assert sorted(r["position"] for r in plan) == list(range(600))
    by_slot = {}
    for r in plan:
        by_slot.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in by_slot.values())
    pattern = mixing.cycle(weights)
    for slot, held in by_slot.items():
        (source, block), = held
        assert pattern[slot % 6] == (source, block % weights[source]) and slot // 6 == block // weights[source]
    ran_out = min(max(r["slot"] for r in plan if r["source"] == s) for s in weights)
    seen = dict.fromkeys(weights, 0)
    for slot in range(ran_out):
        (source, _), = by_slot[slot]
        seen[source] += 1
        assert all(abs(seen[s] - (slot + 1) * w / 6) < 1 for s, w in weights.items())
    out = mixing.mixed(docs, weights=weights, block_rows=4)
    assert out.columns == docs.columns
    position = {r["doc_id"]: r["position"] for r in plan}
    assert [position[r["doc_id"]] for r in out.collect()] == list(range(600))


def test_more_sources_than_slots(spark):
    rows = [(i, f"t{i}", f"domain{i % 1500}") for i in range(3200)]
    plan = mixing.schedule(docs_of(spark, rows), block_rows=1).collect()
    assert sorted(r["position"] for r in plan) == list(range(3200)) and len({r["source"] for r in plan}) == 1500
    total = sum({r["source"]: r["weight"] for r in plan}.values())
    assert total >= 1500
    for r in plan:  # every block stands in its window
        turn, cycle = r["block"] % r["weight"], r["block"] // r["weight"]
        assert turn * total // r["weight"] <= r["slot"] - cycle * total < -(-(turn + 1) * total // r["weight"])


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "x", "a"), (3, "y", "a"), (3, "y", "a"), (4, "z" * 100000, "b")]
    docs = docs_of(spark, rows)
    plan = mixing.schedule(docs, block_rows=1).collect()
    assert sorted(r["position"] for r in plan) == list(range(6)) and {r["source"] for r in plan} == {"", "a", "b"}
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, docs.collect()))
    assert mixing.schedule(docs.where(F.lit(False))).count() == 0 and mixing.mixed(docs.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="without a weight"):
        mixing.schedule(docs, {"a": 1})
