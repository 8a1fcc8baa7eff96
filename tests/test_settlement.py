"""Acceptance by joins beside the walk over each job's log."""

import random

import pytest

from shoalcount.operators import reviews as rv
from shoalcount.operators import settlement

READY = "job_id long, event_id long, base_revision long, action string, passage_id string, error string"


def walked(rows):
    out, state = {}, {}
    for job, event, base, action, passage, error in sorted(rows, key=lambda r: r[:2]):
        revision, passages = state.setdefault(job, [0, set()])
        refusal = rv.step(revision, passages, event, base, action, passage, error)
        state[job][0] += refusal is None
        out[job, event] = (refusal is None, revision + 1 if refusal is None else None, refusal)
    return out


def settled(spark, rows):
    got = settlement.settle(spark.createDataFrame(rows, READY)).collect()
    assert len(got) == len(rows)
    return {(r["job_id"], r["event_id"]): tuple(r)[2:] for r in got}


def log(rng, job, n, wild):
    """A log of one job whose clients guess at revisions, ``wild`` of them at any."""
    rows, revision, passages = [], 0, set()
    for event in sorted(rng.sample(range(10 * n), n)):
        base = rng.choice([None, -1, rng.randrange(n), revision + 1]) if rng.random() < wild else revision
        action = rng.choice(["accept", "add_passage", "add_passage", "reject", "mark_audited"])
        passage = rng.choice([f"p{rng.choice(rows)[1]}" if rows else "p0", f"p{event}", "p", "px", "p007", "p9" * 15]) if rng.random() < 0.4 else None
        error = rng.choice(["unknown track", None, None])
        rows.append((job, event, base, action, passage, error))
        refusal = rv.step(revision, passages, event, base, action, passage, error)
        revision += refusal is None
    return rows


@pytest.mark.parametrize("wild", [0.0, 0.3, 0.9])
def test_random_logs(spark, wild):
    rng = random.Random(int(wild * 10))
    rows = [r for job in range(25) for r in log(rng, job, rng.randrange(1, 40), wild)]
    rows += [(99, i, 0, "accept", None, settlement.UNKNOWN_JOB) for i in range(3)] + [(98, 1, 5, "accept", None, None)]
    assert settled(spark, rows) == walked(rows)


def test_a_long_twisted_log_takes_logarithmic_rounds(spark, monkeypatch):
    """Events of base r stand both before and after the one accepted at base r - 1."""
    rows = [(1, 10 * r + 1, r + 1, "accept", None, None) for r in range(300)] + [(1, 10 * r + 5, r, "accept", None, None) for r in range(300)]
    rows += [(2, 7, 0, "accept", None, None), (2, 9, 1, "accept", None, None)]
    rounds = []
    real = settlement.materialize_counted
    monkeypatch.setattr(settlement, "materialize_counted", lambda *a: rounds.append(1) or real(*a))
    assert settled(spark, rows) == walked(rows)
    assert len(rounds) <= 2 + 1 + 10


def test_a_rejection_that_waits_for_a_refused_addition(spark):
    """The addition is valid but stale; so its rejection goes, and with it what came after."""
    rows = [(1, 1, 0, "accept", None, None), (1, 2, 0, "add_passage", None, None), (1, 3, 1, "reject", "p2", None), (1, 4, 2, "accept", None, None)]
    rows += [(1, 5, 1, "add_passage", None, None), (1, 6, 2, "reject", "p5", None), (1, 7, 3, "accept", "p5", None), (1, 8, 3, "reject", "p5", None)]
    assert settled(spark, rows) == walked(rows)
    assert settled(spark, rows)[1, 3] == (False, None, settlement.UNKNOWN_PASSAGE)
    assert settlement.settle(spark.createDataFrame([], READY)).count() == 0
