"""Overlap joins, greedy matching and suppression against brute force; error classes."""

import random

import pytest
from pyspark.sql import functions as F

from shoalcount.operators import counting as ct
from shoalcount.operators import matching as mt

from test_counting import SCHEMA, W, H


def iou(a, b):
    w = max(min(a[2], b[2]) - max(a[0], b[0]), 0)
    h = max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    inter = w * h
    area = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def random_boxes(rng, n, start, spread=400):
    """Boxes of very different sizes, some far outside the frame, many in one frame."""
    out = []
    for i in range(n):
        x, y = rng.uniform(-6000, 9000) if rng.random() < 0.1 else rng.uniform(-50, spread), rng.uniform(-50, spread)
        s = rng.choice([5, 20, 60, 300])
        out.append((1, 0 if rng.random() < 0.7 else rng.randrange(3), start + i, rng.random(), x, y, x + s * rng.uniform(0.5, 2), y + s))
    return out


DET = "clip_id long, frame_index long, det_id long, score double, x_min double, y_min double, x_max double, y_max double"


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    a, b = random_boxes(rng, 120, 0), random_boxes(rng, 120, 1000)
    got = mt.overlap_join(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET), 0.1).select("a_det_id", "b_det_id").collect()
    want = {(x[2], y[2]) for x in a for y in b if x[1] == y[1] and iou(x[4:], y[4:]) >= 0.1}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want


def test_greedy_match_equals_sequential(spark):
    rng = random.Random(2)
    rows = [(g, l, r, rng.randrange(6) / 6) for g in range(3) for l in range(12) for r in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "g long, l long, r long, v double")

    got = {(x["g"], x["l"], x["r"]) for x in mt.greedy_match(df, ["g"], "l", "r", [F.col("v").desc(), F.col("l"), F.col("r")]).collect()}
    want = set()
    for g in range(3):
        used_l, used_r = set(), set()
        for _, l, r, _v in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1], x[2])):
            if l not in used_l and r not in used_r:
                used_l.add(l), used_r.add(r), want.add((g, l, r))
    assert got == want


def test_suppression_equals_sequential_and_commutes_with_threshold(spark):
    rng = random.Random(3)
    dets = random_boxes(rng, 80, 0, spread=150)
    df = spark.createDataFrame(dets, DET)

    def sequential(rows):
        kept = []
        for d in sorted(rows, key=lambda d: (-d[3], d[2])):
            if all(k[1] != d[1] or iou(k[4:], d[4:]) <= 0.3 for k in kept):
                kept.append(d)
        return {d[2] for d in kept}

    got = {r["det_id"] for r in mt.suppress_overlaps(df, iou=0.3).collect()}
    assert got == sequential(dets) and len(got) < len(dets)
    first = {r["det_id"] for r in mt.suppress_overlaps(df.where("score >= 0.4"), iou=0.3).collect()}
    after = {r["det_id"] for r in mt.suppress_overlaps(df, iou=0.3).where("score >= 0.4").collect()}
    assert first == after


@pytest.mark.parametrize("limit", [mt.WALKED_PAIRS, 190])
def test_a_chain_and_a_crowded_frame(spark, monkeypatch, limit):
    """Box i of the chain drops box i + 1 unless it was dropped itself; the crowd is larger than what is walked at once."""
    monkeypatch.setattr(mt, "WALKED_PAIRS", limit)
    jobs = []
    real = mt.materialize_counted
    monkeypatch.setattr(mt, "materialize_counted", lambda *a: jobs.append(1) or real(*a))
    rng = random.Random(5)
    chain = [(1, 0, i, 1.0 - i / 1000, 6.0 * i, 0.0, 6.0 * i + 10, 10.0) for i in range(200)]
    crowd = [(2, 3, i, rng.random(), x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + 10, y + 10) for i in range(150)]
    got = {(r["clip_id"], r["det_id"]) for r in mt.suppress_overlaps(spark.createDataFrame(chain + crowd, DET), iou=0.2).collect()}
    kept = []
    for d in sorted(chain + crowd, key=lambda d: (-d[3], d[2])):
        if all(k[0] != d[0] or iou(k[4:], d[4:]) <= 0.2 for k in kept):
            kept.append(d)
    assert got == {(d[0], d[2]) for d in kept} and sum(c == 1 for c, _ in got) == 100
    assert len(jobs) == 1 if limit > 1000 else len(jobs) > 3

    links = 200 if limit > 1000 else 98  # a few pairs over the limit: a few rounds
    pairs = [(1, i, j, 500.0 - i - j) for i in range(links) for j in (i, i + 1)] + [(2, rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(400)]
    pairs = list({p[:3]: p for p in pairs}.values())
    df = spark.createDataFrame(pairs, "g long, l long, r long, v double")
    used, want = set(), set()
    for p in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if (p[0], "l", p[1]) not in used and (p[0], "r", p[2]) not in used:
            used |= {(p[0], "l", p[1]), (p[0], "r", p[2])}
            want.add(p[:3])
    assert {(r["g"], r["l"], r["r"]) for r in mt.greedy_match(df, ["g"], "l", "r", [F.col("v").desc(), F.col("l"), F.col("r")]).collect()} == want


def path(track, frames, u0, u1, v=0.5):
    n = len(frames)
    for i, f in enumerate(frames):
        u = u0 + (u1 - u0) * i / max(n - 1, 1)
        yield (1, track, f, u * W - 5, v * H - 5, u * W + 5, v * H + 5)


def outcomes(spark, ref, pred):
    r, p = (spark.createDataFrame(list(x), SCHEMA) for x in (ref, pred))
    rc, pc = ct.count_trajectories(r, W, H), ct.count_trajectories(p, W, H)
    f = mt.match_features(mt.match_tracks(r, p), rc, pc)
    return (
        {x["track_id"]: x["outcome"] for x in mt.reference_outcomes(f, rc).collect()},
        {x["track_id"]: x["outcome"] for x in mt.predicted_outcomes(f, pc).collect()},
    )


FULL = range(0, 21)


def test_error_classes(spark):
    fish = list(path(1, FULL, 0.2, 0.8))
    assert outcomes(spark, fish, list(path(7, FULL, 0.2, 0.8))) == ({1: "counted"}, {7: "counted"})
    assert outcomes(spark, fish, list(path(7, FULL, 0.2, 0.8, v=0.05)))[0] == {1: "missed_fish"}
    # two tracks follow the fish: the one with more shared frames counts, the other is a duplicate
    twice = list(path(7, FULL, 0.2, 0.8)) + [(c, 8, *rest) for c, _t, *rest in list(path(8, FULL, 0.2, 0.8))[2:]]
    assert outcomes(spark, fish, twice) == ({1: "counted"}, {7: "counted", 8: "duplicate"})
    parts = [(c, 7 if f < 9 else 8, f, *b) for c, _t, f, *b in path(1, FULL, 0.2, 0.8) if f != 9]
    assert outcomes(spark, fish, parts)[0] == {1: "split_track"}
    early = [x for x in path(7, FULL, 0.2, 0.8) if x[2] <= 6]
    assert outcomes(spark, fish, early)[0] == {1: "partial_track"}
    near = [x for x in path(7, FULL, 0.2, 0.8) if x[2] <= 9]
    assert outcomes(spark, fish, near)[0] == {1: "ambiguous_start_end"}
    assert outcomes(spark, list(path(1, FULL, 0.6, 0.6)), list(path(7, FULL, 0.2, 0.8, v=0.05)))[1] == {7: "background"}
