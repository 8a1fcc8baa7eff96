"""Assignment against enumeration; trackers against a plain restatement; batch = stream."""

import itertools
import random
from pathlib import Path

import numpy as np

from shoalcount.operators import tracking as tk
from shoalcount.streaming import jobs as sj

DET = "clip_id long, frame_index long, det_id long, x_min double, y_min double, x_max double, y_max double, score double"


def best(cost, allowed):
    n, m = cost.shape
    found = (0, 0.0)
    for choice in itertools.product(range(-1, m), repeat=n):
        used = [c for c in choice if c >= 0]
        if len(set(used)) != len(used) or any(c >= 0 and not allowed[i, c] for i, c in enumerate(choice)):
            continue
        total = sum(cost[i, c] for i, c in enumerate(choice) if c >= 0)
        found = min(found, (-len(used), total))
    return found


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 5, size=2)
        cost, allowed = rng.random((n, m)), rng.random((n, m)) < 0.6
        pairs = tk.assign(cost, allowed)
        assert all(allowed[i, j] for i, j in pairs)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        want = best(cost, allowed)
        assert -len(pairs) == want[0] and abs(sum(cost[i, j] for i, j in pairs) - want[1]) < 1e-9


def swimmers(seed, frames=60, fish=4, drop=0.15, quiet=()):
    """Fish in well separated lanes, with missed frames and quiet stretches."""
    rng = random.Random(seed)
    rows, det = [], 0
    truth = {}
    for f in range(frames):
        if f in quiet:
            continue
        for k in range(fish):
            if rng.random() < drop:
                continue
            x = (20 + 3 * f if k % 2 == 0 else 400 - 3 * f) + rng.uniform(-0.5, 0.5)
            y = 60.0 * k + 20
            rows.append((1, f, det, x, y, x + 30.0, y + 20.0, 0.9))
            truth[det] = k
            det += 1
    return rows, truth


def tracks_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["track_id"], set()).add(r["det_id"])
    return {frozenset(v) for v in out.values()}


def test_fish_keep_their_tracks_in_both_trackers(spark):
    rows, truth = swimmers(1)
    df = spark.createDataFrame(rows, DET)
    want = {frozenset(d for d, k in truth.items() if k == fish) for fish in range(4)}
    for config in (tk.KalmanConfig(gate_m=0.8), tk.ByteTrackConfig()):
        got = tk.track(df, [config], 0.05, 0.05).collect()
        assert tracks_of(got) == want
        assert {r["track_id"] for r in got} == {1, 2, 3, 4}


def test_cutting_at_quiet_stretches_changes_nothing(spark):
    """The same clip in one piece (plain runner) and cut by Spark into independent stretches."""
    rows, _ = swimmers(2, frames=80, quiet=set(range(20, 24)) | set(range(40, 60)))
    config = tk.KalmanConfig(gate_m=0.8, max_age=3, min_hits=1, min_length=1)
    df = spark.createDataFrame(rows, DET)
    got = tracks_of(tk.track(df, [config], 0.05, 0.05).collect())
    tracker, last, whole = tk._Kalman(config), None, {}
    for f in sorted({r[1] for r in rows}):
        for _ in range(0 if last is None else f - last - 1):
            tracker.step(np.empty((0, 7)))
        last = f
        d = [r for r in rows if r[1] == f]
        z = np.array([[(r[3] + r[5]) / 2 * 0.05, (r[4] + r[6]) / 2 * 0.05, *r[3:7], r[7]] for r in d])
        for r, label in zip(d, tracker.step(z)):
            whole.setdefault(label, set()).add(r[2])
    assert got == {frozenset(v) for v in whole.values()}


def test_kalman_arithmetic_matches_matrices():
    """The three-number covariance equals the full 4 x 4 filter."""
    c = tk.KalmanConfig(gate_m=10)
    k = tk._Kalman(c)
    Fm = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    Hm = np.eye(2, 4)
    q, r = c.process_noise**2, c.measurement_noise**2
    x, P = None, np.diag([0.01, 0.01, 1.0, 1.0])
    for z in ([0.0, 0.0], [0.3, 0.1], [0.5, 0.35], [0.9, 0.4]):
        z = np.array(z)
        k.step(np.array([[*z, 0, 0, 1, 1, 1.0]]))
        if x is None:
            x = np.array([*z, 0, 0])
        else:
            x, P = Fm @ x, Fm @ P @ Fm.T + np.eye(4) * q
            G = P @ Hm.T @ np.linalg.inv(Hm @ P @ Hm.T + np.eye(2) * r)
            x, P = x + G @ (z - Hm @ x), (np.eye(4) - G @ Hm) @ P
        np.testing.assert_allclose(np.r_[k.t.pos[0], k.t.vel[0]], x, atol=1e-12)
        np.testing.assert_allclose(k.t.pp[0, 0], P[0, 0], atol=1e-12)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    rows, _ = swimmers(3)
    config = tk.KalmanConfig(gate_m=0.8, min_hits=1, min_length=1)
    whole = tracks_of(tk.track(spark.createDataFrame(rows, DET), [config], 0.05, 0.05).collect())
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    Path(src).mkdir()
    stream = sj.track_stream(sj.read_stream(spark, src, DET), config, 0.05, 0.05)
    for part in (range(0, 25), range(25, 60)):
        batch = spark.createDataFrame([r for r in rows if r[1] in part], DET)
        batch.coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(out).withColumnRenamed("local_id", "track_id").collect()
    assert tracks_of(got) == whole
