"""Trackers as Spark jobs: detections in, the same rows labelled with a track out.

A tracker is a recursion over frames, so its unit of work is a stretch of frames. A recording
is cut wherever no detection falls for longer than a track can survive: nothing crosses such a
gap, so the stretches are independent and a long recording spreads over many tasks. Inside a
task the rows stream by in frame order; only the live tracks are held, never the recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.functions import geometry as g
from shoalcount.operators.ordered import position, segment_starts
from shoalcount.session import materialize

KEYS = ["variant", "clip_id", "segment"]
OUT = "variant string, clip_id long, segment long, frame_index long, det_id long, local_id long"


# The defaults of both trackers.
@dataclass(frozen=True)
class KalmanConfig:
    name: str = "current"
    gate_m: float = 0.5
    gate_sigma: float | None = None
    max_age: int = 3
    min_hits: int = 3
    min_length: int = 3
    process_noise: float = 0.05
    measurement_noise: float = 0.05
    score_threshold: float = 0.0

    @property
    def patience(self) -> int:
        return self.max_age

    @property
    def keep(self) -> int:
        return max(self.min_hits, self.min_length)


@dataclass(frozen=True)
class ByteTrackConfig:
    name: str = "bytetrack"
    high_threshold: float = 0.5
    low_threshold: float = 0.1
    new_track_threshold: float = 0.6
    first_iou: float = 0.2
    second_iou: float = 0.5
    max_lost: int = 8
    min_length: int = 3
    score_threshold: float = 0.0

    def __post_init__(self) -> None:
        if self.low_threshold > self.high_threshold:
            raise ValueError(f"{self.low_threshold} as the low threshold is above the high one")

    @property
    def patience(self) -> int:
        return self.max_lost

    @property
    def keep(self) -> int:
        return self.min_length


#: Allowed pairs a row, on average, beyond which rows of a matrix beat lists of pairs.
CROWDED = 128
BIG = 1e6


def assign(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Most allowed pairs, then least total cost, one to one.

    Pairs that are each other's only option are settled directly; the rest grows shortest
    augmenting paths with dual prices, row by row.
    """
    rows, cols = np.nonzero(allowed.any(1))[0], np.nonzero(allowed.any(0))[0]
    sub = allowed[np.ix_(rows, cols)]
    alone = sub & (sub.sum(1, keepdims=True) == 1) & (sub.sum(0, keepdims=True) == 1)
    i, j = np.nonzero(alone)
    pairs = list(zip(rows[i].tolist(), cols[j].tolist()))
    rows, cols = np.delete(rows, i), np.delete(cols, j)
    if len(rows) == 0 or len(cols) == 0:
        return pairs
    cost, allowed = cost[np.ix_(rows, cols)], allowed[np.ix_(rows, cols)]
    solve = _paths_in_matrix if np.count_nonzero(allowed) > CROWDED * len(rows) else _paths_in_lists
    return pairs + [(int(rows[r]), int(cols[k])) for r, k in solve(cost, allowed)]


def _paths_in_lists(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Paths over each row's allowed columns: work in proportion to what they touch."""
    n, m = cost.shape
    # one private "stay unmatched" column per row makes every row assignable
    edges: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    at_row, at_col = np.nonzero(allowed)
    for r, k, c in zip(at_row.tolist(), at_col.tolist(), cost[at_row, at_col].tolist()):
        edges[r].append((k, c))
    price, owner, gain = [0.0] * (m + n), [-1] * (m + n), [0.0] * n
    for start in range(n):
        low, at = BIG, m + start
        for k, c in reversed(edges[start]):
            if c - price[k] <= low:
                low, at = c - price[k], k
        if owner[at] < 0:  # the nearest column is free: the path ends there
            gain[start], owner[at] = low, start
            continue
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        seen: dict[int, float] = {}
        row, low, at = start, 0.0, -1
        while True:
            paid = gain[row]
            for k, c in (*edges[row], (m + row, BIG)):
                if k not in seen:
                    reach = low + c - paid - price[k]
                    if reach < dist.get(k, np.inf):
                        dist[k], back[k] = reach, at
            low = min(dist.values())
            at = min([k for k, d in dist.items() if d == low])
            seen[at] = dist.pop(at)
            if owner[at] < 0:
                break
            row = owner[at]
        gain[start] += low
        for k, d in seen.items():
            if owner[k] >= 0:
                gain[owner[k]] += low - d
            price[k] -= low - d
        while at >= 0:
            prev = back[at]
            owner[at] = start if prev < 0 else owner[prev]
            at = prev
    return [(owner[k], k) for k in range(m) if owner[k] >= 0]


def _paths_in_matrix(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """The same paths over whole rows at a time, where most pairs are allowed."""
    n, m = cost.shape
    c = np.full((n, m + n), 2 * BIG)
    c[:, :m] = np.where(allowed, cost, 2 * BIG)
    c[np.arange(n), m + np.arange(n)] = BIG
    price, owner = np.zeros(m + n), np.full(m + n, -1)
    gain = np.zeros(n)
    for start in range(n):
        dist, back, seen = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, low, at = start, 0.0, -1
        while True:
            reach = low + c[row] - gain[row] - price
            better = ~seen & (reach < dist)
            dist[better], back[better] = reach[better], at
            nxt = int(np.argmin(np.where(seen, np.inf, dist)))
            low, at = dist[nxt], nxt
            seen[nxt] = True
            if owner[nxt] < 0:
                break
            row = owner[nxt]
        gain[start] += low
        used = seen & (owner >= 0)
        gain[owner[used]] += low - dist[used]
        price[seen] -= low - dist[seen]
        while at >= 0:
            prev = back[at]
            owner[at] = start if prev < 0 else owner[prev]
            at = prev
    return [(int(owner[k]), k) for k in range(m) if owner[k] >= 0 and c[owner[k], k] < BIG]


class _Tracks:
    """Live tracks as arrays. Every measured coordinate moves at constant velocity and is
    independent of the others, so its covariance is three numbers: pp, pv, vv."""

    def __init__(self, dims: int) -> None:
        self.pos, self.vel = np.empty((0, dims)), np.empty((0, dims))
        self.pp, self.pv, self.vv = (np.empty((0, dims)) for _ in range(3))
        self.id, self.misses = np.empty(0, np.int64), np.empty(0, np.int64)

    def predict(self, q_pos, q_vel) -> None:
        self.pos = self.pos + self.vel
        self.pp = self.pp + 2 * self.pv + self.vv + q_pos
        self.pv = self.pv + self.vv
        self.vv = self.vv + q_vel

    def correct(self, i: np.ndarray, z: np.ndarray, r) -> None:
        innovation = z - self.pos[i]
        s = self.pp[i] + r
        k1, k2 = self.pp[i] / s, self.pv[i] / s
        self.pos[i] += k1 * innovation
        self.vel[i] += k2 * innovation
        self.vv[i] -= k2 * self.pv[i]
        self.pp[i] *= 1 - k1
        self.pv[i] *= 1 - k1

    def keep(self, mask: np.ndarray) -> None:
        for f in ("pos", "vel", "pp", "pv", "vv", "id", "misses"):
            setattr(self, f, getattr(self, f)[mask])

    def start(self, z: np.ndarray, pp, vv, ids: np.ndarray) -> None:
        add = lambda a, b: np.concatenate([a, np.broadcast_to(b, z.shape)])
        self.pos, self.vel = add(self.pos, z), add(self.vel, 0.0)
        self.pp, self.pv, self.vv = add(self.pp, pp), add(self.pv, 0.0), add(self.vv, vv)
        self.id = np.concatenate([self.id, ids])
        self.misses = np.concatenate([self.misses, np.zeros(len(ids), np.int64)])


class _Kalman:
    """Distance-gated assignment of centres in metres."""

    def __init__(self, c: KalmanConfig) -> None:
        self.c, self.t, self.next_id = c, _Tracks(2), 1

    def step(self, d: np.ndarray) -> np.ndarray:
        c, t = self.c, self.t
        z = d[:, :2]
        t.predict(c.process_noise**2, c.process_noise**2)
        label = np.full(len(z), -1, np.int64)
        dx, dy = t.pos[:, :1] - z[None, :, 0], t.pos[:, 1:] - z[None, :, 1]
        dist = np.sqrt(dx * dx + dy * dy)
        allowed = dist <= c.gate_m
        if c.gate_sigma is not None:
            allowed &= dist / np.sqrt(t.pp[:, :1] + c.measurement_noise**2) <= c.gate_sigma
        pairs = assign(dist, allowed) if dist.size else []
        t.misses += 1
        if pairs:
            ti, di = (np.array(x) for x in zip(*pairs))
            t.correct(ti, z[di], c.measurement_noise**2)
            t.misses[ti] = 0
            label[di] = t.id[ti]
        t.keep(t.misses <= c.max_age)
        new = np.nonzero(label < 0)[0]
        label[new] = np.arange(self.next_id, self.next_id + len(new))
        t.start(z[new], 0.01, 1.0, label[new])
        self.next_id += len(new)
        return label


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = w.clip(0) * h.clip(0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


class _ByteTrack:
    """Two-stage overlap association; low-score boxes rescue tracks seen in the last frame.

    Coordinates are (cx, cy, aspect, height); noise scales with the height.
    """

    def __init__(self, c: ByteTrackConfig) -> None:
        self.c, self.t, self.next_id = c, _Tracks(4), 1

    @staticmethod
    def _noise(h: np.ndarray, weight: float, aspect: float) -> np.ndarray:
        return np.stack([weight * h, weight * h, np.full_like(h, aspect), weight * h], axis=1) ** 2

    def step(self, d: np.ndarray) -> np.ndarray:
        c, t = self.c, self.t
        b, score = d[:, 2:6], d[:, 6]
        size = b[:, 2:] - b[:, :2]
        z = np.column_stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, size[:, 0] / size[:, 1], size[:, 1]])
        h = t.pos[:, 3].copy()
        t.predict(self._noise(h, 1 / 20, 1e-2), self._noise(h, 1 / 160, 1e-5))
        half = np.column_stack([t.pos[:, 2] * t.pos[:, 3], t.pos[:, 3]]) / 2
        predicted = np.column_stack([t.pos[:, :2] - half, t.pos[:, :2] + half])
        label = np.full(len(b), -1, np.int64)
        fresh = t.misses == 0
        free = np.ones(len(t.id), bool)
        t.misses += 1
        high = score >= c.high_threshold
        low = (score >= c.low_threshold) & ~high
        for pool, who, least in ((high, free.copy(), c.first_iou), (low, fresh, c.second_iou)):
            ti, di = np.nonzero(who & free)[0], np.nonzero(pool)[0]
            if len(ti) == 0 or len(di) == 0:
                continue
            iou = _overlap(predicted[ti], b[di])
            if pairs := assign(1 - iou, iou >= least):
                i, j = (np.array(x) for x in zip(*pairs))
                at, got = ti[i], di[j]
                t.correct(at, z[got], self._noise(t.pos[at, 3], 1 / 20, 1e-1))
                t.misses[at], free[at], label[got] = 0, False, t.id[at]
        t.keep(t.misses <= c.max_lost)
        new = np.nonzero(high & (label < 0) & (score >= c.new_track_threshold))[0]
        label[new] = np.arange(self.next_id, self.next_id + len(new))
        hh = z[new, 3]
        t.start(z[new], self._noise(hh, 2 / 20, 1e-2), self._noise(hh, 10 / 160, 1e-5), label[new])
        self.next_id += len(new)
        return label


def _frames(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of whole frames, in order, with where each frame starts and the last one ends; the
    last frame of a batch waits for the next batch."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        fresh = np.zeros(len(pdf), bool)
        fresh[:1] = True
        for c in (*KEYS, "frame_index"):
            v = pdf[c].to_numpy()
            fresh[1:] |= v[1:] != v[:-1]
        cut = np.nonzero(fresh)[0].tolist()
        if len(cut) > 1:
            yield pdf.iloc[: cut[-1]], cut
        rest = pdf.iloc[cut[-1]:] if cut else pdf
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


def _runner(configs: dict[str, KalmanConfig | ByteTrackConfig]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracker, last = None, None, 0
        empty = np.empty((0, 7))
        for pdf, cut in _frames(batches):
            variant, clip, segment, frames = (pdf[c].to_numpy() for c in (*KEYS, "frame_index"))
            rows, label = pdf[["cx", "cy", *g.EDGES, "score"]].to_numpy(float), np.empty(len(pdf), np.int64)
            for a, b in zip(cut[:-1], cut[1:]):
                key, frame = (variant[a], clip[a], segment[a]), int(frames[a])
                if key != current:
                    config = configs[key[0]]
                    tracker = _Kalman(config) if isinstance(config, KalmanConfig) else _ByteTrack(config)
                    current, last = key, frame - 1
                for _ in range(frame - last - 1):
                    tracker.step(empty)
                last = frame
                label[a:b] = tracker.step(rows[a:b])
            yield pdf[[*KEYS, "frame_index", "det_id"]].assign(local_id=label)

    return run


def track(detections: DataFrame, configs: Sequence[KalmanConfig | ByteTrackConfig], mx: Column | float, my: Column | float) -> DataFrame:
    """Tracks of every configuration in one job.

    ``detections``: (clip_id, frame_index, det_id, box, score). Result: one row per kept
    detection with ``variant`` and ``track_id``, numbered 1..n per recording in order of
    first appearance; short tracks are dropped.
    """
    by_name = {c.name: c for c in configs}
    if len(by_name) != len(configs):
        raise ValueError("configuration names must be unique")
    rows = F.array(*[F.struct(F.lit(c.name).alias("variant"), F.lit(c.patience).alias("patience"), F.lit(float(c.score_threshold)).alias("floor"), F.lit(c.keep).alias("keep")) for c in configs])
    spread = detections.withColumn("v", F.explode(rows)).where(F.col("score") >= F.col("v.floor"))
    spread = spread.select("*", "v.variant", "v.patience", "v.keep").drop("v")
    # A detection at distance patience + 1 can still be matched; beyond it nothing survives.
    seg = segment_starts(spread, ["variant", "patience", "clip_id"], "frame_index", F.col("patience") + 1)
    cx, cy = g.center_m(g.box(), F.lit(mx), F.lit(my))
    ready = spread.join(seg, ["variant", "patience", "clip_id", "frame_index"]).select(
        *KEYS, "frame_index", "det_id", cx.alias("cx"), cy.alias("cy"), *g.EDGES, "score"
    )
    ordered = ready.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame_index", "det_id")
    # Stored once: the labels are read for the track lengths and again for the rows.
    labelled = materialize(ordered.mapInPandas(_runner(by_name), OUT).where("local_id > 0"))
    kept = F.element_at(F.create_map(*[x for c in configs for x in (F.lit(c.name), F.lit(c.keep))]), F.col("variant"))
    long_enough = labelled.groupBy(*KEYS, "local_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= kept)
    numbered = renumber(long_enough)
    named = labelled.join(numbered, [*KEYS, "local_id"]).drop("segment", "local_id")
    return named.join(detections, ["clip_id", "frame_index", "det_id"])


def renumber(tracks: DataFrame) -> DataFrame:
    """Track numbers 1..n per (variant, recording) in order of creation."""
    order = [F.col("segment"), F.col("local_id")]
    placed = position(tracks.select(*KEYS, "local_id"), ["variant", "clip_id"], F.floor(F.col("segment") / 256), order, "track_id")
    return placed.select(*KEYS, "local_id", (F.col("track_id") + 1).alias("track_id"))


def dense_track_ids(boxes: DataFrame) -> DataFrame:
    """Renumber the raw track IDs of each recording to 1..n in ID order."""
    ids = boxes.select("clip_id", F.col("track_id")).distinct()
    placed = position(ids, ["clip_id"], F.floor(F.col("track_id") / 1024), [F.col("track_id")], "new_id")
    return boxes.join(placed.withColumn("new_id", F.col("new_id") + 1), ["clip_id", "track_id"])


def describe(configs: Sequence[KalmanConfig | ByteTrackConfig]) -> list[dict]:
    return [asdict(c) for c in configs]
