"""Neighbour search beside brute force, the error bound, ties and odd vectors."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoalcount.llm import ann
from shoalcount.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, score string, block string"


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for at, (q, a) in enumerate(rows):
        if q % 50:
            continue
        near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for n, (i, b) in enumerate(rows) if n != at and len(b) == len(a))
        out.update((q, r + 1, i, round(-s, 12)) for r, (s, i) in enumerate(near[:k]))
    return out


def got(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect())


def test_query_matches_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op8_ann"](spark, sf)) == brute(rows)


def test_survivors_hold_the_true_neighbours():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 32)) * 10.0 ** rng.integers(-20, 20, (400, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    side = (np.arange(400), x, *ann.quantised(unit), np.ones(400, int))
    qi, ci = ann.survivors(side, side, 3, np.full(400, -np.inf))
    pairs = set(zip(qi.tolist(), ci.tolist()))
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    assert all((i, j) in pairs for i in range(400) for j in np.argsort(-cos[i])[:3].tolist())
    assert len(pairs) < 400 * 40


def test_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 460)]
    rows += [(500, None), (550, []), (600, [0.0] * 6), (650, [1.0, None] + [1.0] * 4), (700, [float("nan")] + [1.0] * 5), (750, [float("inf")] + [1.0] * 5)]
    rows += [rows[50]] * 3 + [rows[51]] * 7 + [(100, [2.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (101, rows[100][1])]
    rows += [(None, [1.0] * 6), (800, [1.0, 2.0, 3.0]), (801, [1.0, 2.0, 2.0]), (850, [1.0] * 7), (900, [1e-30] * 6), (900, [1e-30] * 6)]
    vectors = spark.createDataFrame([(*r, "s", "b") for r in rows], VECTORS)
    every = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(every)
    assert got(ann.nearest(vectors, F.col("vec_id") % 50 == 0)) == want
    monkeypatch.setattr(ann, "BLOCK", 64)
    assert got(ann.nearest(vectors, F.col("vec_id") % 50 == 0)) == want
    assert ann.nearest(vectors.where(F.lit(False)), F.lit(True)).count() == 0
