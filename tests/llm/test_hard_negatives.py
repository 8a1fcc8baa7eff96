"""Hard negatives beside brute force, the bounds, copies, ties and odd vectors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalcount.llm import hard_negatives as hn
from shoalcount.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<double>, label int, rank string, block int"


def brute(rows, k=5, m=3):
    fit = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = Counter()
    for at, (i, a, label) in enumerate(fit):
        if i % 50:
            continue
        scored = sorted((-clamp(sum(x * y for x, y in zip(a, v))), j, c) for n, (j, v, c) in enumerate(fit) if n != at and len(v) == len(a))
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            found = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:m]
            for r, s in enumerate(found):
                out[(i, j, r + 1, s[1], -p, -s[0])] += 1
    return out


def got(df):
    return Counter(map(tuple, df.collect()))


def test_query_matches_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(QUERIES["op11_hard_negatives"](spark, sf)) == want and len(want) > 50


@pytest.mark.parametrize("dim", [2, 64, 3000])
def test_bounds_hold_and_cut(dim):
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(5, dim))
    x = np.floor(256 * (centre[rng.integers(0, 5, 300)] + 0.05 * rng.normal(size=(300, dim))) * 10.0 ** rng.integers(-2, 3, (300, 1)))
    x[:3] = 0
    x[3:6] = x[6:9] = x[9:12]
    norms = np.linalg.norm(x, axis=1)
    angles = hn.angles_to(x, norms, hn.fitted(x))
    low, high = hn.score_bounds(angles, angles, norms, norms, hn.slack(dim))
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    free = norms[:, None] * norms[None] > 0
    assert np.median(((high - low)[free]) / (2 * (norms[:, None] * norms[None])[free])) < 0.6


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 6))
    rows = [(int(i), (centre[i % 4] + 0.4 * rng.normal(size=6)).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5], i % 3) for i in range(400, 520)]
    rows += [rows[50]] * 3 + [rows[51]] * 4 + [(100, [0.5] * 6, 1), (100, [0.25] * 6, 2), (101, [0.5] * 6, 1)]
    rows += [(600, None, 1), (650, [], 1), (651, [], 1), (652, [], 2), (700, [0.0] * 6, 1), (750, [1.0, None, 1, 1, 1, 1], 1), (800, [math.nan] * 6, 1), (850, [math.inf] * 6, 1)]
    rows += [(None, [1.0] * 6, 1), (900, [1.0] * 6, None), (950, [1.0, 2.0], 1), (951, [1.0, 2.0], 1), (952, [0.5, 1.5], 2), (1000, [1e-9] * 6, 0), (1050, [-1e-9] * 6, 0)]
    rows += [(1100, [1e7, 1.0, 0, 0, 0, 0], 7), (1101, [1e7, 2.0, 0, 0, 0, 0], 7), (1102, [9e6, 7.0, 0, 0, 0, 0], 8), (1103, [9e6, 7.0, 0, 0, 0, 0.5], 8)]
    rows += [(1150, [1e200] * 3, 1), (1151, [1e200] * 3, 1), (1152, [1e20, 0.0, 0.0], 2), (1153, [-1e200, 1e200, 1e-3], 2)]
    rows = [(i, v and [x if x is None else float(x) for x in v], c) for i, v, c in rows]
    table = spark.createDataFrame([(*r, "r", 1) for r in rows], VECTORS)
    assert sum((want := brute(rows)).values()) > 100 and {1100, 650} <= {k[0] for k in want}
    assert got(hn.mine(table, F.col("vec_id") % 50 == 0)) == want
    assert got(hn.mine(table, F.col("vec_id") % 50 == 0, positives=2, negatives=7)) == brute(rows, 2, 7)
    assert hn.mine(table.where(F.lit(False)), F.lit(True)).count() == 0


def test_small_blocks(monkeypatch):
    """Packing, tiles and thinning with blocks of a few rows, as tasks run them."""
    monkeypatch.setattr(hn, "CELLS", 50)
    monkeypatch.setattr(hn, "PAIRS", 7)
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(40, 5)))
    norms = np.linalg.norm(x, axis=1)
    angles = hn.angles_to(x, norms, hn.fitted(x))
    row = {"dim": 5}
    for side in "qc":
        label = np.arange(40) % 2
        row |= {f"{side}_n": 40, f"{side}_kind": "int16", f"{side}_ids": np.arange(40).tobytes(), f"{side}_label": label.tobytes(), f"{side}_copies": np.ones(40, int).tobytes()}
        row |= {f"{side}_codes": x.astype(np.int16).tobytes(), f"{side}_norms": norms.tobytes(), f"{side}_angles": angles.tobytes()}
    q, c = hn._Side(row, "q"), hn._Side(row, "c")
    pairs = {(i, j): s for a, b, e in hn.surviving(q, c, lambda r: q.label[r, None] == c.label[None], lambda r, lo, hi: hi > 1e5) for i, j, s in zip(a, b, e)}
    exact = (x @ x.T).astype(int)
    assert all(pairs[i, j] == exact[i, j] for i in range(40) for j in range(40) if (i - j) % 2 == 0 and exact[i, j] > 1e5)
    assert all((i - j) % 2 == 0 and s == exact[i, j] for (i, j), s in pairs.items())
