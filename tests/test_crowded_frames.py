"""Assignment in crowded frames: whole rows and lists of pairs agree, and work follows the pairs."""

import numpy as np
import pytest

from shoalcount.operators import tracking as tk


@pytest.mark.parametrize("ties", [False, True])
def test_lists_and_rows_find_the_same_pairs(ties, monkeypatch):
    rng = np.random.default_rng(3)
    for share in (0.03, 0.1, 0.4, 0.9):
        for _ in range(60):
            n, m = rng.integers(1, 30, size=2)
            cost, allowed = rng.random((n, m)), rng.random((n, m)) < share
            cost = np.floor(cost * 4) / 4 if ties else cost
            monkeypatch.setattr(tk, "CROWDED", 10**9)
            lists = sorted(tk.assign(cost, allowed))
            monkeypatch.setattr(tk, "CROWDED", 0)
            assert lists == sorted(tk.assign(cost, allowed))


def test_a_frame_of_near_neighbours_is_not_walked_by_whole_rows(monkeypatch):
    """A few allowed pairs a row: the path over them never looks at a matrix of rows and columns."""
    rows, cols = [], []
    monkeypatch.setattr(tk, "_paths_in_matrix", lambda *a: rows.append(a) or [])
    lists = tk._paths_in_lists
    monkeypatch.setattr(tk, "_paths_in_lists", lambda *a: cols.append(a) or lists(*a))
    at = np.arange(300.0)
    dist = np.abs(at[:, None] - at[None, :] - 0.4)
    assert len(tk.assign(dist, dist <= 1.5)) == 300
    assert len(cols) == 1 and not rows


def test_low_scores_are_settled_at_once():
    """One correction a round of the two-stage tracker, however many boxes it matches."""
    calls = []
    t = tk._ByteTrack(tk.ByteTrackConfig())
    correct = t.t.correct
    t.t.correct = lambda i, z, r: calls.append(len(i)) or correct(i, z, r)
    x = np.arange(40.0) * 50
    boxes = np.column_stack([x, x, x, np.zeros(40), x + 30, np.full(40, 20.0), np.full(40, 0.9)])
    first = t.step(boxes)
    assert (t.step(boxes) == first).all() and calls == [40]
