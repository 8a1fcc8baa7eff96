"""Resampling beyond one block: a slot is drawn once for a span of blocks, with the sums of plain draws."""

import numpy as np
import pyarrow as pa
import pytest

from shoalcount.functions import hashing as hs
from shoalcount.operators import stats as st


def work(n, block, draws, values, slots):
    rows = [values[at : at + block] for at in range(0, n, block)]
    for i, v in enumerate(rows):
        yield pa.RecordBatch.from_pydict({
            "g": ["all"], "n": [n], "block": [i], "slots": pa.array([slots]), "stream": [11], "draws": [list(range(draws))], "v": [v],
        })


@pytest.mark.parametrize("span", [2, 8])
def test_spans_of_blocks(monkeypatch, span):
    monkeypatch.setattr(st, "BLOCK", 16)
    monkeypatch.setattr(st, "SPAN", span)
    mixed, shapes = st.mix32_array, []
    monkeypatch.setattr(st, "mix32_array", lambda x: shapes.append(x.size) or mixed(x))
    n, draws = 100, 6
    values = np.random.default_rng(0).integers(-500, 70_000, n).tolist()
    total, drawn, pieces = np.zeros(draws, np.int64), np.zeros(draws, np.int64), 0
    for slots in range(-(-n // (16 * span))):
        for out in st._sums(["g"], ["v"])(work(n, 16, draws, values, slots)):
            pieces += 1
            total += out.column("v").to_numpy()
            drawn += out.column("drawn").to_numpy()
    picks = mixed(hs.draw_keys(11, np.arange(draws))[:, None] ^ mixed(np.arange(n, dtype=np.uint32))[None]) % n
    assert total.tolist() == np.array(values)[picks].sum(axis=1).tolist() and (drawn == n).all()
    spans = -(-n // (16 * span))
    assert pieces == spans * spans
    assert sum(shapes) == spans * n * (draws + 1)  # every slot is mixed once a span, not once a block
