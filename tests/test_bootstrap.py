"""Resampling from packed blocks beside plain draws, and its statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalcount.functions import hashing as hs
from shoalcount.operators import stats as st


def mixed(x):
    for _ in range(2):
        x = (x ^ x >> 16) * hs.MIXER % 2**32
    return x ^ x >> 16


def plain_pick(stream, draw, slot, n):
    key = mixed((mixed((stream + draw) % 2**32) + (draw >> 32)) % 2**32)
    return mixed(key ^ mixed(slot % 2**32)) % n


def test_mixer_is_the_same_everywhere(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2**32)), int(rng.integers(2**40)), int(rng.integers(2**34)), int(rng.integers(1, 10**6))) for _ in range(300)]
    df = spark.createDataFrame(rows, "s long, d long, k long, n long")
    got = df.select(hs.drawn(F.col("s"), F.col("d"), F.col("k"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == [plain_pick(*r) for r in rows]
    assert [int(hs.draw_keys(s, np.array([d]))[0]) for s, d, *_ in rows] == [mixed((mixed((s + d) % 2**32) + (d >> 32)) % 2**32) for s, d, *_ in rows]


def test_draws_are_even_and_independent():
    slots = hs.mix32_array(np.arange(500, dtype=np.uint32))
    picks = hs.mix32_array(hs.draw_keys(7, np.arange(4000))[:, None] ^ slots[None]) % 500
    counts = np.bincount(picks.ravel(), minlength=500)
    assert abs((counts - 4000).astype(float) ** 2 / 4000).sum() < 650  # chi-square of 499 degrees
    distinct = np.array([len(set(p)) for p in picks])
    assert abs(distinct.mean() - 500 * (1 - (1 - 1 / 500) ** 500)) < 0.7
    values = np.random.default_rng(0).normal(size=500)
    means = values[picks].mean(axis=1)
    assert abs(means.std() / (values.std() / 500**0.5) - 1) < 0.05 and abs(np.corrcoef(means[:-1], means[1:])[0, 1]) < 0.05


@pytest.mark.parametrize("block", [1 << 18, 16])
def test_sums_equal_plain_resampling(spark, monkeypatch, block):
    monkeypatch.setattr(st, "BLOCK", block)  # where tasks import the module afresh, only packing and pieces follow it
    monkeypatch.setattr(st, "DRAWS", 7)
    rng = np.random.default_rng(2)
    rows = [(g, f"c{i}", int(rng.integers(9)), float(rng.random()), None if i % 5 else 2) for g, n in (("a", 70), ("b", 1), ("c", 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, item string, v long, w double, z long")
    if block == 16:  # run the pieces here, where the smaller block holds
        blocks = st.packed(df.fillna(0), ["g"], "item", ["v", "w", "z"]).withColumn("stream", hs.hash32(3, F.col("g"))).toArrow()
        assert blocks.num_rows == 5 + 1 + 3
        out = {}
        for b in blocks.to_batches():
            for i in range(b.num_rows):
                for slots in range(-(-b.column("n")[i].as_py() // block)):
                    import pyarrow as pa

                    one = b.slice(i, 1).append_column("slots", pa.array([slots])).append_column("draws", pa.array([list(range(20))]))
                    for part in st._sums(["g"], ["v", "w", "z"])([one]):
                        for r in part.to_pylist():
                            at = out.setdefault((r["g"], r["draw"]), np.zeros(4))
                            at += (r["v"], r["w"], r["z"], r["drawn"])
    else:
        got = st.resample(df, ["g"], "item", ["v", "w", "z"], 20, 3, salt=["g"]).collect()
        out = {(r["g"], r["draw"]): np.array([r["v"], r["w"], r["z"], r["drawn"]], float) for r in got}
    index = {(r["g"], r["j"]): r for r in st.dense_index(df.fillna(0), ["g"], "item").collect()}
    streams = {r["g"]: r["s"] for r in df.select("g", hs.hash32(3, F.col("g")).alias("s")).distinct().collect()}
    for g, n in (("a", 70), ("b", 1), ("c", 33)):
        for draw in range(20):
            took = [index[g, plain_pick(streams[g], draw, j, n)] for j in range(n)]
            assert np.allclose(out[g, draw], [sum(r["v"] for r in took), sum(r["w"] for r in took), sum(r["z"] for r in took), n])
    assert len(out) == 60
