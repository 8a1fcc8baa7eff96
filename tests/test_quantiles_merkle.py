"""Exact quantiles beside numpy, and trees of hashes."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalcount.operators import merkle, quantiles


@pytest.mark.parametrize("sorted_rows", [4096, 8])
def test_quantiles_equal_numpy(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(quantiles, "SORTED", sorted_rows)
    monkeypatch.setattr(quantiles, "PARTS", 512)
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.random(500), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([7.0]), "same": np.full(50, -1.5),
        "tail": 10.0 ** rng.uniform(-300, 300, 300), "both": np.concatenate([-(10.0 ** rng.uniform(0, 308, 60)), [1.7e308, -1.7e308, 0.0]]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("even", math.nan), ("none", None)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.025, "mid": 0.5, "top": 1.0}).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        with np.errstate(over="ignore"):
            xs = np.sort(groups[r["g"]])
        for name, f in (("low", 0.025), ("mid", 0.5), ("top", 1.0)):
            p = f * (len(xs) - 1)
            a, b = xs[math.floor(p)], xs[math.ceil(p)]
            want = a if math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
            assert r[name] == pytest.approx(want, rel=1e-12)


def test_ordered_digest_is_a_tree(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def tree(leaves):
        for _ in range(3):
            up = {}
            for at, d in sorted(leaves):
                up.setdefault(at >> 10, []).append(f"{at}={d}")
            leaves = [(at, sha(",".join(x))) for at, x in up.items()]
        return sha(",".join(f"{at}={d}" for at, d in sorted(leaves)))

    rows = {"a": [(i, f"d{i}") for i in range(3000)], "b": [(0, "x")], "c": [(1 << 35, "p"), (5, "q"), (1 << 20, "r")]}
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "k string, at long, digest string")
    assert {r["k"]: r["digest"] for r in merkle.ordered_digest(df.repartition(3), ["k"]).collect()} == {k: tree(rs) for k, rs in rows.items()}


def test_table_digest_sees_every_row_and_no_order(spark):
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    digest = lambda t: tuple(merkle.table_digest(t, F.col("name")).first())
    one = digest(df)
    assert digest(df.orderBy(F.rand(3)).repartition(7)) == one and one[1] == 500
    assert digest(df.unionByName(df.where("id = 3")))[0] != one[0]
    assert digest(df.where("id <> 3"))[0] != one[0] and digest(df.withColumn("id", F.expr("if(id = 3, 4, id)")))[0] != one[0]
    assert digest(df.where("false")) == (hashlib.sha256(b"").hexdigest(), 0)
