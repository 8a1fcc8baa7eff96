"""SimHash classes beside brute force, and hot keys."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shoalcount.llm import simhash
from shoalcount.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, label string, fp string"


def brute(rows, words=3, bits=2):
    def print_of(text):
        tokens = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if t]
        if not tokens:
            return 0
        grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    arr = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= bits):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def got(df):
    return sorted(((r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy", [256, 1])
def test_matches_brute_force(spark, sf, heavy):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.classify(docs, heavy=heavy)) == brute(rows)


def test_query_columns(spark, sf):
    df = QUERIES["op10_simhash"](spark, sf)
    want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want


@pytest.mark.parametrize("heavy", [256, 4])
def test_links_reach_every_close_pair(spark, heavy):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 30)
    prints = set(base.tolist())
    for b in base[:6].tolist():
        for _ in range(60):
            v = np.int64(b)
            for bit in rng.integers(0, 63, rng.integers(1, 4)):
                v ^= np.int64(1) << np.int64(bit)
            prints.add(int(v))
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = {tuple(sorted(r)) for r in simhash.links(df, heavy).collect()}
    close = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert edges <= close
    labels = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(list(close), "a bigint, b bigint")).collect()}
    again = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(list(edges), "a bigint, b bigint")).collect()}
    assert labels == again


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "one", "x"), (5, "ONE", "x"), (5, "ONE", "x"), (None, "two words", "x"), (6, "a b c d " * 30000, "x")]
    docs = spark.createDataFrame([(*r, "l", "f") for r in rows], DOCS)
    assert got(simhash.classify(docs)) == brute([r[:2] for r in rows])
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 6]
    assert simhash.classify(docs.where(F.lit(False))).count() == 0
    assert simhash.survivors(docs.where(F.lit(False))).count() == 0
