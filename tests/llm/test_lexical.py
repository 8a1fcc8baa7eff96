"""Lexical search beside brute force, the sharing graph, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoalcount.llm import lexical
from shoalcount.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string, score string, rank int", "item_id bigint, text string, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_query_matches_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(QUERIES["op13_lexical"](spark, sf)) == want and len(want) > 100


def test_sharing_sums_are_plain_sums_with_fewer_additions():
    rng = random.Random(4)
    runs = [[b"r%d.%d" % (i, j) for j in range(6)] for i in range(8)]
    items = [{t for r in rng.sample(runs, 3) for t in r} | {b"x%d" % rng.randrange(60) for _ in range(4)} for _ in range(50)] + [set(), {b"alone"}]
    sharing = lexical.Sharing(items)
    leaves = np.array([[rng.randrange(1000) for _ in range(7)] for _ in sharing.terms], np.int64)
    place = {t: n for n, t in enumerate(sharing.terms)}
    want = np.array([[sum(leaves[place[t], d] for t in held) for d in range(7)] for held in items if held])
    assert (sharing.totals(leaves) == want).all()
    assert sharing.items[0].tolist() == [i for i, held in enumerate(items) if held]
    added = sum(len(below) for _, below, _ in [*sharing.levels, sharing.items])
    assert added < 0.6 * sum(map(len, items)) and len(sharing.levels) > 1


def test_odd_rows_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "é", "É", "ß7", "中文", "😀", "x1y2", "42", " ", "the", "İ", "K"]
    gaps = [" ", "\n", "-", "...", "\x7f", "`", "[", "\x00"]
    docs = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    docs += [(500 + i, "the same copy of alpha") for i in range(40)] + [(7, "the same copy of alpha"), (None, "the same copy of alpha"), (600, None), (601, ""), (602, " -- "), (None, None)]
    docs += [(700, "alpha " * 30000 + "beta")]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(30)] + [(30, "Same COPY"), (31, None), (32, ""), (33, "unheard of"), (None, "same alpha"), (5, "beta beta copy"), (34, "x" * 5000)]
    table = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], ITEMS)
    want = brute(docs, items)
    assert got(lexical.rank(table, asked)) == want
    assert got(lexical.rank(table, asked, k=3)) == brute(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    assert got(lexical.rank(table, asked)) == want
    assert got(lexical.rank(table.where(F.lit(False)), asked)) == [] == got(lexical.rank(table, asked.where(F.lit(False))))


def test_slices_and_thinning(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "B", "é", " ", "-", "7"]) for _ in range(3000))
    want = Counter(t.encode() for t in terms(text))
    monkeypatch.setattr(lexical, "SLICE", 7)
    assert lexical.term_counts(text.encode()) == want
    monkeypatch.setattr(lexical, "HELD", 30)
    best, rows = lexical._Best(4, 5), []
    for _ in range(40):
        totals = np.array([[rng.randrange(4) for _ in range(6)] for _ in range(4)], np.int64)
        docs, null = (np.array([rng.randrange(n) for _ in range(6)], np.int64) for n in (90, 2))
        best.add(totals, docs * (1 - null), null)
        rows += [(i, -totals[i, d], null[d], docs[d] * (1 - null[d])) for i in range(4) for d in range(6) if totals[i, d]]
    best.thin()
    item, score, docs, null = best.rows
    assert sorted(zip(item, -score, null, docs)) == [r for i in range(4) for r in sorted(x for x in rows if x[0] == i)[:5]]
