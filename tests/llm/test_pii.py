"""Patterns beside the regular expressions as stated, consistency through skip links, odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from shoalcount.llm import pii

DOCS = "doc_id bigint, text string, spans string, n_email string"
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_on_random_texts():
    rng = random.Random(11)
    for _ in range(6000):
        text = "".join(rng.choice("0123456789.@+ -()ab%é\n" if rng.random() < 0.8 else "4111111111111111") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == stated(text), text
    assert pii.base_spans("x" * 300000 + "@" + "1" * 300000 + "." * 1000 + "+1" * 1000) is not None


def test_query_base_columns(spark, sf):
    from shoalcount.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_pii"](spark, sf).collect():
        base = stated(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_similar_mentions_take_the_label_and_strangers_do_not(spark):
    line = "call +1 (239) 555-8522 or write ann.lee@mail.example.com today. "
    rows = [(i, line + f"again ann.lee@mail.example.com and +1 (239) 555-{1000 + i} number 83{i:03}72{i:04}", "s", "n") for i in range(60)]
    rows += [(100, line + "text " * 50 + "later 1-239-555-8522 and ann.lee@mail", "s", "n"), (101, "no one 1-239-555-8522 here, ann.lee@mail", "s", "n")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["found"]] for r in pii.find(docs, pii.train(docs)).collect()}
    assert ("phone", "1-239-555-8522") in found[100]
    assert found[101] == [] and all(len(found[i]) == 4 for i in range(60))


def test_messages_on_a_tree_are_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    field = pii.Field({}, rng.normal(size=5), rng.normal(size=(5, 5)), 1.5)
    nodes = [pii.Mention(i, i + 1, "card" if i == 1 else "O", "s", "") for i in range(4)]
    weights = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        if labels[1] == 2:
            w = np.exp(sum(field.unseen[x] for i, x in enumerate(labels) if i != 1) + sum(field.chain[a, b] for a, b in zip(labels, labels[1:])))
            for i, x in enumerate(labels):
                weights[i, x] += w
    assert np.allclose(field.beliefs(nodes), weights / weights.sum(axis=1, keepdims=True), atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "1.2.3.4"), (3, "1.2.3.4"), (4, "9" * 200000), (5, "@ " * 20000)]
    docs = spark.createDataFrame([(*r, "s", "n") for r in rows], DOCS)
    out = pii.find(docs, pii.train(docs)).collect()
    assert len(out) == len(rows) and {r["doc_id"]: r["spans"] for r in out} == {1: "", 2: "", None: "email:0:5", 3: "ip:0:7", 4: "", 5: ""}
    assert pii.find(docs.where(F.lit(False)), pii.train(docs.where(F.lit(False)))).count() == 0


def test_copies_of_the_corpus_leave_spans_unchanged(spark):
    line = "call +1 (239) 555-8522 or write ann.lee@mail.example.com today. "
    rows = [(i, line + f"number 83{i:03}72{i:04} again ann.lee@mail.example.com and +1 (239) 555-{1000 + i}", "s", "n") for i in range(60)]
    rows += [(100, line + "text " * 50 + "later 1-239-555-8522", "s", "n"), (101, "no one 1-239-555-8522 here", "s", "n")]
    docs = spark.createDataFrame(rows, DOCS)
    spans = []
    for copies in (1, 200):
        field = pii.train(docs.crossJoin(spark.range(copies)).drop("id"))
        spans.append({r["doc_id"]: r["spans"] for r in pii.find(docs, field).collect()})
    assert spans[0] == spans[1] and "phone:320:334" in spans[1][100] and spans[1][101] == ""
