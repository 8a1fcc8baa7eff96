"""The Kneser-Ney model beside a plain implementation, separation of labelled junk, odd rows."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shoalcount.llm import quality_lm

DOCS = "doc_id bigint, text string, lang string, kept string, block string"
LABELS = "doc_id bigint, quality int, lang string"


def plain_model(texts, order=quality_lm.ORDER):
    """log p(byte | bytes before) straight from the definition."""
    grams = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        grams[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n].update(g[1:] for g in grams[n + 1])
    model = {}
    for n in range(1, order + 1):
        of = Counter(grams[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0
        d = {k: max(quality_lm.LEAST_DISCOUNT, k - (k + 1) * y * of[k + 1] / of[k]) if of[k] and of[k + 1] else k / 2 for k in (1, 2, 3)}
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in grams[n].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        model[n] = ({g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in grams[n].items()}, {g: mass[g] / total[g] for g in total})

    def log_p(gram):
        p = 1 / 256
        for n in range(1, order + 1):
            terms, weights = model[n]
            p = terms.get(gram[-n:], 0.0) + weights.get(gram[-n:-1], 1.0) * p
        return math.log(p)

    return log_p


def test_matches_plain_model(spark):
    texts = ["the cat sat on the mat and the dog sat on the log " * 3, "a cat and a dog, a mat and a log é", "ununterbrochen", "zzz the cat é"]
    rows = [(i, t, "en" if i != 2 else None, "k", "b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    got = {r["doc_id"]: r["log_prob"] for r in quality_lm.perplexities(docs, trusted).collect()}
    log_p = plain_model(texts[:2])
    for i, t in enumerate(texts):
        b = b"\0" * (quality_lm.ORDER - 1) + t.encode()
        want = sum(log_p(b[k : k + quality_lm.ORDER]) if i != 2 else -math.log(256) for k in range(len(t.encode())))
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_probabilities_sum_to_one():
    log_p = plain_model(["abracadabra abracadabra", "cadabra"])
    assert math.isclose(sum(math.exp(log_p(b"adab"[-quality_lm.ORDER + 1 :] + bytes([c]))) for c in range(256)), 1, rel_tol=1e-9)


def test_labelled_junk_goes_and_clean_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_lm.classify(docs, labels).join(labels, "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] / (counts[1, True] + counts.get((1, False), 0)) > 0.97
    assert counts[0, False] / (counts[0, False] + counts.get((0, True), 0)) > 0.8
    kept = quality_lm.survivors(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_lm.classify(docs, labels).where("kept").count()


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "text", "xx"), (None, "text", "en"), (4, "same", "en"), (4, "same", "en"), (5, "long " * 60000, "en"), (6, "word", "en")]
    docs = spark.createDataFrame([(*r, "k", "b") for r in rows], DOCS)
    labels = spark.createDataFrame([(4, 1, "l"), (5, 1, "l"), (6, 1, "l"), (6, 0, "l"), (None, 1, "l"), (99, 1, None), (7, None, None)], LABELS)
    out = quality_lm.classify(docs, labels).collect()
    assert len(out) == len(rows)
    keys = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()
    assert sorted(r["text_key"] for r in out) == sorted(r["k"] for r in keys)
    assert all(r["perplexity"] is None and r["kept"] for r in out if r["doc_id"] in (1, 2))
    assert [r["threshold"] for r in out if r["doc_id"] == 3] == [None]
    assert quality_lm.survivors(docs, labels).count() == sum(r["kept"] for r in out)
    none = spark.createDataFrame([], LABELS)
    assert quality_lm.classify(docs, none).where("kept").count() == len(rows)
    assert quality_lm.classify(docs.where(F.lit(False)), labels).count() == 0


def test_four_bytes_of_context_count(spark):
    docs = spark.createDataFrame([(0, "1abcX 2abcY " * 50, "en", "k", "b"), (1, "1abcX", "en", "k", "b"), (2, "1abcY", "en", "k", "b")], DOCS)
    trusted = spark.createDataFrame([(0,)], "doc_id bigint")
    got = {r["doc_id"]: r["log_prob"] for r in quality_lm.perplexities(docs, trusted).collect()}
    assert got[1] > got[2] + 1  # "abc" alone leaves X and Y equally likely
