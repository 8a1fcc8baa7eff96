"""Language identification: held-out accuracy, the filter and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from shoalcount.llm import langid
from shoalcount.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, score string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = QUERIES["op4_langid"](spark, sf).join(docs, "doc_id").where("held_out and lang is not null")
    assert both.where("lang = lang_pred").count() / both.count() > 0.99
    assert both.where("score < 0 or score > 1").count() == 0


def test_filter_returns_all_languages_of_an_ngram():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 2**32, 3000).astype(np.uint32)) for _ in range(70)]  # two planes
    grams, codes = np.concatenate(own), np.repeat(np.arange(70), [len(o) for o in own])
    slots = np.concatenate([langid._slots(grams, k) for k in range(langid.HASHES)])
    held = langid.LanguageFilter([f"l{i:02}" for i in range(70)], slots, np.tile(codes, langid.HASHES))
    for i in (0, 63, 64, 69):
        votes = held.votes(own[i])
        assert votes[i] == len(own[i]) and np.delete(votes, i).max() < 0.01 * len(own[i])


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 20, "en"), (2, "der hund und die katze " * 20, "de"), (3, None, "en"), (4, "the dog", None), (5, "123 !?", "en"), (6, "", None), (None, "und die katze", None), (4, "the dog", None), (7, "Ω", None), (8, "the cat " * 50000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOCS)
    learned = langid.train(docs.where("doc_id < 4"))
    out = langid.predict(docs, learned, seen=F.col("doc_id") < 4).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == len(rows) and got == {1: "en", 2: "de", 3: "und", 4: "en", 5: "und", 6: "und", None: "de", 7: "de", 8: "en"}
    nothing = langid.train(docs.where(F.lit(False)))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where(F.lit(False)), learned).count() == 0
