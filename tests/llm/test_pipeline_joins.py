"""The pipeline's SimHash stage broadcasts no opened fingerprints."""

import re

import corpus_pipeline
from shoalcount.llm import simhash


def test_near_stage(spark, sf, monkeypatch):
    plans, links = [], simhash.links

    def seen(*args):
        plans.append(links(*args))
        return plans[-1]

    monkeypatch.setattr(simhash, "links", seen)
    docs = spark.createDataFrame([(i, f"some words of text number {i // 2}") for i in range(20)], "doc_id bigint, text string")
    assert corpus_pipeline.near(spark, docs, sf).count() == 10
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"(\w+) \[k0#\d+L\], \[k1#\d+L\]", plan)) == {"SortMergeJoin"}
