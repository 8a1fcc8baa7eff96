"""The pipeline: every stage beside a plain statement of what it keeps."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shoalcount.llm import bpe, mixing, quality_lm, simhash
from shoalcount.session import materialize


def lower(text):
    return (text or "").encode().lower()


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        out.append((name, docs))
    return out


def test_stages(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs, *[d for _, d in stages]]
    assert all(d.columns == docs.columns for d in held[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in held]

    judged = quality_lm.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert set(rows[1]) == {r["doc_id"] for r in judged if r["kept"]} and len(rows[1]) < len(rows[0])

    best = {}
    for i, r in rows[1].items():
        best[lower(r["text"])] = max(i, best.get(lower(r["text"]), i))
    assert set(rows[2]) == set(best.values()) and len(rows[2]) < len(rows[1])

    prints = {i: simhash.fingerprint(r["text"]) for i, r in rows[2].items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert set(rows[3]) == {i for i in prints if find(i) == i}

    plan = sorted((r["position"], r["doc_id"]) for r in mixing.schedule(held[3]).collect())
    assert [i for _, i in plan] == [r["doc_id"] for r in mixing.mixed(held[3]).collect()]
    assert rows[4] == rows[3]

    library = Tokenizer.from_file(bpe.production_file())
    for i, r in rows[5].items():
        ids = library.encode(rows[4][i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert set(rows[5]) == set(rows[4])


def test_run_gives_the_last_stage(spark, sf, stages):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(stages[-1][1].collect())
