"""Exact dedup: the index across batches, repeated rows and odd texts."""

from pyspark.sql import functions as F

from shoalcount.llm import exact_dedup
from shoalcount.session import scratch_dir

DOCS = "doc_id bigint, text string, kept string, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "d") for r in rows], DOCS)


def test_decisions_and_survivors(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "solo"), (7, "solo"), (None, "ab"), (8, "x" * 200000)]
    docs = docs_of(spark, rows)
    out = {(r["doc_id"], r["text_sha256"][:6]): r for r in exact_dedup.decide(docs, exact_dedup.fresh_index(spark)).collect()}
    by = {k[0]: v for k, v in out.items()}
    assert (by[1]["keep_id"], by[1]["kept"], by[2]["kept"], by[1]["group_size"]) == (2, False, True, 3)
    assert (by[3]["keep_id"], by[4]["kept"], by[5]["kept"], by[6]["kept"]) == (4, True, True, True)
    decided = exact_dedup.decide(docs, exact_dedup.fresh_index(spark))
    assert decided.count() == len(rows) and decided.where("doc_id = 7 and kept").count() == 1
    kept = exact_dedup.survivors(docs, exact_dedup.fresh_index(spark))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8]
    assert exact_dedup.survivors(docs.where(F.lit(False)), exact_dedup.fresh_index(spark)).count() == 0


def test_index_spans_batches_and_sessions(spark):
    path = scratch_dir(spark, "index-test")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.decide(docs_of(spark, [(1, "a"), (2, "b")]), first).collect()
    spark.sql(f"DROP TABLE {first.table}")  # an external table: the files stay
    second = exact_dedup.DigestIndex(spark, path, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.decide(docs_of(spark, [(3, "A"), (4, "c"), (0, "c")]), second).collect()}
    assert got == {3: (1, False), 4: (4, True), 0: (4, False)}
    assert second.rows().count() == 3
    plan = second.unseen(second.rows())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("Physical Plan")[1]


def test_a_batch_run_again_gets_its_first_verdict(spark):
    index = exact_dedup.DigestIndex(spark, scratch_dir(spark, "index-test"), 4)
    one = docs_of(spark, [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, None)])
    two = docs_of(spark, [(9, "b"), (8, "c")])
    verdict = lambda docs, name: sorted(map(str, exact_dedup.decide(docs, index, name).collect()))
    first = verdict(one, "one")
    assert verdict(one, "one") == first and index.rows().count() == 3
    second = verdict(two, "two")
    assert sum("kept=True" in r for r in second) == 1  # c: batch one had b
    assert verdict(two, "two") == second and verdict(one, "one") == first
    # an append that broke off after some buckets: the rest follows on the rerun, the verdict stands
    broken = exact_dedup.DigestIndex(spark, scratch_dir(spark, "index-test"), 4)
    half = one.where("doc_id = 3").select(exact_dedup.digest(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
    broken.append(half.distinct(), "one")
    assert sorted(map(str, exact_dedup.decide(one, broken, "one").collect())) == first and broken.rows().count() == 3


def test_a_row_repeated_over_many_partitions(spark):
    docs = spark.range(0, 30000, 1, 16).selectExpr("if(id % 3 = 0, id, 5) as doc_id", "if(id % 3 = 0, concat('t', id), 'Same') as text")
    out = exact_dedup.decide(docs, exact_dedup.fresh_index(spark))
    assert out.count() == 30000 and out.where("doc_id = 5 and kept").count() == 1
    assert out.where("doc_id = 5").agg(F.min("group_size"), F.max("group_size")).first() == (20000, 20000)
    assert exact_dedup.survivors(docs, exact_dedup.fresh_index(spark)).count() == 10001
