"""Sharding: weights, growth, gapless slots and odd rows."""

from pyspark.sql import functions as F

from shoalcount.llm import sharding

DOCS = "doc_id bigint, text string, shard string, slot string"


def test_shares_follow_weights_and_growth_moves_only_into_the_new_shard(spark):
    tree = [sharding.Leaf("a", "a0", 0, 1.0), sharding.Leaf("a", "a1", 1, 3.0), sharding.Leaf("b", "b0", 2, 4.0), sharding.Leaf("b", "b0", 3, 0.0)]
    ids = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    both = ids.select(sharding.place(F.col("k"), tree).alias("now"), sharding.place(F.col("k"), sharding.grown(tree, 2.0)).alias("later"))
    share = {r["now"]: r["count"] / 20000 for r in both.groupBy("now").count().collect()}
    assert abs(share[0] - 1 / 8) < 0.02 and abs(share[1] - 3 / 8) < 0.02 and abs(share[2] - 0.5) < 0.02 and 3 not in share
    assert both.where("now <> later and later <> 4").count() == 0
    assert abs(both.where("later = 4").count() / 20000 - 0.2) < 0.02


def test_raising_a_rack_leaves_other_subtrees_alone(spark):
    tree = sharding.uniform_tree()
    more = [leaf._replace(weight=2.0) if leaf.rack == "r0k1" else leaf for leaf in tree]
    ids = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    both = ids.select(sharding.place(F.col("k"), tree).alias("now"), sharding.place(F.col("k"), more).alias("later")).where("now <> later")
    # whoever moves enters region 0; inside it, only the raised rack takes documents
    assert both.where("now < 12 and not later between 4 and 7").count() == 0
    assert both.where("later >= 12").count() == 0 and both.count() > 0


def test_slots_and_odd_rows(spark):
    rows = [(i, "t" * (i % 5)) for i in range(300)] + [(None, None), (1, None), (1, None), (400, "é" * 50000)]
    docs = spark.createDataFrame([(*r, "s", "t") for r in rows], DOCS)
    out = sharding.assign(docs, sharding.uniform_tree()).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert next(r for r in out if r["doc_id"] is None)["size"] == 8
    assert next(r for r in out if r["doc_id"] == 400)["size"] == 100008
    assert sharding.assign(docs.where(F.lit(False)), sharding.uniform_tree()).count() == 0
