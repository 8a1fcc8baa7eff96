"""Tables that are small as files but not in memory are joined by sorting, not broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks.validation import QUERIES
from shoalcount.llm import simhash
from shoalcount.operators import grid as gr
from shoalcount.operators import validation as vl
from shoalcount.session import materialize


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_stored_rows_of_small_integers(spark):
    rows = spark.range(300_000).selectExpr("id div 3000 as clip_id", "int(id % 3) as label")
    other = materialize(rows.selectExpr("clip_id", "label as near").where("clip_id = 5 and near = 1"))
    assert joins(materialize(rows).join(materialize(rows.withColumnRenamed("label", "old")).distinct(), "clip_id").groupBy().count()) == (1, 0)
    assert joins(other.join(other.withColumnRenamed("near", "far"), "clip_id").groupBy().count()) == (0, 1)


def test_pixels_opened_from_arrays(spark, sf):
    conf = gr.DetectorConfig(background_window=21, background_stride=2, background_update_every=8)
    plan = gr.differences(ad.cells(spark, sf), conf)
    plan.collect()
    assert "posexplode" in str(plan._jdf.queryExecution().executedPlan())
    text = str(plan._jdf.queryExecution().optimizedPlan())
    assert text.count("strategy=merge") >= 2


def test_variants_of_fingerprints(spark):
    prints = materialize(spark.range(1000).selectExpr("xxhash64(id) as fp"))
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    for opened in (r"\[k0#\d+L\], \[k1#\d+L\]", r"\[seg#\d+, val#\d+L\], \[s2#\d+, v2#\d+L\]"):
        assert re.findall(rf"(\w+) {opened}", plan) == ["SortMergeJoin"]


@pytest.mark.parametrize("windowed", [False, True])
def test_frames_opened_from_recordings(spark, windowed):
    clips = materialize(spark.range(50).selectExpr("id as clip_id", "100L as num_frames", "640 as width", "480 as height"))
    opened = clips.where("clip_id <> 3").select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(104))).alias("frame_index"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))
    empty = clips.where("clip_id = 3").selectExpr("clip_id", "null as frame_index", "null as image_width", "null as image_height")
    frames = opened.unionByName(empty).withColumn("empty_folder", F.col("frame_index").isNull())
    checks = vl.frame_checks(frames, clips, clips, windowed)
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+) \[clip_id#\d+L\], \[clip_id#\d+L\], LeftOuter", plan) == ["SortMergeJoin"]
    found = {r["clip_id"]: (r["folder"], r["files"], r["frame_window_out_of_range"]) for r in checks.collect()}
    assert found == {k: (True, 0, 0) if k == 3 else (True, 105, 5) for k in range(50)}


def test_frames_of_the_manifest(spark, sf, monkeypatch):
    plans, frame_checks = [], vl.frame_checks

    def seen(*args):
        plans.append(frame_checks(*args))
        return plans[-1]

    monkeypatch.setattr(vl, "frame_checks", seen)
    assert QUERIES["recording_manifest"](spark, sf).count() > 0
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+) \[clip_id#\d+L\], \[clip_id#\d+L\], LeftOuter", plan) == ["SortMergeJoin"]
