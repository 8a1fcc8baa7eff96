"""Text of recordings is parsed once, however many checks read its rows."""

from pyspark.sql import functions as F

from shoalcount.operators import validation as vl


def test_checks_read_stored_numbers(spark):
    text = F.format_string("%d,%d,1,2,10.5,10,1.0,-1,-1,-1%s", F.col("id") + 1, F.col("id") % 3, F.when(F.col("id") == 7, ",9").otherwise(""))
    lines = spark.range(40).select((F.col("id") % 2).alias("clip_id"), F.col("id").alias("line_number"), text.alias("line"))
    clips = spark.range(2).selectExpr("id as clip_id", "'elwha' as location", "concat('c', id) as clip_name", "50L as num_frames", "100 as width", "100 as height", "10D as framerate")
    files = clips.selectExpr("clip_id", "location", "clip_name", "'h' as gt_sha256")
    frames = clips.selectExpr("clip_id", "explode(sequence(0L, 49L)) as frame_index", "100 as image_width", "100 as image_height")
    for subset in ((), (files, lines)):
        checks = vl.check_clips(files, lines, clips, clips, frames, *subset)
        plan = checks._jdf.queryExecution().optimizedPlan().toString()
        assert " AS line#" not in plan and "trim(line" not in plan and "%d,%d,1,2" not in plan
        found = {r["clip_id"]: r for r in checks.collect()}
        assert (found[0]["mot_format"], found[0]["boxes"], found[0]["tracks"]) == (0, 20, 3)
        assert (found[1]["mot_format"], found[1]["boxes"]) == (1, None)
