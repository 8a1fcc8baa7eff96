"""Readers and writers on real files."""

import pytest
from pyspark.sql import functions as F

from shoalcount.operators import audit as au
from shoalcount.operators import intervals as iv
from shoalcount.operators import ordered as od
from shoalcount.session import materialize_counted as keep
from shoalcount.sources import artifacts, files, manifest, metadata, mot, reports


def test_mot_lines_numbers_and_rejects(spark, tmp_path):
    good = "1,7,10.000,20.000,30.000,40.000,1.0,-1,-1,-1"
    lines = [good, "", good.replace("1,7", "2.0,7"), good.replace("1,7", "2.5,7"), good + ",1", good.replace("10.000", "nan"), good.replace("10.000", "x")]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    parsed = mot.parse_lines(mot.read_lines(spark, str(tmp_path)))
    assert [r["line_number"] for r in mot.good_rows(parsed).orderBy("line_number").collect()] == [1, 3]
    bad = {r["line_number"]: r["error"] for r in mot.rejects(parsed).collect()}
    assert bad == {4: "not an integer", 5: "expected 10 columns, got 11", 6: "non-finite box value", 7: "not a number"}


def test_line_numbers_survive_file_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i},1,1,1,1,1,1,-1,-1,-1\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = mot.good_rows(mot.parse_lines(mot.read_lines(spark, str(tmp_path))))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where("line_number <> frame").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mot_write_and_read_back(spark, tmp_path):
    from test_counting import boxes

    b = boxes(spark, {1: [(0, 0.2), (1, 0.25)], 2: [(0, 0.5)]})
    mot.write_mot(b, str(tmp_path / "out"))
    rows = mot.good_rows(mot.parse_lines(mot.read_lines(spark, str(tmp_path / "out" / "clip_id=1"))))
    from shoalcount.operators.boxes import mot_to_internal

    back = mot_to_internal(rows).select("track_id", "frame_index", "x_min", "x_max")
    assert sorted(back.collect()) == sorted(b.select("track_id", "frame_index", "x_min", "x_max").collect())


def test_metadata_strictness(spark, tmp_path):
    base = '"clip_name":"%s","num_frames":10,"framerate":9.5,"width":640,"height":480,"x_meter_start":0,"x_meter_stop":1,"y_meter_start":0,"y_meter_stop":1'
    entries = [base % "a", base % "dup", base % "dup", base % "b" + ',"extra":1', (base % "c").replace('"num_frames":10', '"num_frames":0')]
    (tmp_path / "loc.json").write_text("[" + ",".join("{" + e + "}" for e in entries) + "]")
    rows = metadata.check_entries(metadata.entries(metadata.read_metadata(spark, str(tmp_path))))
    got = {(r["index"], r["error"]) for r in rows.collect()}
    assert got == {(0, None), (1, "duplicate clip_name"), (2, "duplicate clip_name"), (3, "unknown field extra"), (4, "not positive")}


def test_manifest_is_immutable_and_tamper_evident(spark, tmp_path, sf):
    from shoalcount import adapters as ad

    rows = ad.manifest(spark, sf)
    path = manifest.write_manifest(rows, str(tmp_path), "full-v1", {"report": "abc"})
    assert manifest.write_manifest(rows.orderBy(F.rand(1)), str(tmp_path), "full-v1", {"report": "abc"}) == path
    with pytest.raises(manifest.ManifestVersionError):
        manifest.write_manifest(rows.withColumn("boxes", F.col("boxes") + 1), str(tmp_path), "full-v1", {"report": "abc"})
    assert manifest.read_manifest(spark, path).count() == rows.count()
    rows.limit(3).write.mode("append").parquet(path)
    with pytest.raises(manifest.ManifestVersionError):
        manifest.read_manifest(spark, path)
    with pytest.raises(ValueError):
        manifest.write_manifest(rows, str(tmp_path), "bad name", {})


def test_partition_guards(spark, sf):
    from shoalcount import adapters as ad

    m = ad.manifest(spark, sf)
    for bad in (["test"], ["holdout", "train"]):
        with pytest.raises(ValueError):
            manifest.select_rows(m, bad)
    assert manifest.select_rows(m, ["holdout"]).count() > 0
    with pytest.raises(ValueError):
        manifest.release_rows(m, "train", "elwha")


def test_track_artifacts_fill_missing_review_columns(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, 0, 10, 11, "passage", 10.0)], "clip_id long, track_id long, start_frame long, end_frame long, observations long, outcome string, framerate double")
    artifacts.write_tracks(t, str(tmp_path / "tracks"))
    r = artifacts.read_tracks(spark, str(tmp_path / "tracks")).first()
    assert r["end_time_s"] == 1.0 and r["triage"] is None and r["review_reasons"] is None


def test_observation_window_reaches_the_scan(spark, tmp_path, sf):
    from shoalcount import adapters as ad

    b = ad.predicted_boxes(spark, sf)
    artifacts.write_observations(b, str(tmp_path / "obs"))
    window = artifacts.read_observations(spark, str(tmp_path / "obs"), 3, 6)
    assert window.count() == b.where("frame_index >= 3 and frame_index < 6").count()
    plan = window.select("track_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(frame_index,3)" in plan and "LessThan(frame_index,6)" in plan and "x_min" not in plan.split("ReadSchema")[1]


def test_inventory_and_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    inv = files.inventory(files.read_files(spark, str(tmp_path))).first()
    assert inv["size"] == 3 and inv["sha256"].startswith("ba7816bf")


def test_reports_refuse_ambiguity(spark):
    text = '{"results":[{"epoch":1,"threshold":0.2,"clips":[]},{"epoch":1,"threshold":0.2,"clips":[]}]}'
    df = spark.createDataFrame([("r", text)], "report_id string, text string")
    with pytest.raises(Exception, match="no single result"):
        reports.clip_counts(df, 1, 0.2).collect()


def test_plan_variants(spark):
    plan = {"base": {"score_threshold": 0.2}, "variants": {"current": {}, "tight": {"gate_m": 0.3}}}
    rows = reports.plan_variants(spark, plan).orderBy("ordinal").collect()
    assert [(r["variant"], r["score_threshold"], r["gate_m"]) for r in rows] == [("current", 0.2, None), ("tight", 0.2, 0.3)]
    with pytest.raises(ValueError):
        reports.plan_variants(spark, {"base": {}, "variants": {"current": {"oops": 1}}})
    with pytest.raises(ValueError):
        reports.plan_variants(spark, {"base": {}, "variants": {"other": {}}})
    assert len(reports.settings({"vary": {"a": [1, 2], "b": [3, 4, 5]}})) == 6


def test_study_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('participant,condition,sus,tlx,submitted_at\nP1,manual,"[5,1,5,1,5,1,5,1,5,1]","[0,10,20,30,40,50]",t\nP2,manual,"[9]","[0]",t\n')
    rows = {r["participant"]: r for r in reports.read_questionnaires(spark, str(tmp_path / "q.csv")).collect()}
    assert rows["P1"]["valid"] and not rows["P2"]["valid"]


def test_two_level_helpers_match_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(3000).selectExpr("id % 3 as k", "id as o", "(id * 7919) % 101 as v").where("v <> 5")
    w = Window.partitionBy("k").orderBy("o")
    bucket, order = F.floor(F.col("o") / 100), [F.col("o")]
    plain = df.withColumns({"pos": F.row_number().over(w) - 1, "sum": F.sum("v").over(w), "prev_v": F.lag("v").over(w)})
    got = od.position(df, ["k"], bucket, order, "pos")
    got = od.running(got, ["k"], bucket, order, F.col("v"), "sum")
    got = od.previous(got, ["k"], bucket, order, ["v"]).select(*plain.columns)
    assert sorted(map(tuple, got.fillna(-1).collect())) == sorted(map(tuple, plain.fillna(-1).collect()))
    total = od.global_running_sum(df, [F.col("v"), F.col("o")], F.col("v"), "cum").agg(F.max("cum"), F.sum("v")).first()
    assert total[0] == total[1]


def test_audit_windows_avoid_flagged_footage(spark):
    clips = spark.createDataFrame([(1, "a", 1000), (2, "b", 30), (3, "c", 200)], "clip_id long, clip_name string, num_frames long")
    flagged = spark.createDataFrame([(1, 100, 300), (1, 250, 400), (2, 10, 12), (3, 0, 199)], "clip_id long, first long, last long")
    runs = {tuple(r) for r in iv.free_runs(clips, flagged, 10).collect()}
    assert runs == {(1, 0, 90), (1, 411, 1000), (2, 23, 30)}
    w = au.audit_windows(clips, flagged, window=50, fraction=0.1, margin=10).collect()
    again = au.audit_windows(clips, flagged, window=50, fraction=0.1, margin=10).collect()
    assert sorted(w) == sorted(again)
    of = lambda c: sorted((r["start_frame"], r["stop_frame"]) for r in w if r["clip_id"] == c)
    assert of(2) == [(23, 30)] and of(3) == []
    one = of(1)
    assert sum(b - a for a, b in one) >= 0.1 * 679 and all(b - a == 50 for a, b in one)
    assert all(any(lo <= a and b <= hi for lo, hi in ((0, 90), (411, 1000))) for a, b in one)
    assert all(x[1] <= y[0] for x, y in zip(one, one[1:]))


def test_config_is_flattened_by_type_to_any_depth(spark):
    text = '{"a":{"b":{"c":{"d":{"e":{"f":1.5}}}},"s":"{x","n":null,"t":true,"l":[1,{"q":2}],"k":"{\\"z\\":1}"},"x":"7","e":{}}'
    docs = spark.createDataFrame([(1, text), (2, "{}")], "id int, text string")
    got = {(r["id"], r["key"]): r["value"] for r in reports.flatten_config(docs).collect()}
    assert got == {
        (1, "a.b.c.d.e.f"): "1.5", (1, "a.s"): "{x", (1, "a.n"): "None", (1, "a.t"): "True", (1, "a.l"): '[1,{"q":2}]',
        (1, "a.k"): '{"z":1}', (1, "x"): "7",
    }


def test_config_of_many_levels_is_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(reports, "materialize_counted", lambda df, open_: stored.append(1) or keep(df, open_), raising=False)
    monkeypatch.setattr(reports, "materialize", lambda df: stored.append(1) or keep(df, F.lit(False))[0], raising=False)
    nested = lambda n: '{"k":' * n + "1.5" + "}" * n
    got = reports.flatten_config(spark.createDataFrame([(1, nested(8))], "id int, text string")).collect()
    assert [(r["key"], r["value"]) for r in got] == [("k" + ".k" * 7, "1.5")] and len(stored) == 1
    got = reports.flatten_config(spark.createDataFrame([(1, nested(20))], "id int, text string")).collect()
    assert [(r["key"], r["value"]) for r in got] == [("k" + ".k" * 19, "1.5")] and len(stored) <= 4


def test_config_with_a_repeated_name_or_a_long_object(spark):
    long = '{"w":{' + ",".join(f'"k{i}":{{"v":"true","n":{{}},"x":[ {i} ]}}' for i in range(500)) + "}}"
    rows = [(1, '{"a":1,"a":{"b":2}}'), (2, '{"b":{"a":1,"a":2}}'), (3, long), (4, None), (5, '{"a":{"b":1}')]
    got = reports.flatten_config(spark.createDataFrame(rows, "id int, text string")).collect()
    assert {r["id"] for r in got} == {1, 3} and [(r["key"], r["value"]) for r in got if r["id"] == 1] == [("a", "1")]
    want = {(f"w.k{i}.{k}", v) for i in range(500) for k, v in (("v", "true"), ("x", f"[{i}]"))}
    assert {(r["key"], r["value"]) for r in got if r["id"] == 3} == want


def test_metrics_take_numbers_and_booleans_only(spark):
    line = '{"iteration":3,"loss":1.5,"n":2,"b":true,"t":"7","u":"true","z":null,"l":[1]}'
    rows = reports.metric_rows(spark.createDataFrame([(line,)], "line string")).collect()
    assert {(r["key"], r["value"], r["step"]) for r in rows} == {("loss", 1.5, 3), ("n", 2.0, 3), ("b", 1.0, 3)}


def test_evaluation_metrics_and_best(spark):
    text = '{"best":{"epoch":2,"threshold":0.2},"results":[{"epoch":1,"threshold":0.25,"macro_nmae":0.5},{"epoch":2,"threshold":0.2,"macro_nmae":0.25,"missed_passages":3}]}'
    rows = reports.evaluation_metrics(spark.createDataFrame([(1, text)], "report_id int, text string")).collect()
    assert {(r["key"], r["value"], r["epoch"]) for r in rows} == {
        ("nmae/t0.25", 0.5, 1), ("nmae/t0.20", 0.25, 2), ("missed/t0.20", 3.0, 2), ("best/nmae", 0.25, 2), ("best/missed", 3.0, 2),
    }


def test_digests_see_boxes(spark):
    rows = [("c", 0, 1, 0.0, 0.0, 5.0, 5.0, 0.5), ("c", 1, 2, 1.0, 1.0, 6.0, 6.0, 0.5)]
    schema = "clip_id string, frame_index long, det_id long, x_min double, y_min double, x_max double, y_max double, score double"
    one = files.detection_digests(spark.createDataFrame(rows, schema), 2)[1].first()["sha256"]
    renumbered = files.detection_digests(spark.createDataFrame([r[:2] + (9 - r[2],) + r[3:] for r in rows], schema), 2)[1].first()["sha256"]
    moved = files.detection_digests(spark.createDataFrame([rows[0], rows[1][:3] + (2.0,) + rows[1][4:]], schema), 2)[1].first()["sha256"]
    assert one == renumbered and one != moved


def test_a_scan_by_recording_prunes_and_a_hot_recording_is_many_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).cast("long").alias("clip_id"), F.col("id").alias("track_id"),
        F.lit(0).cast("long").alias("start_frame"), F.lit(9).cast("long").alias("end_frame"), F.lit(10.0).alias("framerate"),
    )
    path = str(tmp_path / "tracks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        artifacts.write_tracks(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in (tmp_path / "tracks").iterdir() if f.suffix == ".parquet"]
    ranges = [(s.min, s.max) for f in files for s in [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics]]
    assert sum(a <= 7 <= b for a, b in ranges) > 1 and sum(a <= 30 <= b for a, b in ranges) == 1 < len(files)
    one = artifacts.read_tracks(spark, path).where("clip_id = 30")
    assert one.count() == rows.where("clip_id = 30").count()
    assert "EqualTo(clip_id,30)" in spark.read.parquet(path).where("clip_id = 30")._jdf.queryExecution().executedPlan().toString()


def test_audit_windows_keep_recordings_without_any(spark, tmp_path):
    w = spark.createDataFrame([(1, 0, 5, 9, 0.5, 0.9)], "clip_id long, window_index int, start_frame long, stop_frame long, start_time_s double, stop_time_s double")
    artifacts.write_audit_windows(w, spark.createDataFrame([(1, 90), (2, 0)], "clip_id long, unflagged_frames long"), "v1", str(tmp_path / "a"))
    windows, of = artifacts.read_audit_windows(spark, str(tmp_path / "a"))
    assert [tuple(r) for r in windows.collect()] == [(1, 0, 5, 9, 0.5, 0.9)] and sorted(map(tuple, of.collect())) == [(1, "v1", 90), (2, "v1", 0)]


def test_guards_refuse(spark, tmp_path):
    from shoalcount.operators import counting, ops, usability

    with pytest.raises(ValueError, match="1 to 500"):
        artifacts.observation_window(spark, str(tmp_path), 10, 511)
    with pytest.raises(ValueError, match="workers.worker_id"):
        ops.table_violations(spark.range(1), "workers")
    box = spark.createDataFrame([(9, 1, 0, 0.0, 0.0, 1.0, 1.0)], "clip_id long, track_id long, frame_index long, x_min double, y_min double, x_max double, y_max double")
    clips = spark.createDataFrame([(1, 5, 10, 10)], "clip_id long, num_frames long, width int, height int")
    with pytest.raises(Exception, match="clip 9"):
        counting.count_clips(box, clips).collect()
    trials = spark.createDataFrame([("P1", "x", False, "manual", 5, 1, 1)], "participant string, clip string, practice boolean, condition string, active_ms long, final_right long, final_left long")
    plan = spark.createDataFrame([("y", 1, 1, 1, 1)], "clip string, ref_right long, ref_left long, auto_right long, auto_left long")
    with pytest.raises(Exception, match="no clip x"):
        usability.scored_trials(trials, plan, trials.select("participant", "clip").where("false")).collect()
