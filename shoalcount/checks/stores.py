"""Tables written and read back, service tables, and what reports say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.checks import counting as cc
from shoalcount.checks import review as rc
from shoalcount.checks import reviewlog as rl
from shoalcount.functions import labels as fl
from shoalcount.operators import boxes as bx
from shoalcount.operators import ops
from shoalcount.operators import quality as ql
from shoalcount.operators import reviews as rv
from shoalcount.operators import scoring as sc
from shoalcount.operators import usability as us
from shoalcount.session import materialize, scratch_dir
from shoalcount.sources import artifacts as af
from shoalcount.sources import manifest as mf
from shoalcount.sources import mot, reports

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query("WITH " + q.PRED + q.track_counts("pred", "pt") + """ SELECT clip_id, track_id, start_frame, end_frame, round(start_frame/10.0::DOUBLE,6) AS start_time_s,
  round(end_frame/10.0::DOUBLE,6) AS end_time_s, outcome, direction, NULL::VARCHAR AS triage FROM pt""")
def stored_tracks(s, d):
    path = scratch_dir(s, "tracks")
    af.write_tracks(cc.pred_tracks(s, d).withColumn("framerate", F.lit(10.0)), path)
    cols = ("clip_id", "track_id", "start_frame", "end_frame", "outcome", "direction", "triage")
    return af.read_tracks(s, path).select(*cols, *[F.round(c, 6).alias(c) for c in ("start_time_s", "end_time_s")])


@query("WITH " + q.REF + " SELECT clip_id, track_id, frame_index, x_min, y_max FROM ref")
def stored_mot_lines(s, d):
    path = scratch_dir(s, "lines")
    mot.write_mot_lines(ad.reference_boxes(s, d), path)
    back = bx.mot_to_internal(mot.read_mot_lines(s, path))
    return back.select("clip_id", "track_id", "frame_index", F.round("x_min", 3).alias("x_min"), F.round("y_max", 3).alias("y_max"))


@query("WITH " + q.DET + " SELECT clip_id, frame_index, det_id, score FROM det WHERE score>=0.5")
def cached_detections(s, d):
    path = scratch_dir(s, "detections")
    af.write_detections(ad.detections(s, d), path, 0.3)
    return af.read_detections(s, path, 0.5).select("clip_id", "frame_index", "det_id", "score")


@query("WITH " + q.REF + q.CLIPS + """, w AS (SELECT clip_id, i AS window_index, i*4 AS start_frame, i*4+2 AS stop_frame FROM clips, range(3) r(i) WHERE i*4+2<=num_frames)
  SELECT c.clip_id, window_index, start_frame, stop_frame, round(start_frame/10.0::DOUBLE,6) AS start_time_s, round(stop_frame/10.0::DOUBLE,6) AS stop_time_s, c.num_frames*2 AS unflagged_frames, 'v2' AS calibration_version
  FROM clips c JOIN w USING (clip_id)""")
def stored_audit_windows(s, d):
    clips, path = ad.clips(s, d), scratch_dir(s, "audit")
    w = clips.select("clip_id", "num_frames", "framerate", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window_index"))
    w = w.select("clip_id", "framerate", "window_index", (F.col("window_index") * 4).alias("start_frame"), (F.col("window_index") * 4 + 2).alias("stop_frame"), "num_frames")
    w = w.where("stop_frame <= num_frames").withColumns({f"{e}_time_s": F.col(f"{e}_frame") / F.col("framerate") for e in ("start", "stop")})
    af.write_audit_windows(w, clips.select("clip_id", (F.col("num_frames") * 2).alias("unflagged_frames")), "v2", path)
    windows, of = af.read_audit_windows(s, path)
    return windows.join(of, "clip_id").withColumns({c: F.round(c, 6) for c in ("start_time_s", "stop_time_s")})


@query("WITH " + q.REF + q.CLIPS + """, w AS (SELECT clip_id, i AS window_index, i*4 AS start_frame, i*4+2 AS stop_frame FROM clips, range(3) r(i)) SELECT clip_id, window_index FROM w WHERE start_frame<=5 AND 5<stop_frame""")
def windows_at_frame(s, d):
    w = ad.clips(s, d).select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window_index"))
    w = w.withColumns({"start_frame": F.col("window_index") * 4, "stop_frame": F.col("window_index") * 4 + 2})
    return bx.windows_at(w, F.lit(5)).select("clip_id", "window_index")


@query("WITH " + q.DATASET + """, i AS (SELECT b.clip_id, CASE WHEN frame_index<0 OR frame_index>=100 THEN 'frame_out_of_range' WHEN x_max<=x_min OR y_max<=y_min THEN 'non_positive_box_size'
    WHEN x_max<=0 OR y_max<=0 OR x_min>=640 OR y_min>=480 THEN 'box_outside_image' WHEN x_min<0 OR y_min<0 OR x_max>640 OR y_max>480 THEN 'box_partially_outside_image' END AS code FROM db b JOIN dc c USING (clip_id)),
  n AS (SELECT clip_id, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1,2), p AS (SELECT clip_id, string_agg(code||':'||n, ',' ORDER BY code) AS issues FROM n GROUP BY 1),
  t AS (SELECT clip_id, count(DISTINCT track_id) AS tracks, count(*) AS boxes FROM db GROUP BY 1)
  SELECT location, clip_name, coalesce(issues, '') AS issues, coalesce(tracks, 0) AS tracks FROM dc LEFT JOIN p USING (clip_id) LEFT JOIN t USING (clip_id)""")
def validation_report(s, d):
    """One JSON line a clip, written and read back."""
    boxes, clips = ad.dataset_boxes(s, d), ad.dataset_clips(s, d)
    issues = materialize(ql.box_issues(boxes, clips))
    stats = boxes.groupBy("clip_id").agg(F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("boxes"))
    path = scratch_dir(s, "report")
    ql.write_validation_report(ql.validation_lines(ql.clip_status(clips, issues), issues, stats), path)
    kind = "location string, clip_name string, status string, issues array<struct<code:string,severity:string,count:bigint>>, stats struct<tracks:bigint>"
    line = s.read.text(path).select(F.from_json("value", kind).alias("r")).select("r.*")
    listed = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["count"].cast("string"))), ",")
    return line.select("location", "clip_name", listed.alias("issues"), F.coalesce("stats.tracks", F.lit(0)).alias("tracks"))


AT = "(9+2*(job_id%5))"


@query(rl.FOLD + f""", tq AS (SELECT job_id, 'P'||(job_id%6) AS participant, 'c'||job_id AS clip, job_id%10=9 AS practice FROM rjobs WHERE job_id%2=1)
  SELECT participant, clip, practice, job_id::VARCHAR AS job_id, event_id, action, a.track_id, a.direction, frame_index, 'passage' AS automatic_outcome, jt.direction AS automatic_direction, NULL::VARCHAR AS automatic_triage
  FROM tq JOIN acc a USING (job_id) LEFT JOIN jt USING (job_id, track_id) WHERE resulting_revision<={AT}""".replace("'passage' AS automatic_outcome", "CASE WHEN jt.track_id IS NOT NULL THEN 'passage' END AS automatic_outcome"))
def stored_review_actions(s, d):
    """The events behind assisted trials, written as CSV and read back."""
    j = ad.review_jobs(s, d)
    trials = j.select(
        "job_id", F.format_string("P%d", F.col("job_id") % 6).alias("participant"), F.format_string("c%d", "job_id").alias("clip"), (F.col("job_id") % 10 == 9).alias("practice"),
        F.when(F.col("job_id") % 2 == 1, "assisted").otherwise("manual").alias("condition"), F.expr("9 + 2 * (job_id % 5)").alias("revision"),
    )
    tracks = ad.job_tracks(s, d).withColumns({"outcome": F.lit("passage"), "triage": F.lit(None).cast("string")})
    path = scratch_dir(s, "actions")
    reports.write_csv(us.review_action_rows(trials, rl.accepted(s, d), tracks), path)
    return reports.read_review_actions(s, path)


def service(s, d, table):
    j = ad.service_jobs(s, d)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    if table == "jobs":
        return j.select(
            F.col("job_id").cast("string").alias("job_id"), F.col("clip_id").cast("string").alias("clip_id"), "pipeline_version", F.lit("{}").alias("counting_json"), "cache_key",
            F.when(F.col("job_id") % 3 == 0, F.col("idempotency_key")).alias("idempotency_key"), F.sha2(F.col("job_id").cast("string"), 256).alias("request_sha256"),
            F.when(F.col("job_id") % 50 == 0, "lost").otherwise(F.col("status")).alias("status"), F.col("attempts").cast("bigint").alias("attempts"),
            (F.col("max_attempts") - F.when(F.col("job_id") % 70 == 0, 3).otherwise(0)).cast("bigint").alias("max_attempts"), F.col("deadline_seconds").cast("bigint").alias("deadline_seconds"),
            F.lit(None).cast("string").alias("lease_owner"), text("lease_expires_at"), F.lit(None).cast("string").alias("heartbeat_at"), F.lit(0.5).alias("progress"), F.lit(None).cast("string").alias("error"),
            F.col("cached_from").cast("string").alias("cached_from"), F.when(F.col("job_id") % 40 != 0, text("created_at")).alias("created_at"), text("started_at"), text("finished_at"),
        )
    return j.select(F.col("clip_id").cast("string").alias("worker_id"), "pipeline_version", text("created_at").alias("ready_at"), text("started_at").alias("heartbeat_at"), F.lit(None).cast("string").alias("current_job"))


@query("WITH " + q.JOBS + """, ik AS (SELECT idempotency_key, count(*) AS n FROM jb WHERE job_id%3=0 GROUP BY 1), wk AS (SELECT clip_id, count(*) AS n FROM jb GROUP BY 1),
  v AS (SELECT 'jobs' AS "table", 'status' AS "column", 'value' AS rule, count(*) AS rows FROM jb WHERE job_id%50=0 UNION ALL SELECT 'jobs', 'max_attempts', 'positive', count(*) FROM jb WHERE job_id%70=0
   UNION ALL SELECT 'jobs', 'created_at', 'null', count(*) FROM jb WHERE job_id%40=0 UNION ALL SELECT 'jobs', 'idempotency_key', 'repeated', coalesce(sum(n-1),0) FROM ik
   UNION ALL SELECT 'workers', 'worker_id', 'repeated', coalesce(sum(n-1),0) FROM wk) SELECT * FROM v WHERE rows>0""")
def service_violations(s, d):
    found = [ops.table_violations(service(s, d, t), t).withColumn("table", F.lit(t)) for t in ("jobs", "workers")]
    return found[0].unionByName(found[1])


@query("WITH " + q.REF + q.CLIPS + " SELECT clip_id, unnest(range(clip_id%3+1, num_frames-1, 3)) AS frame_index FROM clips")
def sampled_window_frames(s, d):
    c = ad.clips(s, d).withColumns({"frame_start": F.col("clip_id") % 3 + 1, "frame_stop": F.col("num_frames") - 1})
    return bx.sample_frames(c, 3)


@query(rc.RVW + f" SELECT clip_id, track_id, triage, (SELECT count(*) FROM rvw) AS total FROM rvw ORDER BY {rc.TRI}, clip_id, track_id LIMIT 50 OFFSET 100")
def queue_page_with_total(s, d):
    out = sc.page_with_total(rc.reviewed_tracks(s, d), sc.queue_order(("clip_id", "track_id")), 100, 50)
    return out.select("clip_id", "track_id", "triage", "total")


@query("WITH " + q.MANIFEST + " SELECT location, clip_name, row_number() OVER (ORDER BY list_position(['nushagak','elwha','kenai-val'], location), clip_name)-1 AS place FROM mf WHERE location IN ('nushagak','elwha','kenai-val')")
def clips_in_location_order(s, d):
    locations = ["nushagak", "elwha", "kenai-val"]
    rows = mf.in_location_order(ad.manifest(s, d).where(F.col("location").isin(*locations)), locations)
    path = scratch_dir(s, "order")
    # the order is the feature: it is written, and each row's place follows from its file and its row in it
    rows.select("location", "clip_name").write.parquet(path)
    back = s.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    sizes = back.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.alias("a"), sizes.alias("b")
    before = a.join(b, F.col("b.f") < F.col("a.f"), "left").groupBy(F.col("a.f").alias("f")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # files
    return back.join(before, "f").select("location", "clip_name", (F.col("before") + F.col("r")).alias("place"))


@query("WITH " + q.MANIFEST + " SELECT location, clip_name FROM mf WHERE partition IN ('train','val') AND usable AND frames_validated ORDER BY location, clip_name LIMIT 7")
def first_tuning_rows(s, d):
    return mf.select_rows(ad.manifest(s, d), ["train", "val"], limit=7).select("location", "clip_name")


@query(rl.FOLD + " SELECT job_id, track_id FROM oc WHERE review_state<>'unresolved' AND final_direction IS NOT NULL")
def tracks_that_count_now(s, d):
    return rl.state(s, d)[1].where(rv.counts_now()).select("job_id", "track_id")


_WHY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fl.UNCOUNTED_REASONS.items())
_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fl.REASON_LABELS.items())


@query("WITH " + q.PRED + q.track_counts("pred", "pt") + f""" SELECT clip_id, track_id, CASE outcome {_WHY} END AS why,
  CASE track_id%3 WHEN 0 THEN '' WHEN 1 THEN (CASE 'duration' {_LABEL} END) ELSE (CASE 'motion' {_LABEL} END)||', unheard' END AS reasons FROM pt""")
def track_reasons(s, d):
    given = F.when(F.col("track_id") % 3 == 1, F.array(F.lit("duration"))).when(F.col("track_id") % 3 == 2, F.array(F.lit("motion"), F.lit("unheard")))
    return cc.pred_tracks(s, d).select("clip_id", "track_id", fl.uncounted_reason(F.col("outcome")).alias("why"), fl.reason_text(given).alias("reasons"))


@query("WITH " + q.REF + " SELECT clip_id, track_id, frame_index, x_min, y_max FROM ref")
def unscaled_boxes(s, d):
    there = bx.scale_boxes(ad.reference_boxes(s, d), F.lit(0.5))
    return bx.unscale_boxes(there, F.lit(0.5)).select("clip_id", "track_id", "frame_index", "x_min", "y_max")


@query("WITH " + q.REF + " SELECT clip_id, count(*) AS boxes FROM ref WHERE clip_id%4=0 OR frame_index>=9 GROUP BY 1")
def boxes_without_a_frame(s, d):
    """Boxes of unknown recordings and beyond the end; here every fourth recording is unknown and the others have nine frames."""
    from shoalcount.operators import counting as ct

    known = ad.clips(s, d).where("clip_id % 4 <> 0").withColumn("num_frames", F.lit(9))
    return ct.boxes_outside_clip(ad.reference_boxes(s, d), known).groupBy("clip_id").agg(F.count(F.lit(1)).alias("boxes"))
