"""End-to-end analyses as queries: the main table of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.checks import counting as cc
from shoalcount.checks import evaluation as ev
from shoalcount.checks import quality as qc
from shoalcount.checks import review as rc
from shoalcount.checks import reviewlog as rl
from shoalcount.operators import tracking as tk
from shoalcount.plans import analyses as an
from shoalcount.plans import experiments as ex

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SIZE = (ad.WIDTH, ad.HEIGHT)
METRES = (12.0 / ad.WIDTH, 9.0 / ad.HEIGHT)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def recording_counts_report(s, d):
    t = an.passage_counts(ad.detections(s, d), ad.clips(s, d), tk.KalmanConfig(gate_m=0.6), *SIZE, *METRES, ad.FRAMERATE, F.lit("right"))
    return t["counts"]


@query(cc.PAIRS + f" SELECT location, {cc.SUMMARY} FROM pairs GROUP BY ROLLUP(location)")
def location_report(s, d):
    pred = ad.predicted_boxes(s, d)
    return an.location_report(ad.clips(s, d), ad.reference_boxes(s, d), pred, pred.select("clip_id"))["locations"]


@query(ev.LOC + f""", pt AS (SELECT location, count(*) AS clips, sum(passages) AS passages, round(sum(err_a)::DOUBLE/sum(passages),4) AS nmae_a, round(sum(err_b)::DOUBLE/sum(passages),4) AS nmae_b,
   sum(greatest(ref_right-a_right,0)+greatest(ref_left-a_left,0)) AS missed_a, sum(greatest(ref_right-b_right,0)+greatest(ref_left-b_left,0)) AS missed_b,
   sum(err_a)-sum(greatest(ref_right-a_right,0)+greatest(ref_left-a_left,0)) AS false_a, sum(err_b)-sum(greatest(ref_right-b_right,0)+greatest(ref_left-b_left,0)) AS false_b FROM ce GROUP BY 1),
  iv AS (SELECT location, {ev.IV('a', 'a')}, {ev.IV('bb', 'b')} FROM n GROUP BY 1) SELECT * FROM pt JOIN iv USING (location)""")
def release_summary(s, d):
    return an.release_summary(ad.clip_counts(s, d), ["a", "b"], "a", resamples=ev.B)["locations"]


@query(cc.FEATURES + """ SELECT clip_id, track_id, direction, start_frame, end_frame, outcome, 'reference' AS kind FROM ro WHERE outcome<>'counted'
  UNION ALL SELECT clip_id, track_id, direction, start_frame, end_frame, outcome, 'predicted' FROM po WHERE outcome IN ('duplicate','background','non_passing_fish')""")
def error_examples(s, d):
    return an.error_analysis(ad.clips(s, d), ad.reference_boxes(s, d), ad.predicted_boxes(s, d), *SIZE)["examples"]


@query(cc.FEATURES + rc.FEAT_BODY + rc.REV + f""", od AS (SELECT i.clip_id, i.track_id, sum(cost_s) OVER (ORDER BY
    round(r.review_score, 9) NULLS LAST, i.clip_id, i.track_id ROWS UNBOUNDED PRECEDING) AS cum FROM itm i JOIN rvw r USING (clip_id, track_id)),
  fst AS (SELECT error_id, min(cum) AS c FROM od JOIN rev USING (clip_id, track_id) GROUP BY 1)""" + rc.CURVE)
def score_only_curve(s, d):
    t = an.review_prioritisation(
        ad.clips(s, d), ad.reference_boxes(s, d), ad.predicted_boxes(s, d), *SIZE, *METRES, ad.FRAMERATE, rc.BUDGETS, repeats=200
    )
    r = lambda c: F.round(c, 9).alias(c)
    return t["score_only"].select(F.col("budget").cast("double").alias("budget"), r("all_errors"), r("reachable_errors"))


@query()
def pipeline_ablation(s, d):
    base = tk.KalmanConfig("current", gate_m=0.6)
    variants = [(base, None, None), (tk.KalmanConfig("suppressed", gate_m=0.6), 0.4, 0.7)]
    return an.ablation(ad.detections(s, d), ad.reference_boxes(s, d), ad.clips(s, d), variants, *SIZE, *METRES)


VARIANTS = {
    "base": {"score_threshold": 0.3, "tracker": {"gate_m": 0.6}},
    "variants": {"current": {}, "strict": {"score_threshold": 0.6, "tracker": {"min_hits": 5}}, "nested": {"suppression": {"iou": 0.65, "containment": 0.5}}},
}
SEEN = cc.SUPPRESS.format(test=f"(({cc.IOU}) > 0.65 OR {cc.CONTAIN} > 0.5)").replace("det a JOIN det b", "dt a JOIN dt b").replace("FROM det GROUP", "FROM dt GROUP")
SEEN = SEEN.replace("e AS (SELECT a.clip_id", "dt AS (SELECT * FROM det WHERE score>=0.3), e AS (SELECT a.clip_id").replace("SELECT clip_id, frame_index, unnest(kept) AS det_id FROM w WHERE i=len(l)+1", "")


@query(SEEN + """SELECT 'current' AS variant, clip_id, count(*) AS detections FROM dt GROUP BY 2 UNION ALL SELECT 'strict', clip_id, count(*) FROM det WHERE score>=0.6 GROUP BY 2
  UNION ALL SELECT 'nested', clip_id, sum(len(kept)) FROM w WHERE i=len(l)+1 GROUP BY 2""")
def plan_variant_detections(s, d):
    out = None
    for variant in ex.pipeline_variants(VARIANTS):
        seen = ex.apply_variant(ad.detections(s, d), variant).groupBy("clip_id").agg(F.count(F.lit(1)).alias("detections"))
        seen = seen.select(F.lit(variant[0].name).alias("variant"), "*")
        out = seen if out is None else out.unionByName(seen)
    return out


@query(ev.ORACLE["paired_bootstrap"])
def compared_systems(s, d):
    return an.compare_systems(ev.system(s, d, "a"), ev.system(s, d, "b"), resamples=ev.B)["comparison"]


@query(rl.REPLAY + " SELECT job_id, event_id, counted_nearby FROM rpl")
def same_fish_decisions(s, d):
    groups = ad.review_jobs(s, d).select("job_id", F.lit("g").alias("group"))
    t = an.same_fish_coverage(ad.review_events(s, d), ad.job_tracks(s, d), ad.review_jobs(s, d), groups)
    return t["decisions"].select("job_id", "event_id", "counted_nearby")


@query(qc.MISS + f""", i AS (SELECT clip_id, code, count(*) AS n FROM (SELECT clip_id, {qc.CODE} AS code FROM db) WHERE code IS NOT NULL GROUP BY 1,2
   UNION ALL SELECT clip_id, 'duplicate_track_frame', sum(k-1) FROM (SELECT clip_id, track_id, frame_index, count(*) AS k FROM db GROUP BY 1,2,3) WHERE k>1 GROUP BY 1
   UNION ALL SELECT clip_id, 'missing_frames', count(*) FROM m GROUP BY 1 UNION ALL SELECT clip_id, 'frame_window_out_of_range', count(*) FROM p WHERE frame_index>=100 GROUP BY 1)
  SELECT code, sum(n) AS count, count(*) AS clips FROM i GROUP BY 1""")
def dataset_validation(s, d):
    boxes = ad.dataset_boxes(s, d)
    t = an.validate_dataset(boxes, ad.dataset_clips(s, d), boxes.select("clip_id"), qc.present_frames(s, d))
    return t["totals"]


@query("WITH " + q.DET + """, two AS (SELECT 'a' AS host, clip_id, frame_index, x_min, y_min, x_max, y_max, score FROM det
    UNION ALL SELECT 'b', clip_id, frame_index, x_min+CASE WHEN clip_id%7=0 AND frame_index%16=0 THEN 500 ELSE 0 END, y_min, x_max, y_max, score+CASE WHEN clip_id%5=0 THEN 0.02::DOUBLE ELSE 0 END FROM det WHERE NOT (clip_id%11=0 AND det_id%19=0)),
  r AS (SELECT host, clip_id, frame_index, round(x_min,2) AS a, round(y_min,2) AS b, round(x_max,2) AS c, round(y_max,2) AS e, round(score,2) AS f FROM two),
  fr AS (SELECT host, clip_id, frame_index, sha256(string_agg(concat_ws(':', a, b, c, e, f), ',' ORDER BY a, b, c, e, f)) AS h FROM r GROUP BY 1,2,3),
  lv AS (SELECT host, clip_id, frame_index AS pos, h AS digest FROM fr), """ + q.tree("lv", "host, clip_id", "cl") + """
  SELECT clip_id, count(DISTINCT digest)=1 AND count(*)=2 AS identical FROM cl GROUP BY 1""")
def host_parity(s, d):
    a = ad.detections(s, d)
    moved, lost = "if(clip_id % 7 = 0 and frame_index % 16 = 0, 500, 0)", "clip_id % 11 = 0 and det_id % 19 = 0"
    b = a.where(f"not ({lost})").withColumns({"x_min": F.expr(f"x_min + {moved}"), "score": F.expr("score + if(clip_id % 5 = 0, 0.02D, 0D)")})
    return an.host_parity(a, b)["fingerprints"]


# --- the remaining analyses, each by the twin of the operator that makes the table ----------


def _reviewed(s, d):
    lab = ev.labels(s, d)
    counts = ev.reviewed_clip_counts(s, d, lab).join(ad.table(s, d, "nation").select(F.lit(1).alias("ref_right"), F.lit(1).alias("ref_left")).distinct())
    tracks = cc.pred_tracks(s, d).select("clip_id", "track_id", "direction", "start_frame", "end_frame", "start_u", "end_u")
    events = ad.table(s, d, "events").selectExpr("user_id % 20 as clip", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as created_at", "event_type as reason")
    return an.reviewed_sample(lab.drop("start_frame", "end_frame", "start_u", "end_u"), counts, tracks, events)


@query(ev.ORACLE["triage_table"])
def reviewed_sample_triage(s, d):
    return _reviewed(s, d)["triage"]


@query(ev.ORACLE["reviewer_kappa"])
def reviewed_sample_agreement(s, d):
    return _reviewed(s, d)["agreement"]


@query(ev.CHG + " SELECT rv, count(*) AS changes, sum(counted_tracks_nearby) AS nearby, count(*) FILTER (crosses_line_alone) AS alone FROM ch GROUP BY 1")
def reviewed_sample_changes(s, d):
    return _reviewed(s, d)["changes"].groupBy("rv").agg(
        F.count(F.lit(1)).alias("changes"), F.sum("counted_tracks_nearby").alias("nearby"), F.count(F.when(F.col("crosses_line_alone"), 1)).alias("alone")
    )


@query(ev.CHG + """ SELECT rv, count(*) FILTER (verdict='counted' AND NOT crosses_line_alone AND counted_tracks_nearby>0) AS fragment_counts FROM ch GROUP BY 1""")
def retest_fragments(s, d):
    t = _reviewed(s, d)
    events = ad.table(s, d, "events").selectExpr("user_id % 20 as clip", "event_type as reason")
    return an.retest(t["clips"].withColumn("complete", F.lit(True)), t["changes"], events)["reviewers"].select("rv", "fragment_counts")


@query(ev.ORACLE["group_results"])
def usability_group(s, d):
    t = ad.trials(s, d)
    forms = t.select("participant", "condition", F.sequence(F.lit(1), F.lit(10)).alias("sus"), F.sequence(F.lit(1), F.lit(6)).alias("tlx"))
    actions = t.select("participant", F.lit(False).alias("practice"), F.lit("accept").alias("action"), F.lit("right").alias("automatic_direction"))
    out = an.usability(t, ad.study_plan(s, d), t.where("k % 23 = 0"), forms, actions, strict=False)["group"]
    nine = [F.round(c, 9).alias(c) for c in ("time_ratio_geometric_mean", "nmae_manual", "nmae_assisted", "nmae_difference")]
    return out.select("participants", *nine, "target_met")


@query(ev.ORACLE["study_eligible"])
def study_design_pool(s, d):
    people = ad.trials(s, d).select("participant").distinct()
    t = an.study_design(ad.clip_counts(s, d), ev.citing_documents(s, d), ev.DOC, people, 20)
    return t["eligible"].select("clip_name", "num_frames", "ref_right", "ref_left")


def _operations(s, d):
    e = ad.table(s, d, "events").select((F.col("user_id") % 7).alias("pipeline"), F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    beats = e.select("worker_id", F.col("ts").alias("heartbeat_at"))
    return an.operations(ad.service_jobs(s, d), beats, e.select(F.col("event_type").alias("series"), "ts", "value"), qc.now())


@query(qc.ORACLE["backlog"])
def operations_backlog(s, d):
    return _operations(s, d)["backlog"].select("pipeline_version", "job_id", "age_seconds", "rank")


@query(qc.ORACLE["job_gauges"])
def operations_gauges(s, d):
    return _operations(s, d)["gauges"]


@query(qc.ORACLE["duration_histogram"])
def operations_durations(s, d):
    return _operations(s, d)["durations"]
