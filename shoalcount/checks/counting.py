"""Queries over boxes, counting, matching and error attribution, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.functions import geometry as g
from shoalcount.operators import boxes as bx
from shoalcount.operators import counting as ct
from shoalcount.operators import matching as mt
from shoalcount.session import materialize

W, H = ad.WIDTH, ad.HEIGHT
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def ref_tracks(s, d):
    return ct.count_trajectories(ad.reference_boxes(s, d), W, H)


def pred_tracks(s, d):
    return ct.count_trajectories(ad.predicted_boxes(s, d), W, H)


REF_T = "WITH " + q.REF + q.track_counts("ref", "rt")
BOTH_T = "WITH " + q.PRED + q.CLIPS + q.track_counts("ref", "rt") + q.track_counts("pred", "pt")

# --- counting ------------------------------------------------------------------------------


@query(REF_T + """ SELECT clip_id, track_id, start_frame, end_frame, observations, round(start_u,9) AS start_u,
  round(end_u,9) AS end_u, round(displacement,9) AS displacement, outcome, direction FROM rt""")
def count_trajectories(s, d):
    t = ref_tracks(s, d)
    return t.withColumns({c: F.round(c, 9) for c in ("start_u", "end_u", "displacement")})


@query(REF_T + """ SELECT r_name AS region, count(*) FILTER (direction='right') AS right_passages,
  count(*) FILTER (direction='left') AS left_passages, count(*) AS tracks,
  count(*) FILTER (outcome='stationary') AS stationary FROM rt JOIN region ON r_regionkey=clip_id%5 GROUP BY 1""")
def passages_by_location(s, d):
    region = ad.table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("region"))
    t = ref_tracks(s, d).withColumn("k", F.col("clip_id") % 5)
    per = t.groupBy("k").agg(
        F.count(F.when(F.col("direction") == "right", 1)).alias("right_passages"),
        F.count(F.when(F.col("direction") == "left", 1)).alias("left_passages"),
        F.count(F.lit(1)).alias("tracks"),
        F.count(F.when(F.col("outcome") == "stationary", 1)).alias("stationary"),
    )
    return per.join(region, "k").drop("k")


@query(REF_T + """, c AS (SELECT clip_id, count(*) FILTER (direction='right') AS "right",
  count(*) FILTER (direction='left') AS "left" FROM rt GROUP BY 1),
  o AS (SELECT *, CASE clip_id%3 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END AS up FROM c)
  SELECT clip_id, "right", "left", CASE up WHEN 'right' THEN "right" WHEN 'left' THEN "left" END AS upstream,
  CASE up WHEN 'right' THEN "left" WHEN 'left' THEN "right" END AS downstream,
  CASE up WHEN 'right' THEN "right"-"left" WHEN 'left' THEN "left"-"right" END AS net_upstream FROM o""")
def river_counts(s, d):
    up = F.when(F.col("clip_id") % 3 == 0, "right").when(F.col("clip_id") % 3 == 1, "left")
    return ct.river_counts(ct.tally(ref_tracks(s, d)), up)


PAIRS = BOTH_T + """,
rc AS (SELECT clip_id, count(*) FILTER (direction='right') AS r, count(*) FILTER (direction='left') AS l FROM rt GROUP BY 1),
pc AS (SELECT clip_id, count(*) FILTER (direction='right') AS r, count(*) FILTER (direction='left') AS l FROM pt GROUP BY 1),
pairs AS (SELECT clips.*, coalesce(rc.r,0) AS ref_right, coalesce(rc.l,0) AS ref_left, coalesce(pc.r,0) AS pred_right,
  coalesce(pc.l,0) AS pred_left, num_frames/framerate AS duration_s,
  abs(coalesce(pc.r,0)-coalesce(rc.r,0))+abs(coalesce(pc.l,0)-coalesce(rc.l,0)) AS err,
  greatest(coalesce(rc.r,0)-coalesce(pc.r,0),0)+greatest(coalesce(rc.l,0)-coalesce(pc.l,0),0) AS missed
  FROM clips LEFT JOIN rc USING (clip_id) LEFT JOIN pc USING (clip_id))"""
SUMMARY = """count(*) AS clips, sum(err) AS absolute_error, sum(ref_right+ref_left) AS reference_passages,
  sum(pred_right+pred_left) AS predicted_passages, sum(missed) AS missed_passages, sum(err)-sum(missed) AS false_passages,
  round(sum(duration_s)/3600.0::DOUBLE, 6) AS hours,
  sum(err)::DOUBLE/nullif(sum(ref_right+ref_left),0)::DOUBLE AS nmae,
  round(sum(pred_right+pred_left)/(sum(duration_s)/3600.0::DOUBLE), 6) AS predicted_per_hour"""


def clip_pairs(s, d):
    pairs = ct.paired_counts(ad.clips(s, d), ct.tally(ref_tracks(s, d)), ct.tally(pred_tracks(s, d)))
    return pairs.withColumn("duration_s", F.col("num_frames") / F.col("framerate"))


@query(PAIRS + """ SELECT clip_id, ref_right, ref_left, pred_right, pred_left, err AS absolute_error,
  missed AS missed_passages, err-missed AS false_passages FROM pairs""")
def clip_count_errors(s, d):
    return clip_pairs(s, d).select(
        "clip_id", "ref_right", "ref_left", "pred_right", "pred_left", ct.absolute_error().alias("absolute_error"),
        ct.missed().alias("missed_passages"), ct.false_passages().alias("false_passages"),
    )


@query(PAIRS + f" SELECT location, {SUMMARY} FROM pairs GROUP BY ROLLUP(location)")
def location_nmae(s, d):
    return ct.summarize(clip_pairs(s, d), "location", overall=True)


@query(PAIRS + f""", g AS (SELECT location, {SUMMARY} FROM pairs GROUP BY 1)
  SELECT round(avg(nmae), 9) AS macro_nmae, count(nmae) AS groups FROM g""")
def macro_nmae(s, d):
    return ct.macro_nmae(ct.summarize(clip_pairs(s, d), "location"))


@query(PAIRS + f""", s AS (SELECT *, CASE clip_id%4 WHEN 0 THEN 'LeftFar' WHEN 1 THEN 'LeftNear' WHEN 2 THEN 'RightFar'
  ELSE 'RightNear' END || ' stratum ' || (clip_id%2+1) AS slice FROM pairs)
  SELECT slice, {SUMMARY} FROM s GROUP BY ROLLUP(slice)""")
def slice_nmae(s, d):
    from shoalcount.functions.names import camera_slice

    return ct.summarize(clip_pairs(s, d).withColumn("slice", camera_slice(F.col("clip_name"))), "slice", overall=True)


@query(PAIRS + """ SELECT clip_id, ref_right, ref_left, pred_right, pred_left, err AS absolute_error FROM pairs""")
def evaluate_predictions(s, d):
    pred, cl = ad.predicted_boxes(s, d), ad.clips(s, d)
    out = ct.evaluate_predictions(cl, ad.reference_boxes(s, d), pred, pred.select("clip_id"))
    return out.select("clip_id", "ref_right", "ref_left", "pred_right", "pred_left", ct.absolute_error().alias("absolute_error"))


@query("""SELECT l_partkey%50 AS clip_id, l_orderkey AS track_id, l_linenumber AS frame_index, count(*) AS n
  FROM lineitem GROUP BY 1,2,3 HAVING count(*)>1""")
def duplicate_track_frames(s, d):
    rows = ad.table(s, d, "lineitem").select(
        (F.col("l_partkey") % 50).alias("clip_id"), F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("frame_index")
    )
    return ct.duplicate_frames(rows)


# --- box projections -----------------------------------------------------------------------


@query("WITH " + q.REF + """ SELECT clip_id, track_id, frame_index+1 AS frame, x_min+1 AS bb_left, y_min+1 AS bb_top,
  x_max-x_min AS bb_width, y_max-y_min AS bb_height FROM ref""")
def boxes_to_mot(s, d):
    return bx.internal_to_mot(ad.reference_boxes(s, d))


@query("WITH " + q.REF + " SELECT * FROM ref")
def mot_round_trip(s, d):
    return bx.mot_to_internal(bx.internal_to_mot(ad.reference_boxes(s, d)))


@query("WITH " + q.DET + """ SELECT clip_id, frame_index, det_id, x_min, x_max FROM det
  WHERE score >= 0.6 AND frame_index >= 3 AND frame_index < 9""")
def thresholded_detections(s, d):
    df = bx.in_frame_range(bx.above(ad.detections(s, d), 0.6), 3, 9)
    return df.select("clip_id", "frame_index", "det_id", "x_min", "x_max")


@query("WITH " + q.DET + """, c AS (SELECT clip_id, det_id, least(greatest(x_min,0),640) AS x_min, least(greatest(y_min,0),480) AS y_min,
  least(greatest(x_max,0),640) AS x_max, least(greatest(y_max,0),480) AS y_max FROM det)
  SELECT * FROM c WHERE x_max-x_min>=8 AND y_max-y_min>=8""")
def clipped_boxes(s, d):
    return bx.clip_boxes(ad.detections(s, d), W, H, 8).select("clip_id", "det_id", *g.EDGES)


@query("WITH " + q.DET + """, c AS (SELECT clip_id, det_id, least(greatest(x_min,0),640) AS x_min, least(greatest(y_min,0),480) AS y_min,
  least(greatest(x_max,0),640) AS x_max, least(greatest(y_max,0),480) AS y_max FROM det)
  SELECT * FROM c WHERE x_max>x_min AND y_max>y_min""")
def nonempty_clipped_boxes(s, d):
    return bx.clip_boxes(ad.detections(s, d), W, H).select("clip_id", "det_id", *g.EDGES)


@query("WITH " + q.REF + """, f AS (SELECT clip_id, track_id, frame_index, 640-x_max AS x_min, y_min, 640-x_min AS x_max, y_max FROM ref)"""
  + q.track_counts("f", "ft") + """ SELECT clip_id, count(*) FILTER (direction='right') AS "right",
  count(*) FILTER (direction='left') AS "left" FROM ft GROUP BY 1""")
def mirrored_counts(s, d):
    return ct.tally(ct.count_trajectories(bx.flip_horizontal(ad.reference_boxes(s, d), W), W, H))


@query("WITH " + q.DET + """, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY det_id) AS slot FROM det)
  SELECT clip_id, frame_index, slot, (x_min+x_max)/2 AS cx, (y_min+y_max)/2 AS cy, x_max-x_min AS w, y_max-y_min AS h
  FROM r WHERE slot<=20""")
def target_rows(s, d):
    return bx.to_targets(ad.detections(s, d), 20, "det_id")


@query("WITH " + q.REF + """ SELECT clip_id, track_id, frame_index, round(x_min*0.65::DOUBLE,6) AS x_min,
  round(y_min*0.65::DOUBLE,6) AS y_min, round((x_max*0.65::DOUBLE)/0.65::DOUBLE,6) AS x_back FROM ref""")
def letterboxed_boxes(s, d):
    scale = g.letterbox_scale(H, W, 416, 416)
    df = bx.scale_boxes(ad.reference_boxes(s, d), scale)
    return df.select(
        "clip_id", "track_id", "frame_index", F.round("x_min", 6).alias("x_min"), F.round("y_min", 6).alias("y_min"),
        F.round(F.col("x_max") / scale, 6).alias("x_back"),
    )


@query("WITH " + q.REF + q.CLIPS + " SELECT clip_id, unnest(range(0, num_frames, 3)) AS frame_index FROM clips")
def sampled_frames(s, d):
    return bx.sample_frames(ad.clips(s, d), 3)


@query("WITH " + q.PRED + """, i AS (SELECT clip_id, CASE WHEN x_max<=x_min OR y_max<=y_min THEN 'non_positive_box_size'
  WHEN x_max<=0 OR y_max<=0 OR x_min>=640 OR y_min>=480 THEN 'box_outside_image'
  WHEN x_min<0 OR y_min<0 OR x_max>640 OR y_max>480 THEN 'box_partially_outside_image' END AS code FROM pred)
  SELECT clip_id, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1,2""")
def box_issues(s, d):
    df = ad.predicted_boxes(s, d).withColumn("code", bx.box_issue(W, H))
    return df.where("code is not null").groupBy("clip_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + q.PRED + """ SELECT clip_id, track_id, frame_index FROM pred
  WHERE (x_max-x_min)*(y_max-y_min)*(12.0/640*9.0/480)*(1+track_id%3) BETWEEN 0.3 AND 0.5""")
def physical_size(s, d):
    m2 = F.lit(12.0 / 640 * 9.0 / 480)
    df = bx.physical_size_filter(ad.predicted_boxes(s, d), g.area(g.box()) * (1 + F.col("track_id") % 3), m2, 0.3, 0.5)
    return df.select("clip_id", "track_id", "frame_index")


@query(REF_T + " SELECT clip_id, track_id FROM rt WHERE start_frame<=12 AND 12<=end_frame")
def tracks_at_frame(s, d):
    return bx.tracks_at(ref_tracks(s, d), F.lit(12)).select("clip_id", "track_id")


# --- matching ------------------------------------------------------------------------------

IOU = """(greatest(least(a.x_max,b.x_max)-greatest(a.x_min,b.x_min),0)*greatest(least(a.y_max,b.y_max)-greatest(a.y_min,b.y_min),0))
  /(600.0::DOUBLE+600.0::DOUBLE-greatest(least(a.x_max,b.x_max)-greatest(a.x_min,b.x_min),0)*greatest(least(a.y_max,b.y_max)-greatest(a.y_min,b.y_min),0))"""
SHARED = BOTH_T + f""",
sh AS (SELECT a.clip_id, a.track_id AS ref_id, b.track_id AS pred_id, count(*) AS shared FROM ref a JOIN pred b
  ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index AND {IOU} >= 0.3 GROUP BY 1,2,3)"""
FEATURES = SHARED + """,
m AS (SELECT sh.*, rt.direction AS rd, pt.direction AS pd, pt.start_u AS u0, pt.end_u AS u1,
    coalesce(rt.direction=pt.direction, false) AS same, count(*) OVER (PARTITION BY sh.clip_id, pred_id) AS follows
  FROM sh JOIN rt ON rt.clip_id=sh.clip_id AND rt.track_id=ref_id JOIN pt ON pt.clip_id=sh.clip_id AND pt.track_id=pred_id
  WHERE shared>=3),
a AS (SELECT *, same AND row_number() OVER (PARTITION BY clip_id, pred_id ORDER BY same DESC, shared DESC, ref_id)=1 AS att FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY clip_id, ref_id ORDER BY att DESC, shared DESC, pred_id) AS place FROM a),
ro AS (SELECT rt.clip_id, rt.track_id, rt.direction, rt.start_frame, rt.end_frame, CASE WHEN bool_or(coalesce(att,false)) THEN 'counted'
    WHEN bool_or(coalesce(pd<>rd,false)) THEN 'wrong_direction' WHEN count(pred_id)=0 THEN 'missed_fish'
    WHEN max(follows)>=2 THEN 'merged_track' WHEN count(pred_id)>=2 THEN 'split_track'
    WHEN min(least(abs(u0-0.5),abs(u1-0.5)))<0.05 THEN 'ambiguous_start_end' ELSE 'partial_track' END AS outcome
  FROM rt LEFT JOIN f ON f.clip_id=rt.clip_id AND f.ref_id=rt.track_id WHERE rt.direction IS NOT NULL GROUP BY 1,2,3,4,5),
po AS (SELECT pt.clip_id, pt.track_id, pt.direction, pt.start_frame, pt.end_frame, CASE WHEN count(ref_id)=0 THEN 'background'
    WHEN bool_or(att AND place=1) THEN 'counted' WHEN bool_or(att AND place>1) THEN 'duplicate'
    WHEN bool_or(rd IS NOT NULL) THEN 'wrong_direction' ELSE 'non_passing_fish' END AS outcome
  FROM pt LEFT JOIN f ON f.clip_id=pt.clip_id AND f.pred_id=pt.track_id WHERE pt.direction IS NOT NULL GROUP BY 1,2,3,4,5)"""


@query("WITH " + q.PRED + f""" SELECT a.clip_id, a.frame_index, a.track_id AS ref_id, b.track_id AS pred_id, round({IOU},9) AS iou
  FROM ref a JOIN pred b ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index WHERE {IOU} >= 0.3""")
def box_overlap_join(s, d):
    cols = ["clip_id", "frame_index", "track_id", *g.EDGES]
    df = mt.overlap_join(ad.reference_boxes(s, d).select(*cols), ad.predicted_boxes(s, d).select(*cols), 0.3)
    return df.select("clip_id", "frame_index", F.col("a_track_id").alias("ref_id"), F.col("b_track_id").alias("pred_id"), F.round("iou", 9).alias("iou"))


@query(SHARED + " SELECT * FROM sh WHERE shared>=3")
def match_tracks(s, d):
    return mt.match_tracks(ad.reference_boxes(s, d), ad.predicted_boxes(s, d))


def features(s, d):
    """Match features and both sides' track tables.

    Track tables are one row per track and used several times below, so they are stored once
    instead of being recomputed from the boxes by every branch.
    """
    ref, pred = ad.reference_boxes(s, d), ad.predicted_boxes(s, d)
    rc, pc = materialize(ct.count_trajectories(ref, W, H)), materialize(ct.count_trajectories(pred, W, H))
    return materialize(mt.match_features(mt.match_tracks(ref, pred), rc, pc)), rc, pc


@query(FEATURES + " SELECT * FROM ro")
def reference_passage_outcomes(s, d):
    f, rc, _ = features(s, d)
    return mt.reference_outcomes(f, rc)


@query(FEATURES + " SELECT * FROM po")
def predicted_passage_outcomes(s, d):
    f, _, pc = features(s, d)
    return mt.predicted_outcomes(f, pc)


@query(FEATURES + ", b AS (SELECT 'reference' AS side, outcome FROM ro UNION ALL SELECT 'predicted', outcome FROM po) SELECT side, "
  + ", ".join(f"count(*) FILTER (outcome='{o}') AS {o}" for o in dict.fromkeys(mt.REFERENCE_OUTCOMES + mt.PREDICTED_OUTCOMES))
  + " FROM b GROUP BY 1")
def passage_outcome_totals(s, d):
    f, rc, pc = features(s, d)
    return mt.outcome_totals(mt.reference_outcomes(f, rc), mt.predicted_outcomes(f, pc))


@query(FEATURES + """, best AS (SELECT clip_id, ref_id, arg_max(coalesce(pd,'none'), shared*1000000000-pred_id) AS p FROM f GROUP BY 1,2),
  c AS (SELECT coalesce(direction,'none') AS reference, coalesce(p,'none') AS predicted FROM rt LEFT JOIN best
    ON best.clip_id=rt.clip_id AND ref_id=track_id
  UNION ALL SELECT 'none', direction FROM pt WHERE direction IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.clip_id=pt.clip_id AND f.pred_id=pt.track_id))
  SELECT reference, count(*) FILTER (predicted='right') AS "right", count(*) FILTER (predicted='left') AS "left",
  count(*) FILTER (predicted='none') AS "none" FROM c GROUP BY 1""")
def direction_confusion(s, d):
    return mt.direction_confusion(*features(s, d))


DET_PAIRS = "WITH RECURSIVE " + q.DET + f""",
pr AS (SELECT a.clip_id, a.frame_index, a.track_id, b.det_id, {IOU} AS iou FROM ref a JOIN det b
  ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index WHERE {IOU} >= 0.3)"""
# Greedy matching in SQL: walk each frame's pairs in order, carrying the used IDs.
GREEDY = """,
lst AS (SELECT clip_id, frame_index, list({'r': track_id, 'p': det_id, 'iou': iou} ORDER BY iou DESC, track_id, det_id) AS l FROM pr GROUP BY 1,2),
gr AS (SELECT clip_id, frame_index, l, 1 AS i, []::BIGINT[] AS ur, []::BIGINT[] AS up FROM lst
  UNION ALL SELECT clip_id, frame_index, l, i+1,
    CASE WHEN list_contains(ur, l[i].r) OR list_contains(up, l[i].p) THEN ur ELSE list_append(ur, l[i].r) END,
    CASE WHEN list_contains(ur, l[i].r) OR list_contains(up, l[i].p) THEN up ELSE list_append(up, l[i].p) END
  FROM gr WHERE i<=len(l)),
done AS (SELECT * FROM gr WHERE i=len(l)+1),
mtch AS (SELECT clip_id, frame_index, unnest(ur) AS track_id, unnest(up) AS det_id FROM done)"""


def det_matches(s, d):
    ref, det = ad.reference_boxes(s, d), ad.detections(s, d)
    return ref, det, mt.match_detections(ref, det)


@query(DET_PAIRS + GREEDY + " SELECT * FROM mtch")
def greedy_detection_matches(s, d):
    return det_matches(s, d)[2].select("clip_id", "frame_index", "track_id", "det_id")


@query(DET_PAIRS + GREEDY + """, r AS (SELECT clip_id, count(*) AS reference_boxes FROM ref GROUP BY 1),
  p AS (SELECT clip_id, count(*) AS detections FROM det GROUP BY 1), m AS (SELECT clip_id, count(*) AS matched FROM mtch GROUP BY 1)
  SELECT clip_id, coalesce(reference_boxes,0) AS reference_boxes, coalesce(detections,0) AS detections, coalesce(matched,0) AS matched,
  coalesce(matched,0)::DOUBLE/nullif(reference_boxes,0) AS recall, coalesce(matched,0)::DOUBLE/nullif(detections,0) AS precision
  FROM r FULL JOIN p USING (clip_id) LEFT JOIN m USING (clip_id)""")
def detection_recall_precision(s, d):
    return mt.detection_summary(*det_matches(s, d))


@query("WITH " + q.DET + f""", hit AS (SELECT DISTINCT a.clip_id, a.frame_index, a.track_id FROM ref a JOIN det b
  ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index WHERE {IOU} >= 0.3),
  z AS (SELECT r.*, (x_max-x_min)*(y_max-y_min)*((12.0::DOUBLE/640*9.0::DOUBLE/480)*(1+r.track_id%5)) AS sz, hit.track_id IS NOT NULL AS f
  FROM ref r LEFT JOIN hit USING (clip_id, frame_index, track_id))
  SELECT (sz>=0.3)::INT+(sz>=0.6)::INT+(sz>=1.0)::INT AS size_bin, count(*) AS reference_boxes, count(*) FILTER (f) AS found,
  (count(*) FILTER (f))::DOUBLE/count(*) AS recall FROM z GROUP BY 1""")
def recall_by_size(s, d):
    m2 = F.lit(12.0 / 640 * 9.0 / 480) * (1 + F.col("track_id") % 5)
    return mt.recall_by_size(ad.reference_boxes(s, d), ad.detections(s, d), m2, (0.3, 0.6, 1.0))


SUPPRESS = "WITH RECURSIVE " + q.DET + f""",
e AS (SELECT a.clip_id, a.frame_index, a.det_id AS s, b.det_id AS w FROM det a JOIN det b ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index
  WHERE (a.score>b.score OR (a.score=b.score AND a.det_id<b.det_id)) AND {{test}}),
o AS (SELECT clip_id, frame_index, list(det_id ORDER BY score DESC, det_id) AS l FROM det GROUP BY 1,2),
st AS (SELECT clip_id, frame_index, w, list(s) AS ss FROM e GROUP BY 1,2,3),
mp AS (SELECT clip_id, frame_index, map(list(w), list(ss)) AS m FROM st GROUP BY 1,2),
w AS (SELECT o.clip_id, o.frame_index, l, m, 1 AS i, []::BIGINT[] AS kept FROM o LEFT JOIN mp USING (clip_id, frame_index)
  UNION ALL SELECT clip_id, frame_index, l, m, i+1,
    CASE WHEN m IS NOT NULL AND list_has_any(coalesce(m[l[i]], []::BIGINT[]), kept) THEN kept ELSE list_append(kept, l[i]) END
  FROM w WHERE i<=len(l))
SELECT clip_id, frame_index, unnest(kept) AS det_id FROM w WHERE i=len(l)+1"""
CONTAIN = """(greatest(least(a.x_max,b.x_max)-greatest(a.x_min,b.x_min),0)*greatest(least(a.y_max,b.y_max)-greatest(a.y_min,b.y_min),0))/600.0::DOUBLE"""


@query(SUPPRESS.format(test=f"({IOU}) > 0.4"))
def iou_suppression(s, d):
    return mt.suppress_overlaps(ad.detections(s, d), iou=0.4).select("clip_id", "frame_index", "det_id")


@query(SUPPRESS.format(test=f"(({IOU}) > 0.65 OR {CONTAIN} > 0.5)"))
def containment_suppression(s, d):
    return mt.suppress_overlaps(ad.detections(s, d), iou=0.65, containment=0.5).select("clip_id", "frame_index", "det_id")


@query("WITH RECURSIVE " + q.DET + """,
dd AS (SELECT *, x_min+det_id%3 AS bx0, x_max+det_id%3 AS bx1, score+(det_id%2)*0.01 AS bs FROM det WHERE det_id%19<>0),
prx AS (SELECT a.clip_id, a.frame_index, a.det_id AS track_id, b.det_id, greatest(abs(a.x_min-b.bx0),abs(a.x_max-b.bx1),abs(a.y_min-b.y_min),abs(a.y_max-b.y_max)) AS dist
  FROM det a JOIN dd b ON a.clip_id=b.clip_id AND a.frame_index=b.frame_index),
pr AS (SELECT clip_id, frame_index, track_id, det_id, -dist AS iou FROM prx WHERE dist<=5)""" + GREEDY + """
 SELECT m.clip_id, count(*) AS matched, max(-iou) AS max_px, sum((m.track_id=m.det_id)::INT) AS same FROM mtch m
 JOIN pr USING (clip_id, frame_index, track_id, det_id) GROUP BY 1""")
def host_detection_match(s, d):
    a = ad.detections(s, d)
    b = a.where("det_id % 19 <> 0").withColumns(
        {"x_min": F.col("x_min") + F.col("det_id") % 3, "x_max": F.col("x_max") + F.col("det_id") % 3,
         "score": F.col("score") + (F.col("det_id") % 2) * 0.01}
    )
    m = mt.match_hosts(a, b, 5.0)
    return m.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("matched"), F.max("distance").alias("max_px"),
        F.sum((F.col("a_det_id") == F.col("b_det_id")).cast("int")).alias("same"),
    )
