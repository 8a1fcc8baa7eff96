"""Scores, queue, audit and prioritisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.checks import counting as cc
from shoalcount.operators import audit as au
from shoalcount.operators import boxes as bx
from shoalcount.operators import counting as ct
from shoalcount.operators import intervals as iv
from shoalcount.operators import matching as mt
from shoalcount.operators import ordered as od
from shoalcount.operators import prioritization as pr
from shoalcount.operators import scoring as sc
from shoalcount.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BUDGETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
MX, MY = 12.0 / ad.WIDTH, 9.0 / ad.HEIGHT


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def features(s, d):
    boxes = ad.predicted_boxes(s, d)
    return sc.track_features(boxes, ct.count_trajectories(boxes, cc.W, cc.H), MX, MY)


def reviewed_tracks(s, d):
    # Rounded to 9 decimals so that equal scores tie in every engine.
    return sc.review(features(s, d)).withColumn("review_score", F.round("review_score", 9))


def stored_tracks(s, d):
    """The reviewed track table, stored once: one row per track, read several times."""
    return materialize(reviewed_tracks(s, d))


# The SQL score follows the published table of components; each step is its own CTE.
FEAT_BODY = f""",
ctr AS (SELECT clip_id, track_id, frame_index, score, (x_min+x_max)/2*(12.0::DOUBLE/640) AS cx, (y_min+y_max)/2*(9.0::DOUBLE/480) AS cy FROM pred),
stp AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM ctr WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame_index)),
pth AS (SELECT clip_id, track_id, avg(score) AS mean_score, coalesce(sum(sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py))),0) AS path_m,
  sqrt(pow(arg_max(cx,frame_index)-arg_min(cx,frame_index),2)+pow(arg_max(cy,frame_index)-arg_min(cy,frame_index),2)) AS net_m FROM stp GROUP BY 1,2),
crd AS (SELECT a.clip_id, a.track_id, count(DISTINCT a.frame_index) AS crowded FROM pred a JOIN pred b ON a.clip_id=b.clip_id
  AND a.frame_index=b.frame_index AND a.track_id<>b.track_id AND {cc.IOU} > 0.1 GROUP BY 1,2),
feat AS (SELECT pt.*, mean_score, end_frame-start_frame+1 AS span_frames, 1.0::DOUBLE-observations::DOUBLE/(end_frame-start_frame+1) AS gap_fraction,
  CASE WHEN path_m>0 THEN net_m/path_m ELSE 1.0::DOUBLE END AS straightness, coalesce(crowded,0)::DOUBLE/observations AS crowding,
  least(abs(start_u-0.5),abs(end_u-0.5)) AS line_margin, direction IS NOT NULL AS is_passage
  FROM pt JOIN pth USING (clip_id, track_id) LEFT JOIN crd USING (clip_id, track_id)),
comp AS (SELECT *, least(greatest((mean_score-0.2::DOUBLE)/(0.6::DOUBLE-0.2::DOUBLE),0),1) AS c1, least(greatest((observations-3)/12.0::DOUBLE,0),1) AS c2,
  1-least(greatest(gap_fraction/0.5::DOUBLE,0),1) AS c3, least(greatest(straightness,0),1) AS c4, 1-least(greatest(crowding,0),1) AS c5,
  least(greatest(line_margin/0.15::DOUBLE,0),1) AS c6 FROM feat),
scr AS (SELECT *, exp((ln(greatest(c1,0.01))+ln(greatest(c2,0.01))+ln(greatest(c3,0.01))+ln(greatest(c4,0.01))+ln(greatest(c5,0.01))+ln(greatest(c6,0.01)))/6) AS review_score,
  CASE WHEN is_passage AND straightness<0.3 THEN 'back_and_forth' WHEN is_passage AND line_margin<0.02 THEN 'endpoint_on_line'
    WHEN NOT is_passage AND line_margin<0.05 AND observations>=5 THEN 'possible_missed_passage' END AS special FROM comp),
rvw AS (SELECT *, CASE WHEN special IN ('back_and_forth','endpoint_on_line') THEN 'unresolved' WHEN special IS NOT NULL THEN 'needs_review'
    WHEN is_passage AND review_score<0.6 THEN 'needs_review' ELSE 'suggested' END AS triage,
  concat_ws(',', special, CASE WHEN c1<0.5 THEN 'detection' END, CASE WHEN c2<0.5 THEN 'duration' END, CASE WHEN c3<0.5 THEN 'continuity' END,
    CASE WHEN c4<0.5 THEN 'motion' END, CASE WHEN c5<0.5 THEN 'separation' END, CASE WHEN c6<0.5 THEN 'line_distance' END) AS reasons FROM scr)"""
RVW = "WITH " + q.PRED + q.track_counts("pred", "pt") + FEAT_BODY
TRI = "CASE triage WHEN 'unresolved' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'suggested' THEN 2 ELSE 3 END, (direction IS NULL)::INT, round(review_score, 9)"


@query(RVW + """ SELECT clip_id, track_id, round(mean_score,6) AS mean_score, span_frames, round(gap_fraction,6) AS gap_fraction,
  round(straightness,6) AS straightness, round(crowding,6) AS crowding, round(line_margin,6) AS line_margin, is_passage FROM feat""")
def track_features(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return features(s, d).select(
        "clip_id", "track_id", r("mean_score"), "span_frames", r("gap_fraction"), r("straightness"), r("crowding"), r("line_margin"), "is_passage"
    )


@query(RVW + " SELECT clip_id, track_id, round(review_score,6) AS review_score, triage, reasons FROM rvw")
def review_scores(s, d):
    return sc.review(features(s, d)).select(
        "clip_id", "track_id", F.round("review_score", 6).alias("review_score"), "triage", F.concat_ws(",", "review_reasons").alias("reasons")
    )


@query(RVW + " SELECT clip_id, count(*) AS flagged FROM rvw WHERE is_passage OR triage<>'suggested' GROUP BY 1")
def flagged_tracks(s, d):
    return reviewed_tracks(s, d).where(sc.is_flagged()).groupBy("clip_id").agg(F.count(F.lit(1)).alias("flagged"))


@query(RVW + f" SELECT clip_id, track_id, row_number() OVER (PARTITION BY clip_id ORDER BY {TRI}, track_id)-1 AS queue_rank FROM rvw")
def review_queue(s, d):
    return sc.queue_position(stored_tracks(s, d)).select("clip_id", "track_id", "queue_rank")


@query("WITH " + q.PRED + q.track_counts("pred", "pt") + """ SELECT clip_id, track_id,
  row_number() OVER (PARTITION BY clip_id ORDER BY start_frame, track_id)-1 AS queue_rank FROM pt""")
def queue_without_triage(s, d):
    return sc.by_start_position(materialize(cc.pred_tracks(s, d))).select("clip_id", "track_id", "queue_rank")


@query(RVW + f" SELECT clip_id, track_id, triage FROM rvw ORDER BY {TRI}, clip_id, track_id LIMIT 50 OFFSET 100")
def queue_page(s, d):
    return sc.page(reviewed_tracks(s, d), sc.queue_order(("clip_id", "track_id")), 100, 50).select("clip_id", "track_id", "triage")


@query("WITH " + q.PRED + " SELECT clip_id, frame_index, track_id, x_min, y_min, x_max, y_max, score FROM pred WHERE frame_index>=5 AND frame_index<8")
def observation_window(s, d):
    df = bx.in_frame_range(ad.predicted_boxes(s, d), 5, 8).orderBy("clip_id", "frame_index", "track_id")
    return df.select("clip_id", "frame_index", "track_id", "x_min", "y_min", "x_max", "y_max", "score")


@query(RVW + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY {TRI}, track_id)-1 AS qr,
  count(*) OVER (PARTITION BY clip_id) AS n, track_id%3=0 AS done FROM rvw),
  a AS (SELECT clip_id, track_id AS after_track, qr AS q0 FROM rk WHERE track_id%10=0)
  SELECT a.clip_id, after_track, arg_min(track_id, (qr-q0-1+n)%n) AS next_track FROM a JOIN rk ON rk.clip_id=a.clip_id WHERE NOT done GROUP BY 1,2""")
def next_unreviewed(s, d):
    ranked = materialize(sc.queue_position(stored_tracks(s, d)).withColumn(
        "review_state", F.when(F.col("track_id") % 3 == 0, "accepted").otherwise("automatic")
    ))
    return sc.next_unreviewed(ranked, ranked.where("track_id % 10 = 0").select("clip_id", "track_id"))


# --- intervals -----------------------------------------------------------------------------

FLAGGED = """flg AS (SELECT l_suppkey AS clip_id, (l_partkey*3+l_orderkey*7)%60000 AS first, (l_partkey*3+l_orderkey*7)%60000+l_quantity::BIGINT AS last FROM lineitem),
  cl AS (SELECT s_suppkey AS clip_id, s_name AS clip_name, 60000 AS num_frames FROM supplier)"""
FREE = "WITH " + FLAGGED + """,
w AS (SELECT clip_id, greatest(0, first-10) AS lo, least(60000, last+11) AS hi FROM flg),
p AS (SELECT *, max(hi) OVER (PARTITION BY clip_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w),
fr AS (SELECT clip_id, coalesce(prev,0) AS start_frame, lo AS stop_frame FROM p WHERE lo>coalesce(prev,0)
  UNION ALL SELECT cl.clip_id, coalesce(max(hi),0), 60000 FROM cl LEFT JOIN w USING (clip_id) GROUP BY 1 HAVING coalesce(max(hi),0)<60000)"""


def flagged_intervals(s, d):
    flagged = ad.table(s, d, "lineitem").selectExpr(
        "l_suppkey as clip_id", "(l_partkey * 3 + l_orderkey * 7) % 60000 as first", "(l_partkey * 3 + l_orderkey * 7) % 60000 + bigint(l_quantity) as last"
    )
    clips = ad.table(s, d, "supplier").selectExpr("s_suppkey as clip_id", "s_name as clip_name", "60000L as num_frames")
    return clips, flagged


@query(FREE + " SELECT * FROM fr")
def unflagged_runs(s, d):
    return iv.free_runs(*flagged_intervals(s, d), 10)


@query(FREE + " SELECT clip_id, sum(stop_frame-start_frame) AS unflagged_frames FROM fr GROUP BY 1")
def unflagged_frames(s, d):
    return iv.free_runs(*flagged_intervals(s, d), 10).groupBy("clip_id").agg(
        F.sum(F.col("stop_frame") - F.col("start_frame")).alias("unflagged_frames")
    )


@query()
def audit_windows(s, d):
    return au.audit_windows(*flagged_intervals(s, d), window=50, fraction=0.1, margin=10)


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS clip_id, l_partkey AS frame_index FROM lineitem),
  i AS (SELECT *, frame_index-row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS g FROM f)
  SELECT clip_id, min(frame_index) AS start, max(frame_index) AS stop, count(*) AS n FROM i GROUP BY clip_id, g""")
def frame_runs(s, d):
    f = ad.table(s, d, "lineitem").selectExpr("l_suppkey as clip_id", "l_partkey as frame_index").distinct()
    return od.islands(f, ["clip_id"], "frame_index", bucket_size=256)


PT = "WITH " + q.PRED + q.track_counts("pred", "pt")


@query(PT + """ SELECT a.clip_id, a.track_id, count(b.track_id) AS nearby FROM pt a LEFT JOIN pt b ON a.clip_id=b.clip_id AND a.track_id<>b.track_id
  AND b.direction IS NOT NULL AND b.start_frame<=a.end_frame+2 AND a.start_frame<=b.end_frame+2 GROUP BY 1,2""")
def counted_nearby(s, d):
    t = materialize(cc.pred_tracks(s, d))
    return iv.nearby_counts(t, t.where("direction is not null"), 2, F.col("direction").isNotNull()).select("clip_id", "track_id", "nearby")


@query(PT + """, u AS (SELECT a.clip_id, EXISTS (SELECT 1 FROM pt b WHERE b.clip_id=a.clip_id AND b.direction IS NOT NULL
    AND b.start_frame<=a.end_frame+1 AND a.start_frame<=b.end_frame+1) AS near FROM pt a WHERE direction IS NULL)
  SELECT clip_id, count(*) AS uncounted_tracks, count(*) FILTER (near) AS with_question FROM u GROUP BY ROLLUP(clip_id)""")
def question_rate(s, d):
    t = materialize(cc.pred_tracks(s, d))
    flagged = iv.has_nearby(t.where("direction is null"), t.where("direction is not null"), 1)
    return flagged.rollup("clip_id").agg(
        F.count(F.lit(1)).alias("uncounted_tracks"), F.count(F.when(F.col("nearby"), 1)).alias("with_question")
    )


@query(cc.FEATURES + """ SELECT DISTINCT ref.clip_id, ref.track_id FROM ref JOIN ro USING (clip_id, track_id)
  WHERE ro.outcome='missed_fish' AND frame_index%8<2""")
def audited_missed_fish(s, d):
    f, rc, _ = cc.features(s, d)
    missed = mt.reference_outcomes(f, rc).where("outcome = 'missed_fish'").select("clip_id", "track_id")
    points = ad.reference_boxes(s, d).join(missed, ["clip_id", "track_id"], "left_semi")
    windows = ad.clips(s, d).selectExpr("clip_id", "explode(sequence(0L, num_frames, 8L)) as start_frame").withColumn(
        "stop_frame", F.col("start_frame") + 2
    )
    return iv.points_in_windows(points, windows).select("clip_id", "track_id").distinct()


# --- prioritisation ------------------------------------------------------------------------

REV = """, rev AS (SELECT f.clip_id, pred_id AS track_id, f.clip_id||':missed:'||ref_id AS error_id FROM f
    JOIN ro ON ro.clip_id=f.clip_id AND ro.track_id=f.ref_id WHERE ro.outcome<>'counted'
  UNION ALL SELECT clip_id, track_id, clip_id||':false:'||track_id FROM po WHERE outcome<>'counted'),
unr AS (SELECT clip_id, track_id FROM ro WHERE outcome<>'counted' AND clip_id||':missed:'||track_id NOT IN (SELECT error_id FROM rev)),
itm AS (SELECT clip_id, track_id, (3.0::DOUBLE+(end_frame-start_frame+1)/10.0::DOUBLE)::DECIMAL(18,6) AS cost_s, direction FROM pt),
bud AS (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])::DECIMAL(3,2) AS budget),
tot AS (SELECT (SELECT sum(cost_s) FROM itm) AS t, (SELECT count(DISTINCT error_id) FROM rev) AS rch, (SELECT count(*) FROM unr) AS un)"""


def error_sets(s, d):
    f, rc, pc = cc.features(s, d)
    ro, po = materialize(mt.reference_outcomes(f, rc)), mt.predicted_outcomes(f, pc)
    revealed = materialize(pr.reveals(f, ro, po))
    return pc, ro, revealed, pr.unreachable(ro, revealed)


@query(cc.FEATURES + REV + """ SELECT i.clip_id, i.track_id, cost_s::DOUBLE AS cost_s, count(DISTINCT error_id) AS reveals
  FROM itm i LEFT JOIN rev USING (clip_id, track_id) GROUP BY 1,2,3""")
def queue_items(s, d):
    pc, _, revealed, _ = error_sets(s, d)
    n = revealed.groupBy("clip_id", "track_id").agg(F.countDistinct("error_id").alias("reveals"))
    items = pr.queue_items(pc, F.lit(ad.FRAMERATE)).withColumn("cost_s", F.col("cost_s").cast("double"))
    return items.join(n, ["clip_id", "track_id"], "left").fillna(0, ["reveals"])


@query(cc.FEATURES + REV + " SELECT * FROM unr")
def unreachable_errors(s, d):
    return error_sets(s, d)[3].select("clip_id", "track_id")


CURVE = """ SELECT budget::DOUBLE AS budget, round(count(error_id) FILTER (c<=budget*t)/(max(rch)+max(un))::DOUBLE,9) AS all_errors,
  round(count(error_id) FILTER (c<=budget*t)/max(rch)::DOUBLE,9) AS reachable_errors FROM bud, tot, fst GROUP BY 1"""


@query(cc.FEATURES + FEAT_BODY + REV + f""", od AS (SELECT i.clip_id, i.track_id, sum(cost_s) OVER (ORDER BY
    {TRI.replace('direction', 'r.direction')}, i.clip_id, i.track_id ROWS UNBOUNDED PRECEDING) AS cum FROM itm i JOIN rvw r USING (clip_id, track_id)),
  fst AS (SELECT error_id, min(cum) AS c FROM od JOIN rev USING (clip_id, track_id) GROUP BY 1)""" + CURVE)
def found_curve(s, d):
    pc, _, revealed, missing = error_sets(s, d)
    tracks = reviewed_tracks(s, d).select("clip_id", "track_id", "triage", "direction", "review_score")
    items = materialize(pr.queue_items(pc, F.lit(ad.FRAMERATE)).join(tracks, ["clip_id", "track_id"]))
    out = pr.found_curve(items, revealed, missing, BUDGETS, sc.queue_order(("clip_id", "track_id")))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select(F.col("budget").cast("double").alias("budget"), r("all_errors"), r("reachable_errors"))


@query(cc.FEATURES + REV + f""", cp AS (SELECT i.*, r, {q.hash32("'0'", "r::VARCHAR", "clip_id::VARCHAR", "track_id::VARCHAR")} AS h FROM itm i, range(200) x(r)),
  od AS (SELECT r, clip_id, track_id, sum(cost_s) OVER (PARTITION BY r ORDER BY h, clip_id, track_id ROWS UNBOUNDED PRECEDING) AS cum FROM cp),
  fst AS (SELECT r, error_id, min(cum) AS c FROM od JOIN rev USING (clip_id, track_id) GROUP BY 1,2),
  per AS (SELECT r, budget, count(error_id) FILTER (c<=budget*t)/(max(rch)+max(un))::DOUBLE AS a, count(error_id) FILTER (c<=budget*t)/max(rch)::DOUBLE AS b
    FROM bud, tot, fst GROUP BY 1,2)
  SELECT budget::DOUBLE AS budget, round(avg(a),9) AS all_errors, round(avg(b),9) AS reachable_errors FROM per GROUP BY 1""")
def random_order_curve(s, d):
    pc, _, revealed, missing = error_sets(s, d)
    out = pr.random_order_curve(pr.queue_items(pc, F.lit(ad.FRAMERATE)), revealed, missing, BUDGETS, repeats=200)
    return out.withColumn("budget", F.col("budget").cast("double"))
