"""SQL twins of the adapter views, as common table expressions for the check queries."""

SIGHT = """
sight AS (SELECT event_id, (day(ts)-1)//7 + 5*(user_id//150) AS clip_id, user_id AS track_id,
  row_number() OVER (PARTITION BY (day(ts)-1)//7 + 5*(user_id//150), user_id ORDER BY ts, event_id)-1 AS frame_index
  FROM events)"""

REF = SIGHT + """,
refi AS (SELECT *, 200+(track_id*37)%240+((track_id*13+clip_id*7)%41-20)*frame_index+event_id%3-1 AS x,
  (track_id*53)%440 AS y FROM sight),
ref AS (SELECT clip_id, track_id, frame_index, x::DOUBLE AS x_min, y::DOUBLE AS y_min,
  (x+30)::DOUBLE AS x_max, (y+20)::DOUBLE AS y_max FROM refi)"""

PRED = REF + """,
base AS (SELECT event_id, clip_id, frame_index,
  CASE WHEN track_id%9=0 AND frame_index>=6 THEN track_id*2+1
       WHEN track_id%9=1 AND frame_index>=6 THEN (track_id-1)*2 ELSE track_id*2 END AS track_id,
  CASE WHEN track_id%10=7 AND (frame_index<2 OR frame_index>=8) THEN 610-x ELSE x+event_id%5-2 END AS x,
  y, (20+event_id%80)::DOUBLE/100.0::DOUBLE AS score
  FROM refi WHERE event_id%13<>0 AND track_id%17<>0 AND NOT (track_id%7=3 AND frame_index>=5)),
predi AS (SELECT event_id, clip_id, frame_index, track_id, x, y, score FROM base
  UNION ALL SELECT event_id, clip_id, frame_index, track_id+100000, x+3, y+2, score FROM base WHERE track_id%11=0
  UNION ALL SELECT event_id, clip_id, frame_index, track_id+200000, x, y+500, score FROM base WHERE track_id%13=0),
pred AS (SELECT clip_id, track_id, frame_index, x::DOUBLE AS x_min, y::DOUBLE AS y_min,
  (x+30)::DOUBLE AS x_max, (y+20)::DOUBLE AS y_max, score FROM predi)"""

DET = PRED + """,
det AS (SELECT clip_id, frame_index, x::DOUBLE AS x_min, y::DOUBLE AS y_min,
  (x+30)::DOUBLE AS x_max, (y+20)::DOUBLE AS y_max, score, event_id*4+track_id//100000 AS det_id FROM predi)"""

CLIPS = """,
clips AS (SELECT clip_id, format('{}_{}_Stratum{}_2018-06-{:02d}_120000_{}_{}', lower(r_name),
    (['LeftFar','LeftNear','RightFar','RightNear'])[clip_id%4+1], clip_id%2+1, clip_id%28+1,
    clip_id*10000, clip_id*10000+num_frames) AS clip_name,
  lower(r_name) AS location, num_frames, 640 AS width, 480 AS height, 10.0::DOUBLE AS framerate
  FROM (SELECT clip_id, max(frame_index)+1 AS num_frames FROM sight GROUP BY 1) s
  JOIN region ON r_regionkey = clip_id%5)"""


def track_counts(source: str, name: str) -> str:
    """The counting rule over one box relation, as a CTE."""
    return f""",
{name}_e AS (SELECT clip_id, track_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame,
    count(*) AS observations,
    arg_min(x_min/640 + ((x_max-x_min)/640)/2.0::DOUBLE, frame_index) AS start_u,
    arg_min(y_min/480 + ((y_max-y_min)/480)/2.0::DOUBLE, frame_index) AS start_v,
    arg_max(x_min/640 + ((x_max-x_min)/640)/2.0::DOUBLE, frame_index) AS end_u,
    arg_max(y_min/480 + ((y_max-y_min)/480)/2.0::DOUBLE, frame_index) AS end_v
  FROM {source} GROUP BY 1, 2),
{name}_d AS (SELECT *, sqrt((end_u-start_u)*(end_u-start_u)+(end_v-start_v)*(end_v-start_v)) AS displacement FROM {name}_e),
{name} AS (SELECT *,
  CASE WHEN displacement < 0.05 THEN 'stationary'
       WHEN (start_u < 0.5 AND end_u >= 0.5) OR (end_u < 0.5 AND start_u >= 0.5) THEN 'passage'
       ELSE 'no_crossing' END AS outcome,
  CASE WHEN displacement < 0.05 THEN NULL WHEN start_u < 0.5 AND end_u >= 0.5 THEN 'right'
       WHEN end_u < 0.5 AND start_u >= 0.5 THEN 'left' END AS direction FROM {name}_d)"""


def hash32(*parts: str) -> str:
    return "('0x'||substr(md5(concat_ws(':', " + ", ".join(parts) + ")),1,8))::BIGINT"

COUNTS = """
cc0 AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS nation, (['kenai-train','kenai-val','kenai-rightbank','kenai-channel','elwha','nushagak'])[c_nationkey%6+1] AS location,
  (['LeftFar','LeftNear','RightFar','RightNear'])[c_custkey%4+1] AS camera, 150+(c_custkey*31)%400 AS num_frames, 10.0::DOUBLE AS framerate,
  c_custkey%4 AS ref_right, (c_custkey//4)%3 AS ref_left FROM customer),
cc AS (SELECT *, format('{}_{}_Stratum{}_2018-06-{:02d}_120000_{}_{}', location, camera, k%2+1, k%28+1, k*1000, k*1000+num_frames) AS clip_name,
  format('s{:07d}', k) AS code,
  greatest(ref_right + CASE (k*7)%5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END, 0) AS a_right,
  greatest(ref_left + CASE WHEN k%7=0 THEN -1 WHEN k%13=0 THEN 2 ELSE 0 END, 0) AS a_left,
  ref_right + CASE WHEN k%9=0 THEN 1 ELSE 0 END AS b_right,
  greatest(ref_left - CASE WHEN k%8=0 THEN 1 ELSE 0 END, 0) AS b_left FROM cc0),
ce AS (SELECT *, ref_right+ref_left AS passages, abs(a_right-ref_right)+abs(a_left-ref_left) AS err_a,
  abs(b_right-ref_right)+abs(b_left-ref_left) AS err_b FROM cc)"""

TRIALS = COUNTS + """,
tr AS (SELECT CASE WHEN nation=0 THEN 'D1' ELSE 'P'||nation END AS participant, k%2+1 AS block,
  CASE WHEN k%2=0 THEN 'manual' ELSE 'assisted' END AS condition, code AS clip, k%10=9 AS practice, 15000+(k*7919)%60000 AS active_ms,
  b_right AS final_right, b_left AS final_left, k, ref_right, ref_left, a_right, a_left FROM cc),
st AS (SELECT *, active_ms/1000.0::DOUBLE AS active_s, abs(final_right-ref_right)+abs(final_left-ref_left) AS error, ref_right+ref_left AS passages,
  abs(a_right-ref_right)+abs(a_left-ref_left) AS auto_error,
  greatest(abs(a_right-ref_right)-abs(final_right-ref_right),0)+greatest(abs(a_left-ref_left)-abs(final_left-ref_left),0) AS fixed,
  greatest(abs(final_right-ref_right)-abs(a_right-ref_right),0)+greatest(abs(final_left-ref_left)-abs(a_left-ref_left),0) AS introduced
  FROM tr WHERE NOT practice AND k%23<>0)"""

REVIEWS = """
rjobs AS (SELECT DISTINCT user_id//2 AS job_id, 300 AS num_frames, 4 AS audit_windows, 100+(user_id//2)%7 AS unflagged_frames FROM events WHERE (user_id//2)%31<>30),
jt AS (SELECT job_id, track_id, CASE (track_id+job_id)%3 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END AS direction, (track_id*37+job_id*11)%200 AS start_frame,
  (track_id*37+job_id*11)%200+20+track_id%30 AS end_frame FROM (SELECT user_id//2 AS job_id, unnest([(user_id%2)*10+i FOR i IN range(10)]) AS track_id FROM (SELECT DISTINCT user_id FROM events))),
re0 AS (SELECT event_id, ts, user_id//2 AS job_id, event_type, event_id%5<>0 AND event_id%7<>0 AS fine, event_id%7=0 AS stale FROM events),
re1 AS (SELECT *, coalesce(sum(fine::INT) OVER w,0) AS before, max(CASE WHEN fine AND event_type='purchase' THEN event_id END) OVER w AS la FROM re0
  WINDOW w AS (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
re AS (SELECT job_id, event_id, ts, before-stale::INT AS base_revision,
  CASE WHEN NOT fine AND event_id%4=2 THEN 'add_passage' WHEN NOT fine THEN 'accept' WHEN event_type='click' THEN 'accept' WHEN event_type='view' THEN 'reject'
   WHEN event_type='error' THEN 'set_direction' WHEN event_type='purchase' THEN 'add_passage' WHEN event_id%2=0 AND la IS NOT NULL THEN 'reject'
   WHEN event_id%3=0 THEN 'mark_audited' ELSE 'mark_unresolved' END AS action,
  CASE WHEN NOT fine THEN CASE event_id%4 WHEN 0 THEN 999 WHEN 3 THEN event_id%20 END WHEN event_type IN ('click','view','error') THEN event_id%20
   WHEN event_type='signup' AND NOT (event_id%2=0 AND la IS NOT NULL) AND event_id%3<>0 THEN event_id%20 END AS track_id,
  CASE WHEN NOT fine AND event_id%4=1 THEN 'p999999999' WHEN fine AND event_type='signup' AND event_id%2=0 AND la IS NOT NULL THEN 'p'||la END AS passage_id,
  CASE WHEN NOT fine AND event_id%4=2 THEN 'right' WHEN fine AND event_type='error' THEN CASE event_id%3 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END
   WHEN fine AND event_type='purchase' THEN CASE WHEN event_id%2=0 THEN 'right' ELSE 'left' END END AS direction,
  CASE WHEN NOT fine AND event_id%4=2 THEN 500 WHEN fine AND event_type='purchase' THEN event_id%300 END AS frame_index,
  CASE WHEN NOT fine AND event_id%4=3 THEN 1 WHEN fine AND event_type='purchase' AND event_id%2=0 THEN event_id%4
   WHEN fine AND event_type='signup' AND NOT (event_id%2=0 AND la IS NOT NULL) AND event_id%3=0 THEN event_id%4 END AS audit_window FROM re1)"""

# The log walked event by event: revision and added passages carried from row to row.
FOLD = REVIEWS + """,
ro0 AS (SELECT re.*, jt.track_id IS NOT NULL AS known, row_number() OVER (PARTITION BY re.job_id ORDER BY event_id) AS i FROM re LEFT JOIN jt ON jt.job_id=re.job_id AND jt.track_id=re.track_id),
ro1 AS (SELECT *, CASE WHEN audit_window IS NOT NULL AND action NOT IN ('add_passage','mark_audited') THEN 'audit_window goes with add_passage or mark_audited'
   WHEN audit_window IS NOT NULL AND NOT (audit_window>=0 AND audit_window<4) THEN 'audit_window out of range' WHEN action='mark_audited' AND audit_window IS NULL THEN 'mark_audited needs an audit_window'
   WHEN action='add_passage' AND (direction IS NULL OR frame_index IS NULL) THEN 'add_passage needs a direction and a frame_index'
   WHEN action='add_passage' AND NOT (frame_index>=0 AND frame_index<300) THEN 'frame_index out of range'
   WHEN action IN ('add_passage','mark_audited') OR passage_id IS NOT NULL THEN NULL WHEN NOT known THEN 'unknown track' END AS err FROM ro0),
fd AS (SELECT job_id, 0::BIGINT AS i, 0::BIGINT AS rev, []::VARCHAR[] AS ps, NULL::BIGINT AS event_id, NULL::VARCHAR AS refusal FROM rjobs
  UNION ALL SELECT n.job_id, n.i, CASE WHEN r IS NULL THEN n.rev+1 ELSE n.rev END, CASE WHEN r IS NULL AND action='add_passage' THEN list_append(ps, 'p'||n.event_id) ELSE ps END, n.event_id, r
  FROM (SELECT o.job_id, o.i, o.event_id, o.action, fd.rev, fd.ps, CASE WHEN o.base_revision<>fd.rev THEN 'stale revision' WHEN o.err IS NOT NULL THEN o.err
     WHEN o.action NOT IN ('add_passage','mark_audited') AND o.passage_id IS NOT NULL AND NOT list_contains(fd.ps, o.passage_id) THEN 'unknown added passage'
     WHEN o.action NOT IN ('add_passage','mark_audited') AND o.passage_id IS NOT NULL AND o.action<>'reject' THEN 'added passages can only be rejected' END AS r
    FROM fd JOIN ro1 o ON o.job_id=fd.job_id AND o.i=fd.i+1) n),
ver AS (SELECT job_id, event_id, refusal IS NULL AS accepted, CASE WHEN refusal IS NULL THEN rev END AS resulting_revision, refusal FROM fd WHERE i>0
  UNION ALL SELECT job_id, event_id, false, NULL, 'job has no result to review' FROM ro0 WHERE job_id%31=30),
acc AS (SELECT re.*, resulting_revision FROM re JOIN ver USING (job_id, event_id) WHERE accepted),
dec AS (SELECT job_id, track_id, arg_max(action, event_id) AS act, max(event_id) AS event_id FROM acc WHERE passage_id IS NULL AND action IN ('accept','reject','set_direction','mark_unresolved') GROUP BY 1,2),
td AS (SELECT d.job_id, d.track_id, CASE act WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'set_direction' THEN 'corrected' ELSE 'unresolved' END AS state,
  CASE act WHEN 'accept' THEN jt.direction WHEN 'set_direction' THEN acc.direction END AS direction, d.event_id FROM dec d JOIN jt USING (job_id, track_id) JOIN acc ON acc.job_id=d.job_id AND acc.event_id=d.event_id),
ps AS (SELECT a.job_id, 'p'||a.event_id AS passage_id, a.direction, a.frame_index, a.audit_window,
  CASE WHEN EXISTS (SELECT 1 FROM acc r WHERE r.job_id=a.job_id AND r.passage_id='p'||a.event_id AND r.action='reject') THEN 'rejected' ELSE 'added' END AS state FROM acc a WHERE a.action='add_passage'),
oc AS (SELECT jt.job_id, jt.track_id, jt.direction, start_frame, end_frame, coalesce(state,'automatic') AS review_state,
  CASE WHEN state IS NULL THEN jt.direction ELSE td.direction END AS final_direction FROM jt LEFT JOIN td USING (job_id, track_id))"""

DATASET = """
db AS (SELECT l_suppkey AS clip_id, l_orderkey%40 AS track_id, l_partkey%120 AS frame_index, (trunc(l_extendedprice)::BIGINT%700-30)::DOUBLE AS x_min,
  (l_orderkey%500-10)::DOUBLE AS y_min, (trunc(l_extendedprice)::BIGINT%700-30)::DOUBLE+l_quantity-2 AS x_max, (l_orderkey%500-10)::DOUBLE+l_linenumber*5 AS y_max FROM lineitem),
dc AS (SELECT s_suppkey AS clip_id, s_name AS clip_name, 'loc'||(s_nationkey%5) AS location, 100 AS num_frames FROM supplier)"""

JOBS = """
jb0 AS (SELECT o_orderkey AS job_id, o_custkey AS clip_id, o_orderpriority AS pipeline_version, o_orderdate + to_seconds(o_orderkey%86400) AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey%3=0 THEN 'failed' ELSE 'running' END END AS status,
  (o_custkey%300)||':'||o_orderpriority AS cache_key, 'k'||(o_custkey%700) AS idempotency_key, o_orderkey%4 AS attempts, 3 AS max_attempts,
  3600+(o_orderkey%50)*3600 AS deadline_seconds, CASE WHEN o_orderkey%6=0 THEN o_orderkey-1 END AS cached_from, 5+(o_orderkey*37)%3000 AS seconds, o_totalprice FROM orders),
jb AS (SELECT *, created_at + to_minutes(1) AS started_at, created_at + to_hours(2) AS lease_expires_at, created_at + to_seconds(seconds) AS finished_at FROM jb0)"""

MANIFEST = COUNTS + """,
mf0 AS (SELECT location, clip_name, k, num_frames, CASE WHEN location='kenai-train' THEN 'train' WHEN location='kenai-val' THEN 'val' ELSE 'test' END AS official_split,
  CASE WHEN k%11=0 THEN 'quarantined' WHEN k%7=0 THEN 'warning' ELSE 'ok' END AS status, k%13<>0 AS frames_validated, 0 AS frame_start, num_frames AS frame_stop, k%50 AS boxes,
  location='kenai-train' AND k%5=0 AS held FROM cc),
mf AS (SELECT location, clip_name, official_split, CASE WHEN held THEN 'holdout' ELSE official_split END AS partition, official_split<>'test' AND NOT held AS tuning_allowed,
  status, status<>'quarantined' AS usable, frames_validated, num_frames, frame_start, frame_stop, boxes FROM mf0)"""

CELLS = """
em AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS frame_index, embedding FROM embeddings),
cells AS (SELECT clip_id, frame_index, i//8 AS y, i%8 AS x, greatest(least(128+floor(embedding[i+1]::DOUBLE*500),255),0)::INT AS value FROM em, range(64) z(i))"""


def tree(leaves: str, keys: str, out: str) -> str:
    """CTEs ending in ``out`` (keys, digest): the tree of hashes over relation ``leaves`` (keys, pos, digest)."""
    node = "sha256(string_agg(c.pos||'='||digest, ',' ORDER BY c.pos)) AS digest"
    parts, below = [], leaves
    for i in range(3):
        parts.append(f"{out}{i} AS (SELECT {keys}, up AS pos, {node} FROM (SELECT *, pos>>10 AS up FROM {below}) c GROUP BY {keys}, up)")
        below = f"{out}{i}"
    return ", ".join([*parts, f"{out} AS (SELECT {keys}, {node} FROM {below} c GROUP BY {keys})"])
