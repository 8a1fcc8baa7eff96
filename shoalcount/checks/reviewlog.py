"""Review log queries: acceptance, decisions, counts, reports, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.functions import labels as fl
from shoalcount.operators import counting as ct
from shoalcount.operators import intervals as iv
from shoalcount.operators import reviews as rv
from shoalcount.session import materialize, scratch_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FOLD = "WITH RECURSIVE " + q.FOLD


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def verdicts(s, d):
    return rv.fold_reviews(ad.review_events(s, d), ad.job_tracks(s, d), ad.review_jobs(s, d))


def accepted(s, d):
    """The accepted events, stored once: every later table reads them."""
    return materialize(rv.accepted_events(ad.review_events(s, d), verdicts(s, d)))


def state(s, d):
    acc, tracks = accepted(s, d), ad.job_tracks(s, d)
    return acc, rv.track_outcomes(tracks, rv.track_decisions(acc, tracks)), rv.passages(acc)


@query(FOLD + " SELECT * FROM ver")
def review_acceptance(s, d):
    return verdicts(s, d)


@query(FOLD + " SELECT job_id, coalesce(refusal,'accepted') AS reason, count(*) AS n FROM ver GROUP BY 1,2")
def refused_reviews(s, d):
    v = verdicts(s, d).withColumn("reason", F.coalesce("refusal", F.lit("accepted")))
    return v.groupBy("job_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(FOLD + " SELECT * FROM td")
def latest_decisions(s, d):
    return rv.track_decisions(accepted(s, d), ad.job_tracks(s, d))


@query(FOLD + " SELECT job_id, passage_id, direction, frame_index, audit_window, state FROM ps")
def added_passages(s, d):
    return rv.passages(accepted(s, d)).select("job_id", "passage_id", "direction", "frame_index", "audit_window", "state")


@query(FOLD + " SELECT job_id, track_id, review_state, final_direction FROM oc")
def track_outcomes(s, d):
    return state(s, d)[1].select("job_id", "track_id", "review_state", "final_direction")


COUNTS = FOLD + """, tc AS (SELECT job_id, count(*) FILTER (review_state<>'unresolved' AND final_direction='right') AS r, count(*) FILTER (review_state<>'unresolved' AND final_direction='left') AS l,
  count(*) AS tracks, count(*) FILTER (review_state<>'automatic') AS reviewed_tracks, count(*) FILTER (review_state='unresolved') AS unresolved FROM oc GROUP BY 1),
 pc AS (SELECT job_id, count(*) FILTER (direction='right') AS pr, count(*) FILTER (direction='left') AS pl, count(*) AS n FROM ps WHERE state='added' GROUP BY 1),
 rc AS (SELECT job_id, r+coalesce(pr,0) AS "right", l+coalesce(pl,0) AS "left", tracks, reviewed_tracks, unresolved, coalesce(n,0) AS added_passages FROM tc LEFT JOIN pc USING (job_id))"""


@query(COUNTS + " SELECT * FROM rc")
def reviewed_counts(s, d):
    _, outcomes, added = state(s, d)
    return rv.reviewed_counts(outcomes, added)


@query(FOLD.replace("acc AS (SELECT re.*, resulting_revision FROM re JOIN ver USING (job_id, event_id) WHERE accepted)",
  "acc AS (SELECT re.*, resulting_revision FROM re JOIN ver USING (job_id, event_id) WHERE accepted AND resulting_revision<=25)") + " SELECT job_id, track_id, review_state, final_direction FROM oc")
def outcomes_at_revision(s, d):
    acc, tracks = rv.as_of(accepted(s, d), F.lit(25)), ad.job_tracks(s, d)
    return rv.track_outcomes(tracks, rv.track_decisions(acc, tracks)).select("job_id", "track_id", "review_state", "final_direction")


@query(FOLD + """, r AS (SELECT job_id, event_id, resulting_revision AS revision FROM acc) SELECT job_id, max(revision) AS revision, arg_max(event_id, revision) AS event_id
  FROM r WHERE revision<=40 GROUP BY 1""")
def latest_revision(s, d):
    r = accepted(s, d).select("job_id", "event_id", F.col("resulting_revision").alias("revision"))
    return rv.latest_revision(r, ["event_id"], at=40)


WIN = """, wn AS (SELECT job_id, unnest(range(4)) AS audit_window FROM rjobs),
 av AS (SELECT w.job_id, w.audit_window, w.audit_window*60 AS start_frame, w.audit_window*60+15 AS stop_frame,
  CASE WHEN EXISTS (SELECT 1 FROM acc a WHERE a.job_id=w.job_id AND a.action='mark_audited' AND a.audit_window=w.audit_window) THEN 'checked' ELSE 'pending' END AS state,
  (SELECT count(*) FROM ps WHERE ps.job_id=w.job_id AND ps.audit_window=w.audit_window AND ps.state='added') AS passages_added FROM wn w)"""


def audit_view_of(s, d):
    acc, _, added = state(s, d)
    windows = ad.review_jobs(s, d).selectExpr("job_id", "explode(sequence(0, audit_windows - 1)) as audit_window").selectExpr(
        "job_id", "audit_window", "audit_window * 60 as start_frame", "audit_window * 60 + 15 as stop_frame"
    )
    return rv.audit_windows_view(windows, rv.audits(acc), added)


@query(FOLD + WIN + " SELECT * FROM av")
def audit_view(s, d):
    return audit_view_of(s, d)


@query(FOLD + WIN + """ SELECT av.job_id, count(*) FILTER (state='checked') AS windows_checked, coalesce(sum(stop_frame-start_frame) FILTER (state='checked'),0) AS checked_frames,
  sum(passages_added) AS passages_added_in_audits, any_value(unflagged_frames) AS unflagged_frames,
  round(coalesce(sum(stop_frame-start_frame) FILTER (state='checked'),0)::DOUBLE/any_value(unflagged_frames),9) AS checked_fraction_of_unflagged FROM av JOIN rjobs USING (job_id) GROUP BY 1""")
def audit_totals(s, d):
    return rv.audit_totals(audit_view_of(s, d), ad.review_jobs(s, d).select("job_id", "unflagged_frames"))


REPLAY = FOLD + """, aq AS (SELECT a.job_id, a.event_id, a.base_revision, a.track_id, a.direction, jt.start_frame, jt.end_frame FROM acc a JOIN jt ON jt.job_id=a.job_id AND jt.track_id=a.track_id AND jt.direction IS NULL WHERE a.action='set_direction' AND a.passage_id IS NULL),
 nr AS (SELECT aq.job_id, aq.event_id, o.track_id AS other, o.direction AS auto, aq.base_revision FROM aq JOIN jt o ON o.job_id=aq.job_id AND o.track_id<>aq.track_id AND o.start_frame<=aq.end_frame+10 AND aq.start_frame<=o.end_frame+10),
 ld AS (SELECT nr.job_id, nr.event_id, nr.other, nr.auto, arg_max(a.action, a.event_id) AS act, arg_max(coalesce(a.direction,'-'), a.event_id) AS dir FROM nr LEFT JOIN acc a ON a.job_id=nr.job_id AND a.track_id=nr.other
   AND a.passage_id IS NULL AND a.action IN ('accept','reject','set_direction','mark_unresolved') AND a.resulting_revision<=nr.base_revision GROUP BY 1,2,3,4),
 cn AS (SELECT job_id, event_id, count(*) FILTER (CASE WHEN act IS NULL OR act='accept' THEN auto IS NOT NULL WHEN act='set_direction' THEN dir<>'-' ELSE false END) AS counted_nearby FROM ld GROUP BY 1,2),
 rpl AS (SELECT aq.job_id, aq.event_id, base_revision, track_id, direction, coalesce(counted_nearby,0) AS counted_nearby FROM aq LEFT JOIN cn USING (job_id, event_id))"""


@query(REPLAY + " SELECT * FROM rpl")
def replayed_count_decisions(s, d):
    return rv.replay(accepted(s, d), ad.job_tracks(s, d))


@query(REPLAY + """, u AS (SELECT a.job_id, EXISTS (SELECT 1 FROM jt b WHERE b.job_id=a.job_id AND b.direction IS NOT NULL AND b.start_frame<=a.end_frame+10 AND a.start_frame<=b.end_frame+10) AS near FROM jt a WHERE direction IS NULL),
 qr AS (SELECT job_id, count(*) AS uncounted_tracks, count(*) FILTER (near) AS with_question FROM u GROUP BY 1),
 pj AS (SELECT job_id, count(*) AS count_decisions, count(*) FILTER (counted_nearby>0) AS asked FROM rpl GROUP BY 1)
 SELECT 'g'||(job_id%3) AS "group", sum(coalesce(count_decisions,0)) AS count_decisions, sum(coalesce(asked,0)) AS asked, sum(coalesce(uncounted_tracks,0)) AS uncounted_tracks,
  sum(coalesce(with_question,0)) AS with_question FROM rjobs LEFT JOIN pj USING (job_id) LEFT JOIN qr USING (job_id) GROUP BY ROLLUP('g'||(job_id%3))""")
def replay_coverage(s, d):
    tracks = ad.job_tracks(s, d)
    near = iv.has_nearby(tracks.where("direction is null"), tracks.where("direction is not null"), 10, ["job_id"])
    rate = near.groupBy("job_id").agg(F.count(F.lit(1)).alias("uncounted_tracks"), F.count(F.when(F.col("nearby"), 1)).alias("with_question"))
    groups = ad.review_jobs(s, d).select("job_id", F.concat(F.lit("g"), (F.col("job_id") % 3).cast("string")).alias("group"))
    return rv.replay_coverage(rv.replay(accepted(s, d), tracks), rate, groups)


def upstream():
    return F.when(F.col("job_id") % 2 == 0, "right").when(F.col("job_id") % 3 == 0, "left")


UP = "CASE WHEN job_id%2=0 THEN 'right' WHEN job_id%3=0 THEN 'left' END"


def RIV(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {UP} IS NULL THEN NULL WHEN {c}={UP} THEN 'upstream' ELSE 'downstream' END"


@query(FOLD + f""" SELECT job_id, 'track' AS kind, track_id::VARCHAR AS id, start_frame, end_frame, start_frame/10.0::DOUBLE AS start_time_s, end_frame/10.0::DOUBLE AS end_time_s,
  direction AS automatic_direction, review_state, final_direction, {RIV('final_direction')} AS final_river_direction FROM oc
  UNION ALL SELECT job_id, 'added_passage', passage_id, frame_index, frame_index, frame_index/10.0::DOUBLE, frame_index/10.0::DOUBLE, NULL, state, d, {RIV('d')}
  FROM (SELECT *, CASE WHEN state='added' THEN direction END AS d FROM ps)""")
def flat_report(s, d):
    _, outcomes, added = state(s, d)
    return rv.report_rows(outcomes, added, 10.0, upstream())


@query(COUNTS + f""", au AS (SELECT job_id, count(*) FILTER (direction='right') AS ar, count(*) FILTER (direction='left') AS al FROM jt GROUP BY 1),
  x AS (SELECT *, {UP} AS up FROM rc JOIN au USING (job_id))
  SELECT job_id, unnest(['automatic_right','automatic_left','automatic_upstream','automatic_downstream','automatic_net_upstream','reviewed_right','reviewed_left','reviewed_upstream','reviewed_downstream','reviewed_net_upstream','reviewed_unresolved']) AS key,
  unnest([ar::VARCHAR, al::VARCHAR, coalesce((CASE up WHEN 'right' THEN ar WHEN 'left' THEN al END)::VARCHAR,''), coalesce((CASE up WHEN 'right' THEN al WHEN 'left' THEN ar END)::VARCHAR,''),
   coalesce((CASE up WHEN 'right' THEN ar-al WHEN 'left' THEN al-ar END)::VARCHAR,''), "right"::VARCHAR, "left"::VARCHAR, coalesce((CASE up WHEN 'right' THEN "right" WHEN 'left' THEN "left" END)::VARCHAR,''),
   coalesce((CASE up WHEN 'right' THEN "left" WHEN 'left' THEN "right" END)::VARCHAR,''), coalesce((CASE up WHEN 'right' THEN "right"-"left" WHEN 'left' THEN "left"-"right" END)::VARCHAR,''), unresolved::VARCHAR]) AS value FROM x""")
def report_header(s, d):
    _, outcomes, added = state(s, d)
    return rv.report_header(rv.reviewed_counts(outcomes, added), ct.tally(ad.job_tracks(s, d), ["job_id"]), upstream())


REPORT_AT = 25


def report_headers(s, d):
    j = ad.review_jobs(s, d)
    return j.select(
        "job_id", upstream().alias("upstream"), F.struct(F.col("job_id").alias("clip_id"), "num_frames", F.lit(10.0).alias("framerate")).alias("recording"),
        F.struct(upstream().alias("upstream_direction")).alias("counting"), F.struct(F.concat(F.lit("v"), (F.col("job_id") % 3).cast("string")).alias("pipeline_version")).alias("pipeline"),
        F.struct("job_id").alias("job"),
    )


def sections_at(s, d, revision):
    acc, tracks = materialize(rv.as_of(accepted(s, d), F.lit(revision))), ad.job_tracks(s, d)
    outcomes, added = materialize(rv.track_outcomes(tracks, rv.track_decisions(acc, tracks))), materialize(rv.passages(acc))
    windows = ad.review_jobs(s, d).selectExpr("job_id", "explode(sequence(0, audit_windows - 1)) as audit_window").selectExpr(
        "job_id", "audit_window", "audit_window * 60 as start_frame", "audit_window * 60 + 15 as stop_frame"
    )
    audit = materialize(rv.audit_windows_view(windows, rv.audits(acc), added))
    totals = rv.audit_totals(audit, ad.review_jobs(s, d).select("job_id", "unflagged_frames"))
    return rv.report_sections(report_headers(s, d), ct.tally(tracks, ["job_id"]), outcomes, added, audit, totals, acc)


def J(**fields):
    """A JSON object in SQL from texts, numbers and nulls as Spark writes them."""
    def part(k, c):
        kind, col = c
        value = f"'\"'||{col}||'\"'" if kind == "s" else f"({col})::VARCHAR"
        return f"'\"{k}\":'||coalesce({value}, 'null')"
    return "'{'||" + "||','||".join(part(k, c) for k, c in fields.items()) + "||'}'"


_TRACK = J(track_id=("n", "track_id"), start_frame=("n", "start_frame"), end_frame=("n", "end_frame"), start_time_s=("n", "start_frame/10.0::DOUBLE"), end_time_s=("n", "end_frame/10.0::DOUBLE"),
  automatic_direction=("s", "direction"), review_state=("s", "review_state"), final_direction=("s", "final_direction"), final_river_direction=("s", RIV("final_direction")))
_SIDES = lambda r, l: dict(right=("n", r), left=("n", l), upstream=("n", f"CASE up WHEN 'right' THEN {r} WHEN 'left' THEN {l} END"),  # noqa: E731, E741
  downstream=("n", f"CASE up WHEN 'right' THEN {l} WHEN 'left' THEN {r} END"), net_upstream=("n", f"CASE up WHEN 'right' THEN {r}-{l} WHEN 'left' THEN {l}-{r} END"))
_REST = dict(tracks=("n", "tracks"), reviewed_tracks=("n", "reviewed_tracks"), unresolved=("n", "unresolved"), added_passages=("n", "added_passages"))
_EVENT = "'{'||concat_ws(',', '\"event_id\":'||event_id, '\"base_revision\":'||base_revision, '\"resulting_revision\":'||resulting_revision, '\"action\":\"'||action||'\"', '\"track_id\":'||track_id, '\"passage_id\":\"'||passage_id||'\"', '\"direction\":\"'||direction||'\"', '\"frame_index\":'||frame_index, '\"audit_window\":'||audit_window)||'}'"


@query(COUNTS.replace("WHERE accepted)", f"WHERE accepted AND resulting_revision<={REPORT_AT})") + WIN + f""",
  au AS (SELECT job_id, count(*) FILTER (direction='right') AS ar, count(*) FILTER (direction='left') AS al FROM jt GROUP BY 1),
  lt AS (SELECT job_id, coalesce(max(resulting_revision), 0) AS r FROM rjobs LEFT JOIN acc USING (job_id) GROUP BY 1),
  vw AS (SELECT *, {UP} AS up FROM rjobs JOIN lt USING (job_id) JOIN rc USING (job_id) JOIN au USING (job_id)),
  jo AS (SELECT oc.* FROM oc JOIN rjobs USING (job_id)),
  at0 AS (SELECT job_id, count(*) FILTER (state='checked') AS wc, coalesce(sum(stop_frame-start_frame) FILTER (state='checked'),0) AS cf, sum(passages_added) AS pa, any_value(unflagged_frames) AS uf FROM av JOIN rjobs USING (job_id) GROUP BY 1)
  SELECT job_id, 'recording' AS section, 0 AS place, '' AS label, {J(clip_id=('n', 'job_id'), num_frames=('n', '300'), framerate=('n', "'10.0'"))} AS body FROM rjobs
  UNION ALL SELECT job_id, 'counting', 0, '', {J(upstream_direction=('s', UP))} FROM rjobs
  UNION ALL SELECT job_id, 'pipeline', 0, '', {J(pipeline_version=('s', "'v'||(job_id%3)"))} FROM rjobs
  UNION ALL SELECT job_id, 'job', 0, '', {J(job_id=('n', 'job_id'))} FROM rjobs
  UNION ALL SELECT job_id, 'revision', 0, '', r::VARCHAR FROM lt
  UNION ALL SELECT job_id, 'revision_kind', 0, '', CASE WHEN r=0 THEN '"automatic"' ELSE '"reviewed"' END FROM lt
  UNION ALL SELECT job_id, 'counts', 0, '', '{{"automatic":'||{J(**_SIDES('ar', 'al'))}||',"reviewed":'||CASE WHEN r=0 THEN 'null' ELSE {J(**_SIDES('"right"', '"left"'), **_REST)} END||'}}' FROM vw
  UNION ALL SELECT job_id, 'unresolved', track_id, '', {_TRACK} FROM jo WHERE review_state='unresolved'
  UNION ALL SELECT job_id, 'tracks', track_id, '', {_TRACK} FROM jo
  UNION ALL SELECT job_id, 'added_passages', 0, passage_id, {J(passage_id=('s', 'passage_id'), state=('s', 'state'), direction=('s', 'direction'), river_direction=('s', RIV('direction')), frame_index=('n', 'frame_index'), time_s=('n', 'frame_index/10.0::DOUBLE'))} FROM ps JOIN rjobs USING (job_id)
  UNION ALL SELECT job_id, 'audit', 0, '', {J(windows_checked=('n', 'wc'), checked_frames=('n', 'cf'), passages_added_in_audits=('n', 'pa'), unflagged_frames=('n', 'uf'), checked_fraction_of_unflagged=('n', 'round(cf::DOUBLE/uf,9)'))} FROM at0
  UNION ALL SELECT job_id, 'audit_windows', audit_window, '', {J(audit_window=('n', 'audit_window'), start_frame=('n', 'start_frame'), stop_frame=('n', 'stop_frame'), state=('s', 'state'), passages_added=('n', 'passages_added'))} FROM av
  UNION ALL SELECT job_id, 'review_events', event_id, '', {_EVENT} FROM acc JOIN rjobs USING (job_id)""")
def job_reports(s, d):
    """Reports at a revision, written in order and read back: every part and entry with its content."""
    path = scratch_dir(s, "reports")
    rv.write_reports(rv.report_text(sections_at(s, d, REPORT_AT)), path)
    back = s.read.schema("job_id bigint, section int, place bigint, label string, text string").json(path)
    names = F.array(*[F.lit(n) for n in rv.SECTIONS])
    kept = back.where((F.col("section") >= 0) & (F.col("section") < len(rv.SECTIONS)) & (F.abs(F.col("place").cast("decimal(20,0)")) < 2**62))
    title = F.element_at(names, F.col("section") + 1)
    named = F.concat(F.lit(',"'), title, F.lit('":'))
    body = F.when(F.startswith("text", named), F.substr("text", F.length(named) + 1)).otherwise(F.ltrim("text", F.lit(",")))
    return kept.select("job_id", title.alias("section"), "place", "label", body.alias("body"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_type='error' THEN 'mark_unresolved' ELSE 'accept' END AS action FROM events""")
def parsed_payloads(s, d):
    text = F.concat(
        F.lit('{"action":"'), F.when(F.col("event_type") == "error", "mark_unresolved").otherwise("accept"), F.lit('","track_id":'),
        F.get_json_object("props", "$.k"), F.lit("}"),
    )
    p = ad.table(s, d, "events").select("event_id", rv.parse_payload(text).alias("p"))
    return p.select("event_id", F.col("p.track_id").alias("k"), "p.action")


@query(FOLD + """ SELECT job_id, track_id, CASE review_state WHEN 'automatic' THEN 'not reviewed' ELSE review_state END AS state_label,
  CASE WHEN final_direction IS NULL THEN 'no passage' WHEN final_direction='right' THEN '→ ' ELSE '← ' END ||
  CASE WHEN final_direction IS NULL THEN '' WHEN """ + UP + " IS NULL THEN final_direction WHEN final_direction=" + UP + """ THEN 'upstream' ELSE 'downstream' END AS direction_label,
  format('{}:{:04.1f}', start_frame//600, (start_frame/10.0::DOUBLE)-(start_frame//600)*60) AS start_time FROM oc""")
def track_labels(s, d):
    outcomes = state(s, d)[1]
    return outcomes.select(
        "job_id", "track_id", fl.state_label(F.col("review_state")).alias("state_label"),
        fl.direction_label(F.col("final_direction"), upstream()).alias("direction_label"), fl.format_time(F.col("start_frame") / 10.0).alias("start_time"),
    )
