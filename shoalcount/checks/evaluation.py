"""Evaluation statistics, reviewer agreement, usability and study design queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.checks import counting as cc
from shoalcount.functions import names as nm
from shoalcount.operators import boxes as bx
from shoalcount.operators import counting as ct
from shoalcount.operators import design as ds
from shoalcount.operators import intervals as iv
from shoalcount.operators import labels as lb
from shoalcount.operators import stats as st
from shoalcount.operators import usability as us
from shoalcount.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
B = 10_000  # resamples, as in published intervals


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def system(s, d, p):
    return ad.clip_counts(s, d).select(
        "clip_name", "location", "ref_right", "ref_left", F.col(f"{p}_right").alias("pred_right"), F.col(f"{p}_left").alias("pred_left")
    )


def H(*parts):
    return q.hash32(*parts)


def M(x: str) -> str:
    """The integer mixer in SQL."""
    for _ in range(2):
        x = f"(xor({x}, ({x})>>16)*73244475&4294967295)"
    return f"xor({x}, {x}>>16)"


def RS(rel: str, keys: list[str], item: str, values: list[str], salt: list[str], seed: int = 0) -> str:
    """CTEs ix (indexed), ks (keys of draws) and rs (resampled sums) over relation ``rel``."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    on = " AND ".join(f"x.{c}=p.{c}" for c in keys) or "true"
    pk = "".join(f"p.{c}, " for c in keys)
    return f""",
ix0 AS (SELECT *, row_number() OVER ({part}ORDER BY {H(item)}, {item})-1 AS j, count(*) OVER ({part}) AS nn, {H(f"'{seed}'", *salt)} AS gs FROM {rel}),
ix AS (SELECT *, {M('j')} AS mj FROM ix0),
ks AS (SELECT {k} b, {M('s')} AS kk FROM (SELECT {k} b, {M('(gs+b)&4294967295')} AS s FROM (SELECT DISTINCT {k} gs FROM ix), range({B}) z(b))),
pk AS (SELECT {pk} x.b, {M('xor(kk, mj)')}%nn AS pj FROM ix p JOIN ks x ON {on}),
rs AS (SELECT {pk} p.b, {', '.join(f'sum({v}) AS {v}' for v in values)}, count(*) AS drawn FROM pk p JOIN ix x ON {on} AND x.j=p.pj GROUP BY ALL)"""


def IV(col: str, name: str) -> str:
    return f"round(quantile_cont({col}, 0.025::DOUBLE),9) AS {name}_low, round(quantile_cont({col}, 0.975::DOUBLE),9) AS {name}_high"


# --- bootstrap -----------------------------------------------------------------------------


@query("WITH " + q.COUNTS + RS("ce", [], "clip_name", ["passages", "err_a", "err_b"], []) + f""",
  n AS (SELECT err_a::DOUBLE/nullif(passages,0) AS a, err_b::DOUBLE/nullif(passages,0) AS bb FROM rs)
  SELECT (SELECT round(sum(err_a)::DOUBLE/sum(passages),9) FROM ce) AS a_estimate, (SELECT round(sum(err_b)::DOUBLE/sum(passages),9) FROM ce) AS b_estimate,
  (SELECT round((sum(err_b)-sum(err_a))::DOUBLE/sum(passages),9) FROM ce) AS difference_estimate, (SELECT count(*) FROM ce) AS clips,
  {IV('a', 'a')}, {IV('bb', 'b')}, {IV('bb-a', 'difference')}, round(avg((bb-a<0)::INT::DOUBLE),9) AS probability_b_better,
  count(a) AS resamples, count(*)-count(a) AS skipped FROM n""")
def paired_bootstrap(s, d):
    pairs = st.pair_systems(system(s, d, "a"), system(s, d, "b"))
    return st.paired_bootstrap(pairs, resamples=B)


@query("WITH " + q.COUNTS + " SELECT clip_name, ref_right, ref_left, a_right, a_left, b_right, b_left, passages, err_a, err_b FROM ce")
def paired_system_counts(s, d):
    return st.pair_systems(system(s, d, "a"), system(s, d, "b"))


LOC = "WITH " + q.COUNTS + RS("ce", ["location"], "clip_name", ["passages", "err_a", "err_b"], ["location"]) + """,
 n AS (SELECT location, b, err_a::DOUBLE/nullif(passages,0) AS a, err_b::DOUBLE/nullif(passages,0) AS bb FROM rs)"""



@query(LOC + f" SELECT location, {IV('a', 'release')}, {IV('bb', 'other')} FROM n GROUP BY 1")
def location_intervals(s, d):
    return st.location_intervals(release_samples(s, d), ["release", "other"])


@query(LOC + f""", m AS (SELECT b, avg(a) AS a, avg(bb) AS bb FROM n GROUP BY 1)
  SELECT {IV('a', 'release')}, {IV('bb', 'other')}, {IV('a-bb', 'minus_other')}, round(avg((a-bb<0)::INT::DOUBLE),9) AS better_than_other FROM m""")
def macro_intervals(s, d):
    return st.macro_intervals(release_samples(s, d), ["release", "other"], "release")


def release_samples(s, d):
    err = lambda p: F.abs(F.col(f"{p}_right") - F.col("ref_right")) + F.abs(F.col(f"{p}_left") - F.col("ref_left"))
    c = ad.clip_counts(s, d).select(
        "location", "clip_name", (F.col("ref_right") + F.col("ref_left")).alias("passages"),
        err("a").alias("err_release"), err("b").alias("err_other"),
    )
    return st.location_bootstrap(c, ["release", "other"], resamples=B)


@query("WITH " + q.COUNTS + """ SELECT count(*) AS clips, count(*) FILTER (a_right<>b_right OR a_left<>b_left) AS clips_with_different_counts,
  0 AS unpaired_clips FROM cc""")
def count_parity(s, d):
    return st.count_parity(system(s, d, "a"), system(s, d, "b"))


@query("WITH " + q.COUNTS + """, v AS (SELECT location, 'current' AS variant, sum(err_a)::DOUBLE/sum(passages) AS nmae, sum(err_a) AS errors FROM ce GROUP BY 1
  UNION ALL SELECT location, 'candidate', sum(err_b)::DOUBLE/sum(passages), sum(err_b) FROM ce GROUP BY 1)
  SELECT location, arg_min(variant, (nmae, errors, variant<>'current')) AS variant FROM v GROUP BY 1""")
def best_variant(s, d):
    a = system(s, d, "a").withColumn("variant", F.lit("current"))
    b = system(s, d, "b").withColumn("variant", F.lit("candidate"))
    r = a.unionByName(b).groupBy("location", "variant").agg(
        ct.ratio(F.sum(ct.absolute_error()), F.sum(F.col("ref_right") + F.col("ref_left"))).alias("nmae"), F.sum(ct.absolute_error()).alias("errors")
    )
    return st.select_best(r, "variant", F.col("nmae"), F.col("errors"), F.col("variant") != "current", keys=["location"])


# --- reviewers -----------------------------------------------------------------------------

LABELS = "WITH " + q.PRED + q.track_counts("pred", "pt") + """,
lab AS (SELECT clip_id, track_id, direction AS automatic, rv, CASE track_id%4 WHEN 1 THEN 'suggested' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'unresolved' END AS triage,
    (['automatic','accepted','rejected','corrected','unresolved','accepted'])[(track_id*(5+2*rv)+clip_id*3)%6+1] AS state,
    CASE (track_id+rv)%3 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END AS fix, start_frame, end_frame, start_u, end_u FROM pt, (VALUES (1),(2)) z(rv)),
lb AS (SELECT *, CASE WHEN state IN ('automatic','accepted') THEN automatic WHEN state='corrected' THEN fix END AS final FROM lab),
lv AS (SELECT *, CASE WHEN state='automatic' THEN 'unreviewed' WHEN state='unresolved' THEN 'unresolved' WHEN final IS NOT DISTINCT FROM automatic THEN 'kept'
  WHEN automatic IS NULL THEN 'counted' WHEN final IS NULL THEN 'removed' ELSE 'redirected' END AS verdict,
  CASE WHEN state='unresolved' THEN 'unresolved' ELSE coalesce(final,'none') END AS outcome FROM lb)"""


def labels(s, d):
    t = cc.pred_tracks(s, d).withColumnRenamed("direction", "automatic")
    t = t.withColumn("rv", F.explode(F.array(F.lit(1), F.lit(2))))
    states = F.array(*[F.lit(x) for x in ("automatic", "accepted", "rejected", "corrected", "unresolved", "accepted")])
    fix = F.expr("case (track_id + rv) % 3 when 0 then 'right' when 1 then 'left' end")
    t = t.withColumn("triage", F.expr("case track_id % 4 when 1 then 'suggested' when 2 then 'needs_review' when 3 then 'unresolved' end"))
    t = t.withColumn("state", F.element_at(states, F.expr("int((track_id * (5 + 2 * rv) + clip_id * 3) % 6 + 1)")))
    final = F.when(F.col("state").isin("automatic", "accepted"), F.col("automatic")).when(F.col("state") == "corrected", fix)
    return t.withColumn("final", final)


@query(LABELS + " SELECT rv, clip_id, track_id, verdict, outcome FROM lv")
def track_verdicts(s, d):
    return labels(s, d).select("rv", "clip_id", "track_id", lb.verdict().alias("verdict"), lb.outcome().alias("outcome"))


@query(LABELS + """ SELECT rv, coalesce(triage,'none') AS triage, count(*) FILTER (verdict<>'unreviewed') AS reviewed_tracks,
  count(*) FILTER (verdict IN ('removed','counted','redirected')) AS changed, count(*) FILTER (verdict='unresolved') AS unresolved,
  round((count(*) FILTER (verdict IN ('removed','counted','redirected')))::DOUBLE/nullif(count(*) FILTER (verdict<>'unreviewed'),0),9) AS changed_share FROM lv GROUP BY 1,2""")
def triage_table(s, d):
    return lb.triage_table(labels(s, d), ["rv"])


AGREE = LABELS + """, ag AS (SELECT a.clip_id, a.track_id, a.outcome AS first, b.outcome AS second FROM lv a JOIN lv b USING (clip_id, track_id)
  WHERE a.rv=1 AND b.rv=2 AND a.verdict<>'unreviewed' AND b.verdict<>'unreviewed')"""


@query(AGREE + " SELECT * FROM ag")
def both_reviewed(s, d):
    x = labels(s, d)
    return lb.both_reviewed(x.where("rv = 1"), x.where("rv = 2"))


@query(AGREE + """, c AS (SELECT first, second, count(*) AS n FROM ag GROUP BY 1,2), t AS (SELECT count(*) AS items, count(*) FILTER (first=second) AS same FROM ag),
  e AS (SELECT sum(x.n*y.n)::DOUBLE AS p FROM (SELECT first AS l, sum(n) AS n FROM c GROUP BY 1) x JOIN (SELECT second AS l, sum(n) AS n FROM c GROUP BY 1) y USING (l))
  SELECT items, same, round(same::DOUBLE/items,9) AS share, round(CASE WHEN p<>items*items THEN (same::DOUBLE/items-p/(items*items))/(1-p/(items*items)) END,9) AS kappa FROM t, e""")
def reviewer_kappa(s, d):
    x = labels(s, d)
    return lb.agreement(x.where("rv = 1"), x.where("rv = 2"))


def reviewed_clip_counts(s, d, lab=None):
    lab = labels(s, d) if lab is None else lab
    n = lambda cond: F.count(F.when(cond, 1))
    return lab.groupBy("rv", "clip_id").agg(
        n(F.col("automatic") == "right").alias("auto_right"), n(F.col("automatic") == "left").alias("auto_left"),
        n(F.col("final") == "right").alias("reviewed_right"), n(F.col("final") == "left").alias("reviewed_left"),
    )


SUMM = LABELS + q.track_counts("ref", "rt") + """, rf AS (SELECT clip_id, count(*) FILTER (direction='right') AS ref_right, count(*) FILTER (direction='left') AS ref_left FROM rt GROUP BY 1),
 sm AS (SELECT rv, lv.clip_id, any_value(ref_right) AS ref_right, any_value(ref_left) AS ref_left, count(*) AS tracks,
  count(*) FILTER (automatic='right') AS auto_right, count(*) FILTER (automatic='left') AS auto_left,
  count(*) FILTER (final='right') AS reviewed_right, count(*) FILTER (final='left') AS reviewed_left,
  """ + ", ".join(f"count(*) FILTER (verdict='{v}') AS {v}" for v in lb.VERDICTS) + """ FROM lv JOIN rf USING (clip_id) GROUP BY 1,2),
 se AS (SELECT *, abs(auto_right-ref_right)+abs(auto_left-ref_left) AS automatic_error, abs(reviewed_right-ref_right)+abs(reviewed_left-ref_left) AS reviewed_error,
  reviewed_right=ref_right AND reviewed_left=ref_left AS agrees_with_reference, unreviewed=0 AS complete FROM sm)"""


def summaries(s, d):
    lab = materialize(labels(s, d).select("rv", "clip_id", "track_id", "automatic", "state", "final"))
    ref = ct.tally(cc.ref_tracks(s, d)).select("clip_id", F.col("right").alias("ref_right"), F.col("left").alias("ref_left"))
    return lb.clip_summary(lab, reviewed_clip_counts(s, d, lab).join(ref, "clip_id"), ["rv", "clip_id"])


@query(SUMM + " SELECT * FROM se")
def clip_summaries(s, d):
    return summaries(s, d)


@query(SUMM + """, x AS (SELECT *, clip_id%2=0 OR rv=2 AS done FROM se) SELECT rv, count(*) AS clips, sum(ref_right+ref_left) AS passages,
  sum(automatic_error) AS automatic_error, sum(reviewed_error) AS reviewed_error, round(sum(automatic_error)::DOUBLE/nullif(sum(ref_right+ref_left),0),9) AS nmae_automatic,
  round(sum(reviewed_error)::DOUBLE/nullif(sum(ref_right+ref_left),0),9) AS nmae_reviewed, sum(reviewed_error)<=sum(automatic_error) AS target_no_harm FROM x WHERE done GROUP BY 1""")
def reviewer_totals(s, d):
    done = summaries(s, d).withColumn("complete", (F.col("clip_id") % 2 == 0) | (F.col("rv") == 2))
    return lb.reviewer_totals(done, "rv")


CHG = LABELS + """, nb AS (SELECT a.clip_id, a.track_id, count(*) AS n FROM pt a JOIN pt b ON a.clip_id=b.clip_id AND a.track_id<>b.track_id AND b.direction IS NOT NULL
   AND b.start_frame<=a.end_frame+10 AND a.start_frame<=b.end_frame+10 GROUP BY 1,2),
 ch AS (SELECT rv, lv.clip_id, lv.track_id, verdict, start_frame, end_frame, (start_u<0.5)<>(end_u<0.5) AS crosses_line_alone, coalesce(n,0) AS counted_tracks_nearby
  FROM lv LEFT JOIN nb USING (clip_id, track_id) WHERE verdict IN ('removed','counted','redirected'))"""


def changes(s, d):
    t = materialize(cc.pred_tracks(s, d))
    near = iv.nearby_counts(t, t.where("direction is not null"), 10, F.col("direction").isNotNull(), "counted_tracks_nearby")
    lab = labels(s, d).select("rv", "clip_id", "track_id", "automatic", "state", "final")
    return lb.describe_changes(lab, t, near)


@query(CHG + " SELECT * FROM ch")
def changed_tracks(s, d):
    return changes(s, d).select("rv", "clip_id", "track_id", "verdict", "start_frame", "end_frame", "crosses_line_alone", "counted_tracks_nearby")


@query(CHG + " SELECT rv, count(*) FILTER (verdict='counted' AND NOT crosses_line_alone AND counted_tracks_nearby>0) AS fragment_counts FROM ch GROUP BY 1")
def fragment_counts(s, d):
    return lb.fragment_counts(changes(s, d), ["rv"])


@query("WITH " + q.COUNTS + """ SELECT location, sum(greatest(ref_right-a_right,0)+greatest(ref_left-a_left,0)) AS missed,
  sum(least(greatest(b_right-a_right,0),greatest(ref_right-a_right,0))+least(greatest(b_left-a_left,0),greatest(ref_left-a_left,0))) AS recovered FROM cc GROUP BY 1""")
def recovered_passages(s, d):
    c = ad.clip_counts(s, d).withColumnsRenamed({"a_right": "auto_right", "a_left": "auto_left", "b_right": "reviewed_right", "b_left": "reviewed_left"})
    short, made = lb.recovered()
    return c.groupBy("location").agg(F.sum(short).alias("missed"), F.sum(made).alias("recovered"))


@query("WITH " + q.COUNTS + """, t AS (SELECT nation, sum(err_b)<=sum(err_a) AS ok FROM ce GROUP BY 1)
  SELECT count(*) AS reviewers, count(*) FILTER (ok) AS met_by, ceil(2*count(*)/3.0::DOUBLE)::BIGINT AS needed,
  CASE WHEN count(*)<3 THEN 'not evaluable' WHEN count(*) FILTER (ok)>=ceil(2*count(*)/3.0::DOUBLE) THEN 'met' ELSE 'not met' END AS outcome FROM t""")
def group_target(s, d):
    err = lambda p: F.sum(F.abs(F.col(f"{p}_right") - F.col("ref_right")) + F.abs(F.col(f"{p}_left") - F.col("ref_left")))
    return lb.group_target(ad.clip_counts(s, d).groupBy("nation").agg((err("b") <= err("a")).alias("ok")), "ok")


@query("""SELECT user_id%10 AS clip, count(*) FILTER (event_type='click') AS same, count(*) FILTER (event_type='view') AS different FROM events GROUP BY 1""")
def same_fish_answers(s, d):
    reason = F.when(F.col("event_type") == "click", lb.SAME_FISH_REASONS["same"]).when(F.col("event_type") == "view", lb.SAME_FISH_REASONS["different"])
    e = ad.table(s, d, "events").select((F.col("user_id") % 10).alias("clip"), reason.alias("reason"))
    return lb.answers(e, ["clip"])


@query("""SELECT user_id AS clip, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f')||'+00:00' AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f')||'+00:00' AS last, count(*) AS events,
  round((epoch_us(max(ts))-epoch_us(min(ts)))/60e6, 1) AS span_minutes FROM events GROUP BY 1""")
def review_timing(s, d):
    from shoalcount.functions.labels import iso

    e = ad.table(s, d, "events").select(F.col("user_id").alias("clip"), F.col("ts").cast("timestamp").alias("created_at"))
    return lb.review_timing(e, ["clip"]).withColumns({"first": iso(F.col("first")), "last": iso(F.col("last"))})


# --- usability -----------------------------------------------------------------------------


def scored(s, d):
    t = ad.trials(s, d)
    return us.scored_trials(t, ad.study_plan(s, d), t.where("k % 23 = 0"))


@query("WITH " + q.TRIALS + " SELECT participant, condition, clip, active_s, error, auto_error, passages, fixed, introduced FROM st")
def scored_trials(s, d):
    return scored(s, d).select("participant", "condition", "clip", "active_s", "error", "auto_error", "passages", "fixed", "introduced")


PART = """, pr AS (SELECT participant, count(*) FILTER (condition='manual') AS clips_manual, count(*) FILTER (condition='assisted') AS clips_assisted,
  avg(active_s) FILTER (condition='manual') AS mean_s_manual, avg(active_s) FILTER (condition='assisted') AS mean_s_assisted,
  (sum(error) FILTER (condition='manual'))::DOUBLE/nullif(sum(passages) FILTER (condition='manual'),0) AS nmae_manual,
  (sum(error) FILTER (condition='assisted'))::DOUBLE/nullif(sum(passages) FILTER (condition='assisted'),0) AS nmae_assisted,
  (sum(auto_error) FILTER (condition='assisted'))::DOUBLE/nullif(sum(passages) FILTER (condition='assisted'),0) AS automatic_nmae,
  sum(fixed) FILTER (condition='assisted') AS errors_fixed, sum(introduced) FILTER (condition='assisted') AS errors_introduced FROM st GROUP BY 1)"""


@query("WITH " + q.TRIALS + PART + """ SELECT participant, clips_manual, clips_assisted, round(mean_s_manual,6) AS mean_s_manual, round(mean_s_assisted,6) AS mean_s_assisted,
  round(nmae_manual,9) AS nmae_manual, round(nmae_assisted,9) AS nmae_assisted, round(automatic_nmae,9) AS automatic_nmae, errors_fixed, errors_introduced,
  round(mean_s_assisted/mean_s_manual,9) AS time_ratio, round(1-mean_s_assisted/mean_s_manual,9) AS time_saving, round(nmae_assisted-nmae_manual,9) AS nmae_difference,
  CASE WHEN participant LIKE 'D%' THEN 'developer' ELSE 'independent' END AS role, 1-mean_s_assisted/mean_s_manual>=0.3 AND nmae_assisted<=nmae_manual AS target_met FROM pr""")
def participant_results(s, d):
    r = us.participant_results(scored(s, d))
    six = {c: F.round(c, 6) for c in ("mean_s_manual", "mean_s_assisted")}
    nine = {c: F.round(c, 9) for c in ("nmae_manual", "nmae_assisted", "automatic_nmae", "time_ratio", "time_saving", "nmae_difference")}
    return r.withColumns({**six, **nine})


WIDE = """(sum(active_s) FILTER (condition='assisted')/sum(one) FILTER (condition='assisted'))/(sum(active_s) FILTER (condition='manual')/sum(one) FILTER (condition='manual')) AS ratio,
  (sum(error) FILTER (condition='assisted'))::DOUBLE AS ae, sum(passages) FILTER (condition='assisted') AS ap, (sum(error) FILTER (condition='manual'))::DOUBLE AS me, sum(passages) FILTER (condition='manual') AS mp"""


@query("WITH " + q.TRIALS + ", s1 AS (SELECT *, 1 AS one FROM st)"
  + RS("s1", ["participant", "condition"], "clip", ["active_s", "error", "passages", "one"], ["participant", "condition"])
  + f""", w AS (SELECT participant, b, {WIDE} FROM rs GROUP BY 1,2), y AS (SELECT *, ae/nullif(ap,0)-me/nullif(mp,0) AS diff FROM w)
  SELECT participant, {IV('ratio', 'time_ratio')}, {IV('diff', 'nmae_difference')} FROM y GROUP BY 1""")
def participant_intervals(s, d):
    return us.participant_intervals(scored(s, d), B)


@query("WITH " + q.TRIALS + f""", w AS (SELECT participant, {WIDE.replace('sum(one)', 'count(*)')} FROM st WHERE participant NOT LIKE 'D%' GROUP BY 1)
  SELECT count(*) AS participants, round(exp(avg(ln(ratio))),9) AS time_ratio_geometric_mean, round(sum(me)/nullif(sum(mp),0),9) AS nmae_manual,
  round(sum(ae)/nullif(sum(ap),0),9) AS nmae_assisted, round(sum(ae)/nullif(sum(ap),0)-sum(me)/nullif(sum(mp),0),9) AS nmae_difference,
  1-exp(avg(ln(ratio)))>=0.3::DOUBLE AND sum(ae)/nullif(sum(ap),0)-sum(me)/nullif(sum(mp),0)<=0 AS target_met FROM w HAVING count(*)>=3""")
def group_results(s, d):
    return us.group_results(scored(s, d), strict=False).select(
        "participants", *[F.round(c, 9).alias(c) for c in ("time_ratio_geometric_mean", "nmae_manual", "nmae_assisted", "nmae_difference")], "target_met"
    )


@query("WITH " + q.TRIALS + f""", s1 AS (SELECT *, 1 AS one FROM st WHERE participant NOT LIKE 'D%'),
  pp AS (SELECT *, {M('k')} AS mk FROM (SELECT participant, row_number() OVER (ORDER BY {H('participant')}, participant)-1 AS k, count(*) OVER () AS np FROM (SELECT DISTINCT participant FROM s1))),
  kp AS (SELECT b, {M('s')} AS kk FROM (SELECT b, {M(f"({H("'0'", "'people'")}+b)&4294967295")} AS s FROM range({B}) z(b))),
  ch AS (SELECT c.b, c.slot, x.participant, c.b*x.np+c.slot AS aid FROM (SELECT b, p.k AS slot, {M('xor(kk, mk)')}%p.np AS pk FROM pp p, kp) c JOIN pp x ON x.k=c.pk),
  ci AS (SELECT *, {M('j')} AS mj FROM (SELECT *, row_number() OVER (PARTITION BY participant, condition ORDER BY {H('clip')}, clip)-1 AS j, count(*) OVER (PARTITION BY participant, condition) AS nc
    FROM (SELECT participant, condition, clip, active_s, error, passages, one FROM s1))),
  cn AS (SELECT condition, {H("'0'", 'condition')} AS gs FROM (VALUES ('manual'), ('assisted')) v(condition)),
  kd AS (SELECT b, slot, participant, condition, {M('s')} AS kk FROM (SELECT b, slot, participant, condition, {M('(gs+aid)&4294967295')} AS s FROM ch, cn)),
  dr AS (SELECT b, slot, participant, condition, {M('xor(kk, mj)')}%nc AS pj FROM kd JOIN ci USING (participant, condition)),
  w AS (SELECT b, slot, {WIDE.replace('condition', 'dr.condition')} FROM dr JOIN ci c ON c.participant=dr.participant AND c.condition=dr.condition AND c.j=dr.pj GROUP BY 1,2),
  y AS (SELECT b, exp(avg(ln(ratio))) AS ratio, sum(ae)/nullif(sum(ap),0)-sum(me)/nullif(sum(mp),0) AS diff FROM w GROUP BY 1)
  SELECT {IV('ratio', 'time_ratio')}, {IV('diff', 'nmae_difference')} FROM y""")
def group_intervals(s, d):
    return us.group_intervals(scored(s, d), B)


@query("""WITH a AS (SELECT user_id%20 AS participant, event_id%9=0 AS practice, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'set_direction'
   WHEN 'signup' THEN 'mark_unresolved' ELSE 'mark_audited' END AS action, CASE WHEN user_id%3=0 THEN 'right' END AS ad FROM events)
  SELECT participant, """ + ", ".join(f"count(*) FILTER (action='{x}') AS {x}" for x in us.ACTIONS) + """,
  count(*) FILTER (action='set_direction' AND ad IS NULL) AS set_direction_on_non_passages FROM a WHERE NOT practice GROUP BY 1""")
def review_actions(s, d):
    action = F.expr("case event_type when 'click' then 'accept' when 'view' then 'reject' when 'purchase' then 'set_direction' when 'signup' then 'mark_unresolved' else 'mark_audited' end")
    rows = ad.table(s, d, "events").select(
        (F.col("user_id") % 20).alias("participant"), (F.col("event_id") % 9 == 0).alias("practice"), action.alias("action"),
        F.when(F.col("user_id") % 3 == 0, "right").alias("automatic_direction"),
    )
    return us.review_actions(rows)


@query("""SELECT s_suppkey AS participant, 2.5*list_sum([CASE WHEN i%2=0 THEN (s_suppkey*7+i*3)%5 ELSE 4-(s_suppkey*7+i*3)%5 END FOR i IN range(10)]) AS sus,
  list_sum([(s_suppkey*11+i*17)%101 FOR i IN range(6)])/6.0::DOUBLE AS tlx_raw FROM supplier""")
def questionnaire_scores(s, d):
    forms = ad.table(s, d, "supplier").selectExpr(
        "s_suppkey as participant", "transform(sequence(0, 9), i -> int((s_suppkey * 7 + i * 3) % 5 + 1)) as sus_items",
        "transform(sequence(0, 5), i -> int((s_suppkey * 11 + i * 17) % 101)) as tlx_items",
    )
    return forms.select("participant", us.sus_score(F.col("sus_items")).alias("sus"), us.tlx_raw(F.col("tlx_items")).alias("tlx_raw"))


@query("WITH " + q.TRIALS + """, b AS (SELECT DISTINCT participant, block, condition, clip FROM tr WHERE k%6<>5 AND participant<>'P7'),
  c AS (SELECT DISTINCT participant, block, condition FROM b)
  SELECT t.participant, t.clip, CASE WHEN t.participant NOT IN (SELECT participant FROM b) THEN 'unknown participant'
   WHEN coalesce((SELECT any_value(condition) FROM c WHERE c.participant=t.participant AND c.block=t.block)<>t.condition, true) THEN 'wrong condition for block'
   WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.participant=t.participant AND b.block=t.block AND b.clip=t.clip) THEN 'clip not in block'
   WHEN t.condition='manual' AND k%14=0 THEN 'manual trial needs both counts' WHEN t.condition='assisted' AND k%11=0 THEN 'no job for clip' END AS reason FROM tr t""")
def trial_checks(s, d):
    t = ad.trials(s, d)
    blocks = t.where("k % 6 <> 5 and participant <> 'P7'").select("participant", "block", "condition", "clip")
    jobs = t.where("k % 11 <> 0").select("participant", "clip", F.concat(F.lit("j"), "clip").alias("job_id"))
    t = t.withColumn("final_right", F.when(F.col("k") % 14 != 0, F.col("final_right")))
    return us.check_trials(t, blocks, jobs).select("participant", "clip", "reason")


# --- design --------------------------------------------------------------------------------

STRAT = "camera||':'||(CASE WHEN passages=0 THEN 0 WHEN passages<=2 THEN 1 WHEN passages<=4 THEN 2 ELSE 3 END)"


@query("WITH " + q.COUNTS + f""", s AS (SELECT *, {STRAT} AS stratum FROM ce), z AS (SELECT stratum, count(*) AS size, 50*count(*)::DOUBLE/(SELECT count(*) FROM s) AS ex FROM s GROUP BY 1),
  t AS (SELECT *, greatest(1,floor(ex))::BIGINT AS take0 FROM z), m AS (SELECT *, 50-sum(take0) OVER () AS missing, row_number() OVER (ORDER BY (take0<size) DESC, ex-floor(ex) DESC, stratum) AS turn FROM t),
  a AS (SELECT stratum, size, ex, missing, take0+(take0<size AND turn<=missing)::INT AS take1 FROM m),
  u AS (SELECT stratum, unnest(range(0,take1-1)) AS u, take1, ex, missing FROM a WHERE missing<0 AND take1>1),
  r AS (SELECT stratum, count(*) AS gone FROM (SELECT *, row_number() OVER (ORDER BY take1-u-ex DESC, stratum, u) AS r FROM u) WHERE r<=-missing GROUP BY 1),
  f AS (SELECT stratum, take1-coalesce(gone,0) AS take FROM a LEFT JOIN r USING (stratum)),
  p AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY {H("'0'", 'clip_name')}, clip_name)-1 AS place FROM s),
  c AS (SELECT clip_name, stratum FROM p JOIN f USING (stratum) WHERE place<take)
  SELECT clip_name, stratum, row_number() OVER (ORDER BY {H("'1'", 'clip_name')}, clip_name)-1 AS presentation FROM c""")
def stratified_sample(s, d):
    return ds.stratified_sample(ad.clip_counts(s, d), 50).select("clip_name", "stratum", "presentation")


@query("WITH " + q.COUNTS + f""", p AS (SELECT code AS clip, row_number() OVER (ORDER BY {H("'0'", 'code')}, code) AS n FROM cc)
  SELECT clip, 't'||CASE WHEN n<100 THEN lpad(n::VARCHAR,2,'0') ELSE n::VARCHAR END AS code FROM p""")
def neutral_codes(s, d):
    return ds.neutral_codes(ad.study_plan(s, d).select("clip"), "clip", 0).select("clip", "code")


@query(f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H("'300012'", 'o_orderkey::VARCHAR')}, o_orderkey)-1 AS place FROM orders)
  SELECT o_orderkey, place FROM p WHERE place>=100""")
def epoch_order(s, d):
    return ds.epoch_order(ad.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 3, 3, 100).select("o_orderkey", "place")


@query("WITH " + q.TRIALS + """, p AS (SELECT participant, (row_number() OVER (ORDER BY participant)-1)%4 AS r FROM (SELECT DISTINCT participant FROM tr))
  SELECT participant, block, condition, clip_set FROM p JOIN (VALUES (0,1,'manual','S1'),(0,2,'assisted','S2'),(1,1,'assisted','S1'),(1,2,'manual','S2'),
  (2,1,'manual','S2'),(2,2,'assisted','S1'),(3,1,'assisted','S2'),(3,2,'manual','S1')) q(r,block,condition,clip_set) USING (r)""")
def latin_square(s, d):
    return ds.latin_square(ad.trials(s, d).select("participant").distinct())


DOC = r"((?:kenai-train|kenai-val|kenai-rightbank|kenai-channel|elwha|nushagak)_[A-Za-z]+_Stratum\d_\d{4}-\d{2}-\d{2}_\d{6}_\d+_\d+)"


def citing_documents(s, d):
    """The documents, each citing one clip: its text followed by the name."""
    docs, c = ad.table(s, d, "documents"), ad.clip_counts(s, d).select("k", "clip_name")
    return docs.join(c, docs.doc_id * 5 == c.k, "left").select(F.concat_ws(" ", "text", F.concat("clip_name", F.lit("."))).alias("text"))


def documented(s, d):
    names = ad.clip_counts(s, d).select(F.col("clip_name").alias("name"))
    return ds.documented_names(citing_documents(s, d), names, DOC)


@query("WITH " + q.COUNTS + " SELECT clip_name AS name FROM cc JOIN documents ON doc_id*5=k")
def documented_names(s, d):
    return documented(s, d)


@query("WITH " + q.COUNTS + """ SELECT clip_name, num_frames, ref_right, ref_left FROM ce WHERE num_frames BETWEEN 150 AND 450 AND num_frames/framerate BETWEEN 15 AND 45
  AND passages BETWEEN 1 AND 8 AND k NOT IN (SELECT doc_id*5 FROM documents)""")
def study_eligible(s, d):
    return ds.eligible(ad.clip_counts(s, d), documented(s, d)).select("clip_name", "num_frames", "ref_right", "ref_left")


@query("WITH " + q.COUNTS + f""", e AS (SELECT *, CASE WHEN passages<=2 THEN 0 WHEN passages<=4 THEN 1 ELSE 2 END AS bin, num_frames/framerate AS sec FROM ce WHERE num_frames BETWEEN 150 AND 450 AND passages BETWEEN 1 AND 8),
  h AS (SELECT camera||':'||bin AS key, clip_name, passages, sec, err_a, row_number() OVER (PARTITION BY camera, bin ORDER BY {H("'0'", 'clip_name')}, clip_name) AS p FROM e),
  k AS (SELECT x.key, x.clip_name AS n0, y.clip_name AS n1, x.passages AS p0, y.passages AS p1, x.sec AS s0, y.sec AS s1, x.err_a AS e0, y.err_a AS e1, row_number() OVER (ORDER BY x.key)-1 AS bit,
    count(*) OVER () AS ns FROM h x JOIN h y ON x.key=y.key AND x.p=1 AND y.p=2),
  i AS (SELECT *, CASE WHEN bit=0 THEN 0 ELSE (i >> (ns-1-bit)) & 1 END AS f FROM k, range((1<<(SELECT max(ns)-1 FROM k))::BIGINT) z(i)),
  g AS (SELECT i, abs(sum(CASE f WHEN 0 THEN p0-p1 ELSE p1-p0 END)) AS d_pass, abs(sum(CASE f WHEN 0 THEN s0 ELSE s1 END)-sum(CASE f WHEN 0 THEN s1 ELSE s0 END)) AS d_sec,
    abs(sum(CASE f WHEN 0 THEN e0-e1 ELSE e1-e0 END)) AS d_err, sum(s0+s1) AS tot, list(CASE f WHEN 0 THEN n0 ELSE n1 END ORDER BY key) AS names FROM i GROUP BY 1),
  o AS (SELECT *, round(d_pass/2.0::DOUBLE+d_sec/(tot*0.1::DOUBLE/2)+d_err/2.0::DOUBLE,9) AS score FROM g WHERE d_pass<=2 AND d_sec<=tot*0.1::DOUBLE/2 AND d_err<=2)
  SELECT array_to_string(names,',') AS names, round(score,6) AS score, d_pass, d_err FROM o ORDER BY o.score, o.names LIMIT 1""")
def matched_sets(s, d):
    best = ds.match_sets(study_pairs(s, d))
    return best.select(F.array_join("names", ",").alias("names"), F.round("score", 6).alias("score"), "d_pass", "d_err")


def study_pairs(s, d):
    return ds.stratum_pairs(ad.clip_counts(s, d).where("num_frames between 150 and 450"), 0)


@query("WITH " + q.COUNTS + f""", e AS (SELECT *, CASE WHEN passages<=2 THEN 0 WHEN passages<=4 THEN 1 ELSE 2 END AS bin FROM ce WHERE num_frames BETWEEN 150 AND 450 AND passages BETWEEN 1 AND 8),
  h AS (SELECT *, row_number() OVER (PARTITION BY camera, bin ORDER BY {H("'0'", 'clip_name')}, clip_name) AS p FROM e),
  t AS (SELECT clip_name, 'S'||p AS clip_set FROM h WHERE p<=2),
  pr AS (SELECT camera, arg_min(clip_name, {H("'1'", 'clip_name')}) AS clip_name FROM e WHERE clip_name NOT IN (SELECT clip_name FROM t) GROUP BY 1),
  co AS (SELECT *, format('c{{:02d}}', row_number() OVER (ORDER BY {H("'2'", 'clip_name')}, clip_name)) AS code FROM t)
  SELECT format('p{{:02d}}', row_number() OVER (ORDER BY camera)) AS code, clip_name, 'practice' AS role, NULL AS clip_set, row_number() OVER (ORDER BY camera)-1 AS place FROM pr
  UNION ALL SELECT code, clip_name, 'trial', clip_set, row_number() OVER (PARTITION BY clip_set ORDER BY {H("'3'", 'code')}, code)-1 FROM co""")
def study_codes(s, d):
    """Practice clips, neutral codes and set orders; here the first clips of all strata are one set, the second the other."""
    pool = ad.clip_counts(s, d).where("num_frames between 150 and 450 and ref_right + ref_left between 1 and 8")
    both = ds.stratum_pairs(pool, 0).select(F.explode(F.expr("map('S1', x0.name, 'S2', x1.name)")).alias("clip_set", "clip_name"))
    return ds.assign_codes(ds.practice_clips(pool, both, 1), both, 2)


@query("""WITH RECURSIVE dd AS (SELECT o_orderpriority AS location, o_orderdate::DATE AS day, count(*)*300 AS frames FROM orders GROUP BY 1,2),
  o AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY day) AS i FROM dd),
  w AS (SELECT location, i, day, 0 AS chunk, frames*1000.0::DOUBLE AS used FROM o WHERE i=1
    UNION ALL SELECT o.location, o.i, o.day, CASE WHEN used+o.frames*1000.0::DOUBLE>5e6 THEN chunk+1 ELSE chunk END,
     CASE WHEN used+o.frames*1000.0::DOUBLE>5e6 THEN o.frames*1000.0::DOUBLE ELSE used+o.frames*1000.0::DOUBLE END FROM w JOIN o ON o.location=w.location AND o.i=w.i+1)
  SELECT location, strftime(day,'%Y-%m-%d') AS day, chunk FROM w""")
def day_chunks(s, d):
    days = ad.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("location"), F.to_date("o_orderdate").alias("day")).agg(
        (F.count(F.lit(1)) * 300).alias("frames")
    )
    return ds.plan_day_chunks(days, 1000.0, 5e6).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("WITH " + q.COUNTS + " SELECT code, a_right, a_left FROM cc WHERE code>='s0000016' AND (a_right<ref_right OR a_left<ref_left) ORDER BY code LIMIT 6")
def undercounted_clips(s, d):
    c = ad.clip_counts(s, d).withColumnsRenamed({"a_right": "auto_right", "a_left": "auto_left"})
    out = ds.undercounted(c, 6, "s0000016")
    return out.select("code", F.col("auto_right").alias("a_right"), F.col("auto_left").alias("a_left"))


@query("""WITH c AS (SELECT o_orderkey AS k, format('Kenai_LeftFar_Stratum1_{}_{:06d}_{}_{}', strftime(o_orderdate,'%Y-%m-%d'), o_orderkey%240000, o_custkey, o_custkey+o_orderkey%5-1) AS n,
  o_orderdate, o_custkey FROM orders) SELECT k, CASE WHEN k%5>1 THEN strftime(o_orderdate,'%Y-%m-%d') END AS day, CASE WHEN k%5>1 THEN o_custkey END AS start,
  CASE WHEN k%5>1 THEN o_custkey+k%5-1 END AS stop, CASE WHEN k%5>1 THEN regexp_extract(n, '^(.*_\\d{6})_\\d+_\\d+$', 1) END AS recording, 'LeftFar' AS camera FROM c""")
def parsed_clip_names(s, d):
    name = F.format_string(
        "Kenai_LeftFar_Stratum1_%s_%06d_%d_%d", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 240000,
        "o_custkey", F.col("o_custkey") + F.col("o_orderkey") % 5 - 1,
    )
    p = ad.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), nm.parse_clip_name(name).alias("p"), nm.camera(name).alias("camera"))
    return p.select(
        "k", F.date_format("p.recording_date", "yyyy-MM-dd").alias("day"), "p.start", "p.stop", F.col("p.recording_id").alias("recording"), "camera"
    )
