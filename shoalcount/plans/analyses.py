"""End-to-end analyses. Each takes tables and returns named result tables.

Track- and clip-level tables that several results read are stored once (``materialize``); box
tables are only ever streamed through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.functions import names as nm
from shoalcount.operators import audit as au
from shoalcount.operators import counting as ct
from shoalcount.operators import design as ds
from shoalcount.operators import intervals as iv
from shoalcount.operators import labels as lb
from shoalcount.operators import matching as mt
from shoalcount.operators import ops
from shoalcount.operators import prioritization as pr
from shoalcount.operators import quality as ql
from shoalcount.operators import reviews as rv
from shoalcount.operators import scoring as sc
from shoalcount.operators import stats as st
from shoalcount.operators import tracking as tk
from shoalcount.operators import usability as us
from shoalcount.operators import validation as vl
from shoalcount.plans import experiments as ex
from shoalcount.operators.quantiles import quantiles
from shoalcount.session import materialize
from shoalcount.sources import files as fi

Tables = dict[str, DataFrame]


def review_tracks(boxes: DataFrame, width: int, height: int, mx: float, my: float, config: sc.ReviewConfig = sc.ReviewConfig()) -> DataFrame:
    """Counted and scored tracks of tracked boxes."""
    counts = ct.count_trajectories(boxes, width, height)
    return sc.review(sc.track_features(boxes, counts, mx, my), config)


def audit(tracks: DataFrame, clips: DataFrame, framerate: float, calibration: sc.Calibration = sc.Calibration()) -> DataFrame:
    """Audit windows over the footage the flagged tracks leave free."""
    flagged = tracks.where(sc.is_flagged()).select("clip_id", F.col("start_frame").alias("first"), F.col("end_frame").alias("last"))
    window = max(1, round(calibration.audit_window_s * framerate))
    return au.audit_windows(clips, flagged, window, calibration.audit_fraction, round(calibration.audit_margin_s * framerate))


def passage_counts(
    detections: DataFrame, clips: DataFrame, tracker: tk.KalmanConfig | tk.ByteTrackConfig, width: int, height: int, mx: float, my: float,
    framerate: float, upstream: Column,
) -> Tables:
    """Detections to directional counts, scored tracks and audit windows."""
    boxes = materialize(tk.track(detections, [tracker], mx, my).drop("variant"))
    tracks = materialize(review_tracks(boxes, width, height, mx, my))
    return {
        "observations": boxes,
        "tracks": tracks,
        "counts": ct.river_counts(ct.tally(tracks), upstream),
        "audit_windows": au.with_times(audit(tracks, clips, framerate), clips),
    }


def location_report(clips: DataFrame, reference: DataFrame, predicted: DataFrame, predicted_clips: DataFrame, policy: ct.CountingPolicy = ct.DEFAULT_POLICY) -> Tables:
    """nMAE per location, overall and macro-averaged, from tracks on both sides."""
    pairs = materialize(ct.evaluate_predictions(clips, reference, predicted, predicted_clips, policy))
    return {
        "clips": pairs.withColumn("absolute_error", ct.absolute_error()),
        "locations": ct.summarize(pairs, "location", overall=True),
        "macro": ct.macro_nmae(ct.summarize(pairs, "location")),
    }


def compare_systems(a: DataFrame, b: DataFrame, resamples: int = 10_000, seed: int = 0) -> Tables:
    """Paired comparison of two systems' per-clip counts."""
    pairs = materialize(st.pair_systems(a, b))
    return {"pairs": pairs, "comparison": st.paired_bootstrap(pairs, resamples=resamples, seed=seed)}


def release_summary(counts: DataFrame, systems: Sequence[str], baseline: str, resamples: int = 10_000, seed: int = 0) -> Tables:
    """Per-location values with intervals, macro averages and paired differences.

    ``counts``: clip_name, location, ref_right/left, and <system>_right/left per system.
    """
    err = lambda s: F.abs(F.col(f"{s}_right") - F.col("ref_right")) + F.abs(F.col(f"{s}_left") - F.col("ref_left"))
    base = materialize(counts.select(
        "location", "clip_name", (F.col("ref_right") + F.col("ref_left")).alias("passages"), *[err(s).alias(f"err_{s}") for s in systems],
        *[ct.missed(s).alias(f"missed_{s}") for s in systems],
    ))
    points = base.groupBy("location").agg(
        F.count(F.lit(1)).alias("clips"), F.sum("passages").alias("passages"),
        *[F.round(ct.ratio(F.sum(f"err_{s}"), F.sum("passages")), 4).alias(f"nmae_{s}") for s in systems],
        *[F.sum(f"missed_{s}").alias(f"missed_{s}") for s in systems],
        *[(F.sum(f"err_{s}") - F.sum(f"missed_{s}")).alias(f"false_{s}") for s in systems],
    )
    samples = materialize(st.location_bootstrap(base, systems, resamples=resamples, seed=seed))
    return {
        "locations": points.join(st.location_intervals(samples, systems), "location"),
        "macro": st.macro_intervals(samples, systems, baseline),
    }


def error_analysis(
    clips: DataFrame, reference: DataFrame, predicted: DataFrame, width: int, height: int, detected: DataFrame | None = None,
    m2_per_px: Column | None = None, bins: Sequence[float] = (0.02, 0.05, 0.1),
) -> Tables:
    """Passage outcomes, direction confusion, slices and recall by size."""
    rc = materialize(ct.count_trajectories(reference, width, height))
    pc = materialize(ct.count_trajectories(predicted, width, height))
    f = materialize(mt.match_features(mt.match_tracks(reference, predicted), rc, pc))
    ro, po = materialize(mt.reference_outcomes(f, rc)), materialize(mt.predicted_outcomes(f, pc))
    pairs = ct.paired_counts(clips, ct.tally(rc), ct.tally(pc)).withColumn("duration_s", F.col("num_frames") / F.col("framerate"))
    out = {
        "totals": mt.outcome_totals(ro, po),
        "confusion": mt.direction_confusion(f, rc, pc),
        "slices": ct.summarize(pairs.withColumn("slice", nm.camera_slice(F.col("clip_name"))), "slice"),
        "examples": ro.where("outcome <> 'counted'").withColumn("kind", F.lit("reference")).unionByName(
            po.where("outcome in ('duplicate', 'background', 'non_passing_fish')").withColumn("kind", F.lit("predicted"))
        ),
    }
    if detected is not None and m2_per_px is not None:
        out["recall_by_size"] = mt.recall_by_size(reference, detected, m2_per_px, bins)
    return out


def review_prioritisation(
    clips: DataFrame, reference: DataFrame, predicted: DataFrame, width: int, height: int, mx: float, my: float, framerate: float,
    budgets: Sequence[float], repeats: int = 200, seed: int = 0,
) -> Tables:
    """How fast the queue, the score alone and random order lead to the errors; audit coverage."""
    tracks = materialize(review_tracks(predicted, width, height, mx, my))
    rc = materialize(ct.count_trajectories(reference, width, height))
    f = materialize(mt.match_features(mt.match_tracks(reference, predicted), rc, tracks))
    ro, po = materialize(mt.reference_outcomes(f, rc)), mt.predicted_outcomes(f, tracks)
    revealed = materialize(pr.reveals(f, ro, po))
    missing = materialize(pr.unreachable(ro, revealed))
    items = materialize(
        pr.queue_items(tracks, F.lit(framerate)).join(tracks.select("clip_id", "track_id", "triage", "direction", "review_score"), ["clip_id", "track_id"])
    )
    tie = ("clip_id", "track_id")
    by_score = [F.col("review_score").asc_nulls_last(), *[F.col(t) for t in tie]]
    windows = materialize(audit(tracks, clips, framerate))
    lost = reference.join(missing.select("clip_id", "track_id"), ["clip_id", "track_id"], "left_semi")
    return {
        "triage_then_score": pr.found_curve(items, revealed, missing, budgets, sc.queue_order(tie)),
        "score_only": pr.found_curve(items, revealed, missing, budgets, by_score),
        "random": pr.random_order_curve(items.select("clip_id", "track_id", "cost_s"), revealed, missing, budgets, repeats, seed),
        "audit": windows.agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias("audit_frames")),
        "audited_missed": iv.points_in_windows(lost, windows).select("clip_id", "track_id").distinct(),
    }


def ablation(
    detections: DataFrame, reference: DataFrame, clips: DataFrame, variants: Sequence[ex.Variant],
    width: int, height: int, mx: float, my: float,
) -> DataFrame:
    """Pipeline variants (tracker, suppression IoU, suppression containment) with nMAE and
    passage errors; ``selected`` marks the winner, ties keeping 'current'."""
    if not variants or variants[0][0].name != "current":
        raise ValueError("the first variant must be 'current'")
    reference, detections = materialize(reference), materialize(detections)  # read several times by every variant
    ref_tracks = materialize(ct.count_trajectories(reference, width, height))
    clips = materialize(clips.select("clip_id"))
    rows = None
    for variant in variants:  # a handful of declared variants, one plan each
        config = variant[0]
        kept = materialize(ex.apply_variant(detections, variant))
        tracks = materialize(tk.track(kept, [config], mx, my).drop("variant"))
        pred_tracks = materialize(ct.count_trajectories(tracks, width, height))
        errors = ex.passage_errors(reference, tracks, ref_tracks, pred_tracks)
        counts = ct.paired_counts(clips, ct.tally(ref_tracks), ct.tally(pred_tracks))
        score = counts.agg(
            ct.ratio(F.sum(ct.absolute_error()), F.sum(F.col("ref_right") + F.col("ref_left"))).alias("nmae"), F.sum(ct.absolute_error()).alias("errors")
        )
        row = score.crossJoin(errors).select(F.lit(config.name).alias("variant"), "*")  # one row by one row
        rows = row if rows is None else rows.unionByName(row)
    rows = materialize(rows)
    best = st.select_best(rows, "variant", F.col("nmae"), F.col("passage_errors"), F.col("variant") != "current")
    return rows.join(best.withColumn("selected", F.lit(True)), "variant", "left").fillna(False, ["selected"])


def reviewed_sample(labels: DataFrame, counts: DataFrame, tracks: DataFrame, events: DataFrame) -> Tables:
    """Reviewers against the automatic result, the reference and each other.

    ``labels``: reviewer (``rv``), clip_id, track_id, triage, automatic, state, final.
    """
    near = materialize(iv.nearby_counts(tracks, tracks.where("direction is not null"), 10, F.col("direction").isNotNull(), "counted_tracks_nearby"))
    summary = lb.clip_summary(labels, counts, ["rv", "clip_id"])
    return {
        "clips": summary,
        "triage": lb.triage_table(labels, ["rv"]),
        "agreement": lb.agreement(labels.where("rv = 1"), labels.where("rv = 2")),
        "changes": lb.describe_changes(labels, tracks, near),
        "reviewers": lb.reviewer_totals(summary, "rv"),
        "timing": lb.review_timing(events, ["clip"]),
    }


def same_fish_coverage(events: DataFrame, tracks: DataFrame, jobs: DataFrame, groups: DataFrame, gap: int = 10) -> Tables:
    """How many past count decisions would have met the same-fish question."""
    accepted = materialize(rv.accepted_events(events, rv.fold_reviews(events, tracks, jobs)))
    decisions = materialize(rv.replay(accepted, tracks, gap))
    near = iv.has_nearby(tracks.where("direction is null"), tracks.where("direction is not null"), gap, ["job_id"])
    rate = near.groupBy("job_id").agg(F.count(F.lit(1)).alias("uncounted_tracks"), F.count(F.when(F.col("nearby"), 1)).alias("with_question"))
    return {"decisions": decisions, "coverage": rv.replay_coverage(decisions, rate, groups)}


def retest(summary: DataFrame, changes: DataFrame, events: DataFrame) -> Tables:
    """Re-test targets per reviewer and for the group."""
    per = lb.reviewer_totals(summary, "rv")
    fragments = lb.fragment_counts(changes, ["rv"]).withColumn("target_fragments", F.col("fragment_counts") <= lb.MAX_FRAGMENT_COUNTS)
    joined = materialize(per.join(fragments, "rv", "left"))
    return {
        "reviewers": joined,
        "no_harm": lb.group_target(joined, "target_no_harm"),
        "fragments": lb.group_target(joined, "target_fragments"),
        "answers": lb.answers(events, ["clip"]),
    }


def usability(trials: DataFrame, plan: DataFrame, excluded: DataFrame, questionnaires: DataFrame, actions: DataFrame, resamples: int = 10_000, seed: int = 0, strict: bool = True) -> Tables:
    scored = materialize(us.scored_trials(trials, plan, excluded))
    forms = questionnaires.select("participant", "condition", us.sus_score(F.col("sus")).alias("sus"), us.tlx_raw(F.col("tlx")).alias("tlx_raw"))
    return {
        "participants": us.participant_results(scored).join(us.participant_intervals(scored, resamples, seed), "participant"),
        "group": us.group_results(scored, strict),
        "group_intervals": us.group_intervals(scored, resamples, seed),
        "questionnaires": forms,
        "review_actions": us.review_actions(actions),
    }


def validate_dataset(boxes: DataFrame, clips: DataFrame, on_disk: DataFrame, present: DataFrame) -> Tables:
    """Issues, statistics, status and totals of every clip."""
    shape = ql.box_issues(boxes, clips).select("clip_id", "code", "severity", "count")
    dup = ql.duplicate_issues(boxes)
    gaps = ql.missing_frames(present, clips).groupBy("clip_id").agg(
        F.lit("missing_frames").alias("code"), F.sum(F.col("stop") - F.col("start") + 1).alias("count")
    )
    beyond = ql.frames_beyond(present, clips).groupBy("clip_id").agg(F.lit("frame_window_out_of_range").alias("code"), F.count(F.lit(1)).alias("count"))
    cover = ql.coverage_issues(on_disk, clips, "clip_id").withColumn("count", F.lit(1).cast("bigint"))
    more = dup.unionByName(gaps).unionByName(beyond).unionByName(cover)
    issues = materialize(shape.unionByName(more.withColumn("severity", ql.severity(F.col("code")))))
    status = materialize(ql.clip_status(clips, issues))
    return {
        "issues": issues, "status": status, "stats": ql.track_stats(boxes), "summary": ql.status_summary(status), "totals": ql.issue_totals(issues),
    }


def validate_to_manifest(
    files: DataFrame, lines: DataFrame, clips: DataFrame, checked: DataFrame, frames: DataFrame, holdout: DataFrame,
    subset_files: DataFrame | None = None, subset_lines: DataFrame | None = None,
) -> Tables:
    """Annotation text, frame files and metadata to issues, report lines and manifest rows; see ``validation.check_clips``."""
    checks = materialize(vl.check_clips(files, lines, clips, checked, frames, subset_files, subset_lines))
    issues = vl.issues_of(checks)
    status = materialize(ql.clip_status(checks.drop(*vl.issue_codes(checks)), issues))
    rows = ql.manifest_rows(status, None, holdout).withColumn("frames_validated", F.coalesce(F.col("frames_checked") > 0, F.lit(False)))
    stats = checks.where("checked_boxes").select("clip_id", *vl.STATS)
    return {
        "issues": issues, "status": status, "lines": ql.validation_lines(status, issues, stats), "summary": ql.status_summary(status),
        "totals": ql.issue_totals(issues), "manifest": rows.drop("checked_boxes", "frames_checked"),
    }


def host_parity(a: DataFrame, b: DataFrame, max_px: float = 5.0) -> Tables:
    """Two hosts' detections of the same clips: whether boxes and scores agree to two digits, matches, differences."""
    frames = ["clip_id", "frame_index"]
    digest = lambda df, name: fi.detection_digests(df, decimals=2)[1].withColumnRenamed("sha256", name)
    same = digest(a, "a").join(digest(b, "b"), "clip_id", "full").select("clip_id", F.col("a").eqNullSafe(F.col("b")).alias("identical"))
    m = materialize(mt.match_hosts(a, b, max_px))
    diffs = m.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("matched"), F.max("score_difference").alias("score_max"), F.max("distance").alias("box_max_px")
    ).join(quantiles(m, ["clip_id"], "score_difference", {"score_median": 0.5}), "clip_id")
    left = a.join(m.select(*frames, F.col("a_det_id").alias("det_id")), [*frames, "det_id"], "left_anti").select("clip_id", "score")
    right = b.join(m.select(*frames, F.col("b_det_id").alias("det_id")), [*frames, "det_id"], "left_anti").select("clip_id", "score")
    return {"fingerprints": same, "differences": diffs, "unmatched": left.unionByName(right)}


def study_design(candidates: DataFrame, documents: DataFrame, pattern: str, participants: DataFrame, sample_size: int, seed: int = 0) -> Tables:
    """Pool, sample, the two matched sets with practice clips under neutral codes, and every participant's blocks."""
    names = candidates.select(F.col("clip_name").alias("name"))
    shown = ds.documented_names(documents, names, pattern)
    pool = materialize(ds.eligible(candidates, shown))
    chosen = ds.match_sets(ds.stratum_pairs(pool, seed))
    trial = chosen.select(F.explode(F.map_from_arrays(F.array(F.lit("S1"), F.lit("S2")), F.array("names", "names_2"))).alias("clip_set", "names"))
    trial = trial.select("clip_set", F.explode("names").alias("clip_name"))
    return {
        "eligible": pool,
        "sample": ds.stratified_sample(pool, sample_size, seed),
        "sets": chosen,
        "codes": ds.assign_codes(ds.practice_clips(pool, trial, seed + 1), trial, seed + 2),
        "blocks": ds.latin_square(participants),
    }


def operations(jobs: DataFrame, heartbeats: DataFrame, samples: DataFrame, now: Column) -> Tables:
    """Gauges, backlog, problems, histograms and alert conditions."""
    return {
        "gauges": ops.job_gauges(jobs, now),
        "workers": ops.live_workers(heartbeats, now),
        "backlog": ops.backlog(jobs, now),
        "problems": ops.job_problems(jobs, now),
        "durations": ops.duration_histogram(jobs, F.col("seconds"), "pipeline_version"),
        "jobs_failing": ops.range_delta(samples, "series", "ts", "value").where("delta > 0"),
        "backlog_alert": ops.sustained(samples, "series", "ts", F.col("value") > 1800, 300),
    }
