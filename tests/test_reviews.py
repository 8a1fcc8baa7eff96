"""Review log semantics, batch and stream."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from shoalcount.operators import intervals as iv
from shoalcount.operators import reviews as rv
from shoalcount.streaming import jobs as sj

EVENT = "job_id long, event_id long, base_revision long, action string, track_id long, passage_id string, direction string, frame_index long, audit_window int"
ROWS = [
    (1, 1, 0, "accept", 1, None, None, None, None),
    (1, 2, 0, "reject", 1, None, None, None, None),  # stale
    (1, 3, 1, "add_passage", None, None, "right", 5, 0),
    (1, 4, 2, "set_direction", 2, None, "left", None, None),
    (1, 5, 3, "reject", None, "p3", None, None, None),
    (1, 6, 4, "accept", None, "p3", None, None, None),  # passages can only be rejected
    (1, 7, 4, "accept", None, "p9", None, None, None),  # unknown passage
    (1, 8, 4, "accept", 77, None, None, None, None),  # unknown track
    (1, 9, 4, "mark_audited", None, None, None, None, 1),
    (1, 10, 5, "mark_audited", None, None, None, None, 9),  # no such window
    (1, 11, 5, "add_passage", None, None, "left", 500, None),  # beyond the recording
    (1, 12, 5, "mark_unresolved", 1, None, None, None, None),
    (1, 13, 6, "set_direction", 2, None, None, None, None),  # corrected to none
    (2, 14, 0, "reject", 1, None, None, None, None),
]
ACCEPTED = {1: 1, 3: 2, 4: 3, 5: 4, 9: 5, 12: 6, 13: 7, 14: 1}


def tables(spark):
    events = spark.createDataFrame(ROWS, EVENT)
    tracks = spark.createDataFrame(
        [(1, 1, "right", 0, 10), (1, 2, None, 5, 20), (2, 1, "left", 0, 9)], "job_id long, track_id long, direction string, start_frame long, end_frame long"
    )
    jobs = spark.createDataFrame([(1, 100, 2), (2, 100, 0)], "job_id long, num_frames long, audit_windows int")
    return events, tracks, jobs


def test_acceptance_and_reasons(spark):
    events, tracks, jobs = tables(spark)
    got = {r["event_id"]: r for r in rv.fold_reviews(events, tracks, jobs).collect()}
    assert {k: r["resulting_revision"] for k, r in got.items() if r["accepted"]} == ACCEPTED
    assert got[2]["refusal"] == "stale revision"
    assert got[6]["refusal"] == "added passages can only be rejected"
    assert got[7]["refusal"] == "unknown added passage"
    assert got[8]["refusal"] == "unknown track"
    assert got[10]["refusal"] == "audit_window out of range" and got[11]["refusal"] == "frame_index out of range"


def test_state_after_and_counts(spark):
    events, tracks, jobs = tables(spark)
    acc = rv.accepted_events(events, rv.fold_reviews(events, tracks, jobs))
    out = rv.track_outcomes(tracks, rv.track_decisions(acc, tracks))
    got = {(r["job_id"], r["track_id"]): (r["review_state"], r["final_direction"]) for r in out.collect()}
    assert got == {(1, 1): ("unresolved", None), (1, 2): ("corrected", None), (2, 1): ("rejected", None)}
    counts = {r["job_id"]: r for r in rv.reviewed_counts(out, rv.passages(acc)).collect()}
    assert (counts[1]["right"], counts[1]["left"], counts[1]["unresolved"], counts[1]["added_passages"]) == (0, 0, 1, 0)
    early = rv.as_of(acc, F.lit(3))
    then = rv.track_outcomes(tracks, rv.track_decisions(early, tracks)).where("job_id = 1")
    first = rv.reviewed_counts(then, rv.passages(early)).where("job_id = 1").first()
    assert (first["right"], first["left"], first["added_passages"]) == (2, 1, 1)


def test_replay_uses_the_state_at_the_base_revision(spark):
    events, tracks, jobs = tables(spark)
    acc = rv.accepted_events(events, rv.fold_reviews(events, tracks, jobs))
    got = {r["event_id"]: r["counted_nearby"] for r in rv.replay(acc, tracks).collect()}
    assert got == {4: 1, 13: 0}  # track 1 counts at revision 2, is unresolved at revision 6


def test_sums_below_equal_all_pairs(spark):
    rng = random.Random(6)
    points = [(rng.randrange(3), rng.randrange(300), rng.randrange(40), rng.choice([1, -1])) for _ in range(400)]
    probes = [(rng.randrange(4), i, rng.randrange(-20, 400), rng.randrange(45)) for i in range(150)]
    got = iv.sums_below(
        spark.createDataFrame(points, "k long, x long, at long, weight long"), spark.createDataFrame(probes, "k long, probe long, y long, at long"), "k"
    )
    got = {r["probe"]: r["total"] for r in got.collect()}
    for k, i, y, at in probes:
        assert got.get(i, 0) == sum(w for pk, x, pat, w in points if pk == k and x < y and pat <= at)


def test_report_sections_join_to_one_document(spark, tmp_path):
    events, tracks, jobs = tables(spark)
    acc = rv.as_of(rv.accepted_events(events, rv.fold_reviews(events, tracks, jobs)), F.lit(6))
    outcomes, added = rv.track_outcomes(tracks, rv.track_decisions(acc, tracks)), rv.passages(acc)
    windows = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 50, 60)], "job_id long, audit_window int, start_frame long, stop_frame long")
    audit = rv.audit_windows_view(windows, rv.audits(acc), added)
    totals = rv.audit_totals(audit, spark.createDataFrame([(1, 80)], "job_id long, unflagged_frames long"))
    headers = spark.createDataFrame([(1, "right"), (2, None)], "job_id long, upstream string").select(
        "job_id", "upstream", F.struct(F.lit(10.0).alias("framerate"), F.lit(100).alias("num_frames")).alias("recording"),
        F.struct(F.col("upstream").alias("upstream_direction")).alias("counting"), F.struct(F.lit("v1").alias("pipeline_version")).alias("pipeline"), F.struct("job_id").alias("job"),
    )
    automatic = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "job_id long, right long, left long")
    out = str(tmp_path / "reports")
    rv.write_reports(rv.report_text(rv.report_sections(headers, automatic, outcomes, added, audit, totals, acc)), out)
    lines = spark.read.schema("job_id long, section int, place long, label string, text string").json(out).collect()
    docs = {j: json.loads("".join(r["text"] for r in sorted(lines, key=lambda r: tuple(r)[1:4]) if r["job_id"] == j)) for j in (1, 2)}
    one, two = docs[1], docs[2]
    assert list(one) == ["report_version", *rv.SECTIONS] and one["recording"] == {"framerate": 10.0, "num_frames": 100}
    assert one["revision"] == 6 and one["revision_kind"] == "reviewed" and [e["event_id"] for e in one["review_events"]] == [1, 3, 4, 5, 9, 12]
    assert one["counts"]["automatic"] == {"right": 1, "left": 0, "upstream": 1, "downstream": 0, "net_upstream": 1}
    assert (one["counts"]["reviewed"]["left"], one["counts"]["reviewed"]["downstream"], one["counts"]["reviewed"]["unresolved"]) == (1, 1, 1)
    assert [t["track_id"] for t in one["tracks"]] == [1, 2] and one["unresolved"] == [one["tracks"][0]]
    assert one["tracks"][1]["final_river_direction"] == "downstream" and one["tracks"][1]["end_time_s"] == 2.0
    assert one["added_passages"] == [{"passage_id": "p3", "state": "rejected", "direction": "right", "river_direction": "upstream", "frame_index": 5, "time_s": 0.5}]
    assert [(w["audit_window"], w["state"]) for w in one["audit_windows"]] == [(0, "pending"), (1, "checked")] and one["audit"]["checked_frames"] == 10
    assert two["added_passages"] == [] == two["audit_windows"] and two["counts"]["automatic"]["upstream"] is None and "audit" not in two


def test_stream_equals_batch_across_batches(spark, tmp_path):
    events, tracks, jobs = tables(spark)
    prepared = rv.prepare(events, tracks, jobs)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    Path(src).mkdir()
    stream = sj.fold_review_stream(spark.readStream.schema(prepared.schema).parquet(src))
    for lo, hi in ((0, 4), (4, 9), (9, 20)):
        prepared.where(f"event_id > {lo} and event_id <= {hi}").coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(rv.fold_reviews(events, tracks, jobs).collect())
