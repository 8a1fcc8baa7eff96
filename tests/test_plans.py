"""The analyses no registered query runs: they plan, run and have sane results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount import session
from shoalcount.checks import evaluation as ev
from shoalcount.checks import quality as qc
from shoalcount.operators import design as ds
from shoalcount.operators import intervals as iv
from shoalcount.plans import analyses as an
from shoalcount.plans import experiments as ex
from shoalcount.session import materialize


def test_compare_usability_and_design(spark, sf):
    t = an.compare_systems(ev.system(spark, sf, "a"), ev.system(spark, sf, "b"), resamples=20)
    assert t["comparison"].first()["clips"] == ad.clip_counts(spark, sf).count()
    forms = spark.createDataFrame([("P1", "manual", [5, 1] * 5, [10] * 6)], "participant string, condition string, sus array<int>, tlx array<int>")
    actions = spark.createDataFrame([("P1", False, "accept", None)], "participant string, practice boolean, action string, automatic_direction string")
    trials = ad.trials(spark, sf)
    u = an.usability(trials, ad.study_plan(spark, sf), trials.where("false"), forms, actions, resamples=20)
    assert u["questionnaires"].first()["sus"] == 100.0
    assert u["participants"].count() > 0 and u["group_intervals"].count() == 1
    people = trials.select("participant").distinct()
    d = an.study_design(ad.clip_counts(spark, sf), ad.table(spark, sf, "documents").select("text"), ev.DOC, people, 20)
    assert d["sample"].count() == 20 and d["blocks"].count() == 2 * people.count()


def test_reviewed_sample_and_retest(spark, sf):
    labels = materialize(ev.labels(spark, sf))
    events = spark.createDataFrame([(1, "2024-01-01T00:00:00", "x")], "clip long, created_at string, reason string")
    counts = ev.reviewed_clip_counts(spark, sf, labels).withColumns({"ref_right": F.lit(1), "ref_left": F.lit(1)})
    tracks = labels.where("rv = 1").withColumnRenamed("automatic", "direction").select("clip_id", "track_id", "direction", "start_frame", "end_frame", "start_u", "end_u")
    t = an.reviewed_sample(labels.drop("start_frame", "end_frame", "start_u", "end_u"), counts, tracks, events)
    assert t["agreement"].count() == 1 and t["timing"].first()["events"] == 1
    r = an.retest(t["clips"].withColumn("complete", F.lit(True)), t["changes"], events)
    assert r["no_harm"].first()["outcome"].startswith("not evaluable")


def test_operations(spark, sf):
    jobs = ad.service_jobs(spark, sf)
    beats = spark.createDataFrame([("w", "2001-08-01 11:59:30")], "worker_id string, heartbeat_at string").withColumn("heartbeat_at", F.col("heartbeat_at").cast("timestamp"))
    samples = jobs.selectExpr("pipeline_version as series", "created_at as ts", "double(seconds) as value")
    t = an.operations(jobs, beats, samples, qc.now())
    assert t["workers"].first()["live_workers"] == 1
    assert t["gauges"].first()["queue_depth"] == jobs.where("status = 'queued'").count()
    assert t["backlog_alert"].count() >= 0


def test_matched_sets_count_their_strata_and_raise(spark):
    item = "struct<name:string,passages:bigint,seconds:double,error:bigint>"
    rows = [(f"k{i}", (f"a{i}", 1 + i % 2, 20.0, 0), (f"b{i}", 1 + (i + 1) % 2, 20.0, 0)) for i in range(5)]
    best = ds.match_sets(spark.createDataFrame(rows, f"key string, x0 {item}, x1 {item}")).first()
    assert len(best["names"]) == 5 and best["d_pass"] <= 1
    far = [("k0", ("a", 50, 20.0, 0), ("b", 1, 20.0, 0))]
    with pytest.raises(Exception, match="tolerances"):
        ds.match_sets(spark.createDataFrame(far, f"key string, x0 {item}, x1 {item}")).collect()
    with pytest.raises(ValueError, match="0 of 1 strata"):
        ds.match_sets(spark.createDataFrame([("k0", ("a", 5, 20.0, 0), None)], f"key string, x0 {item}, x1 {item}"))


ITEM = "struct<name:string,passages:bigint,seconds:double,error:bigint>"


def clip_pairs(rng, n, spread):
    clip = lambda i, side: (f"{rng.choice('pqrs')}{i}{side}", rng.randrange(1, spread), rng.randrange(150, 450) / 10.0, rng.randrange(spread))
    return [(f"k{i:02}", clip(i, "x"), clip(i, "y")) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_matched_sets_are_the_best_of_all_splits(spark, n):
    rng = random.Random(n)
    rows = clip_pairs(rng, n, 3 if n < 3 else 6)
    limit = sum(x[2] for r in rows for x in r[1:]) * 0.05
    best = None
    for choice in itertools.product((0, 1), repeat=n - 1):
        a = [r[1 + c] for r, c in zip(rows, (0, *choice))]
        b = [r[2 - c] for r, c in zip(rows, (0, *choice))]
        gaps = [abs(sum(x[f] for x in a) - sum(x[f] for x in b)) for f in (1, 2, 3)]
        if gaps[0] <= 2 and gaps[1] <= limit and gaps[2] <= 2:
            found = (round(gaps[0] / 2 + gaps[1] / limit + gaps[2] / 2, 9), [x[0] for x in a])
            best = found if best is None or found < best else best
    df = spark.createDataFrame(rows, f"key string, x0 {ITEM}, x1 {ITEM}")
    if best is None:
        with pytest.raises(ValueError, match="tolerances"):
            ds.match_sets(df)
    else:
        got = ds.match_sets(df).first()
        assert (got["score"], got["names"]) == best and sorted(got["names"] + got["names_2"]) == sorted(x[0] for r in rows for x in r[1:])


def test_forty_strata_are_split(spark):
    rows = clip_pairs(random.Random(0), 40, 9)
    got = ds.match_sets(spark.createDataFrame(rows, f"key string, x0 {ITEM}, x1 {ITEM}")).first()
    odd = sum(x[1] for r in rows for x in r[1:]) % 2, sum(x[3] for r in rows for x in r[1:]) % 2
    assert (got["d_pass"], got["d_err"]) == odd and got["score"] - sum(odd) / 2 < 0.01 and len(set(got["names"])) == len(set(got["names_2"])) == 40


def test_neighbour_counts_match_pairs(spark):
    rng = random.Random(3)
    rows = [("c", i, s, s + rng.randint(0, 300), "right" if i % 3 else None) for i, s in enumerate(rng.randint(0, 5000) for _ in range(200))]
    tracks = spark.createDataFrame(rows, "clip_id string, track_id long, start_frame long, end_frame long, direction string")
    counted = tracks.where("direction is not null")
    got = {r["track_id"]: r["nearby"] for r in iv.nearby_counts(tracks, counted, 7, F.col("direction").isNotNull()).collect()}
    want = {a[1]: sum(b[4] is not None and b[1] != a[1] and b[2] <= a[3] + 7 and b[3] >= a[2] - 7 for b in rows) for a in rows}
    assert got == want


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session, "x")


def test_variants_of_a_plan():
    plan = {
        "base": {"score_threshold": 0.2, "tracker": {"gate_m": 0.6, "min_hits": 2}},
        "variants": {"current": None, "loose": {"tracker": {"gate_m": 0.9, "measurement_noise": 0.1}}, "nested": {"score_threshold": 0.3, "suppression": {"containment": 0.7}}},
    }
    current, loose, nested = ex.pipeline_variants(plan)
    assert (current[0].gate_m, current[0].min_hits, current[0].score_threshold, current[1:]) == (0.6, 2, 0.2, (None, None))
    assert (loose[0].gate_m, loose[0].min_hits, loose[0].measurement_noise) == (0.9, 2, 0.1)
    assert (nested[0].score_threshold, nested[0].gate_m, nested[1:]) == (0.3, 0.6, (None, 0.7))
    wrong = [{"current": {"oops": 1}}, {"current": {"tracker": {"oops": 1}}}, {"current": {"suppression": {"oops": 1}}}, {"current": {"score_threshold": 1}}, {"other": {}}, {}]
    for variants in wrong:
        with pytest.raises(ValueError):
            ex.pipeline_variants({**plan, "variants": variants})
    assert [c.name for c in ex.grid_product(current[0], {"gate_m": [1, 2], "max_age": [3]})] == ["gate_m=1,max_age=3", "gate_m=2,max_age=3"]
