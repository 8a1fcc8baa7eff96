"""The counting rule's truth table, metamorphic checks and error measures."""

import pytest
from pyspark.sql import functions as F

from shoalcount.operators import boxes as bx
from shoalcount.operators import counting as ct

W, H = 200, 100
SCHEMA = "clip_id long, track_id long, frame_index long, x_min double, y_min double, x_max double, y_max double"


def boxes(spark, tracks):
    """tracks: {id: [(frame, u)] or [(frame, u, v)]}, 10 x 10 boxes centred there."""
    rows = []
    for track, points in tracks.items():
        for p in points:
            frame, u, v = (*p, 0.5)[:3]
            rows.append((1, track, frame, u * W - 5, v * H - 5, u * W + 5, v * H + 5))
    return spark.createDataFrame(rows, SCHEMA)


CASES = {
    "right": ([(0, 0.2), (5, 0.4), (10, 0.8)], "right"),
    "left": ([(0, 0.9), (5, 0.6), (10, 0.1)], "left"),
    "stationary across the line": ([(0, 0.49), (30, 0.51)], None),
    "retreat": ([(0, 0.2), (5, 0.45), (10, 0.2)], None),
    "cross and return": ([(0, 0.2), (5, 0.8), (10, 0.3)], None),
    "gap ignored": ([(0, 0.2), (90, 0.8)], "right"),
    "end exactly on the line": ([(0, 0.2), (9, 0.5)], "right"),
    "start exactly on the line": ([(0, 0.5), (9, 0.8)], None),
    "leaves from the line": ([(0, 0.5), (9, 0.2)], "left"),
    "single box": ([(0, 0.5)], None),
    "unordered rows": ([(10, 0.8), (0, 0.2), (5, 0.4)], "right"),
    "vertical movement counts as displacement": ([(0, 0.495, 0.2), (9, 0.505, 0.3)], "right"),
}


def test_truth_table(spark):
    names = list(CASES)
    df = ct.count_trajectories(boxes(spark, {i: CASES[n][0] for i, n in enumerate(names)}), W, H)
    got = {names[r["track_id"]]: r["direction"] for r in df.collect()}
    assert got == {n: CASES[n][1] for n in names}


def test_policy_parameters(spark):
    tracks = boxes(spark, {1: [(0, 0.2), (9, 0.4)], 2: [(0, 0.49), (9, 0.51)]})
    moved = ct.CountingPolicy("x", line_x_normalized=0.3)
    assert {r["direction"] for r in ct.count_trajectories(tracks.where("track_id=1"), W, H, moved).collect()} == {"right"}
    free = ct.CountingPolicy("y", min_displacement_normalized=0.0)
    assert {r["direction"] for r in ct.count_trajectories(tracks.where("track_id=2"), W, H, free).collect()} == {"right"}
    assert ct.is_benchmark_compatible(ct.DEFAULT_POLICY) and not ct.is_benchmark_compatible(moved)
    with pytest.raises(ValueError):
        ct.CountingPolicy("z", line_x_normalized=1.0)


def test_two_boxes_in_a_frame_raise(spark):
    dup = boxes(spark, {1: [(0, 0.2), (0, 0.3), (5, 0.8)]})
    with pytest.raises(Exception, match="more than one box"):
        ct.count_trajectories(dup, W, H, check=True).collect()
    assert [r["n"] for r in ct.duplicate_frames(dup).collect()] == [2]


def test_mirror_swaps_directions_and_mot_round_trip(spark):
    b = boxes(spark, {1: [(0, 0.2), (9, 0.8)], 2: [(0, 0.9), (9, 0.1)], 3: [(0, 0.8), (9, 0.1)]})
    straight = ct.tally(ct.count_trajectories(b, W, H)).first()
    flipped = ct.tally(ct.count_trajectories(bx.flip_horizontal(b, W), W, H)).first()
    assert (straight["right"], straight["left"]) == (flipped["left"], flipped["right"]) == (1, 2)
    back = bx.mot_to_internal(bx.internal_to_mot(b)).select(*b.columns)
    assert sorted(back.collect()) == sorted(b.collect())


def pairs(spark, rows):
    return spark.createDataFrame(rows, "location string, ref_right long, ref_left long, pred_right long, pred_left long, duration_s double")


def test_errors_are_not_netted_and_undefined_groups_are_null(spark):
    p = pairs(spark, [("a", 3, 1, 1, 3, 1800.0), ("b", 0, 0, 2, 0, 3600.0), ("c", 2, 2, 2, 1, 60.0)])
    got = {r["location"]: r for r in ct.summarize(p, "location").collect()}
    assert got["a"]["absolute_error"] == 4 and got["a"]["nmae"] == 1.0
    assert got["b"]["nmae"] is None and got["b"]["predicted_per_hour"] == 2.0
    assert ct.macro_nmae(ct.summarize(p, "location")).first()["macro_nmae"] == pytest.approx((1.0 + 0.25) / 2)


def test_missing_prediction_and_box_outside_clip_raise(spark):
    b = boxes(spark, {1: [(0, 0.2), (9, 0.8)]})
    clips = spark.createDataFrame([(1, 10, W, H, 10.0)], "clip_id long, num_frames long, width int, height int, framerate double")
    none = b.where("false")
    ok = ct.evaluate_predictions(clips, b, none, clips).first()
    assert (ok["ref_right"], ok["pred_right"]) == (1, 0)
    with pytest.raises(Exception, match="no prediction"):
        ct.evaluate_predictions(clips, b, none, clips.where("false")).collect()
    with pytest.raises(Exception, match="outside the frames"):
        ct.count_clips(b, clips.withColumn("num_frames", F.lit(5).cast("long"))).collect()
