"""Doubles are added in an order that the input fixes."""

from shoalcount.operators import scoring as sc

BOXES = "clip_id bigint, track_id bigint, frame_index bigint, x_min double, y_min double, x_max double, y_max double, score double"


def test_scores_are_added_in_order_of_frames(spark):
    scores = {0: 0.1, 1: 0.2, 2: 0.3, 5000: None, 6000: 0.7}
    rows = [(1, 1, f, 0.0, 0.0, 2.0, 2.0, s) for f, s in scores.items()] + [(1, 2, 0, 0.0, 0.0, 2.0, 2.0, None)]
    boxes = spark.createDataFrame(rows[::-1], BOXES).coalesce(1)
    found = {r["track_id"]: r["mean_score"] for r in sc.path_lengths(boxes, 1.0, 1.0).collect()}
    assert (0.3 + 0.2) + 0.1 != (0.1 + 0.2) + 0.3
    assert found == {1: ((0.1 + 0.2) + 0.3 + 0.7) / 4, 2: None}
    few = sc.path_lengths(boxes.where("frame_index < 3 and track_id = 1"), 1.0, 1.0).first()
    assert few["mean_score"] == ((0.1 + 0.2) + 0.3) / 3
