"""Box and track matching between two sources, and one-to-one error attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.functions import geometry as g
from shoalcount.session import materialize, materialize_counted

CELL_PX = 64

REFERENCE_OUTCOMES = (
    "counted", "wrong_direction", "missed_fish", "merged_track", "split_track", "ambiguous_start_end", "partial_track",
)
PREDICTED_OUTCOMES = ("counted", "duplicate", "wrong_direction", "background", "non_passing_fish")
DIRECTIONS = ("right", "left", "none")


def _cell(value: Column, cell: int) -> Column:
    return F.floor(value / F.lit(float(cell)))


def _gridded(df: DataFrame, prefix: str, cell: int, pad: float) -> DataFrame:
    xs = F.sequence(_cell(F.col(f"{prefix}x_min") - pad, cell), _cell(F.col(f"{prefix}x_max") + pad, cell))
    ys = F.sequence(_cell(F.col(f"{prefix}y_min") - pad, cell), _cell(F.col(f"{prefix}y_max") + pad, cell))
    return df.withColumn("__gx", F.explode(xs)).withColumn("__gy", F.explode(ys))


def near_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], cell: int = CELL_PX, pad: float = 0.0) -> DataFrame:
    """Pairs of boxes of the same frame that may touch, each once.

    Boxes are spread over the grid cells they cover and joined on (frame, cell), so a crowded
    frame is split over its cells instead of being paired with itself. A pair is kept only in
    the cell of its intersection's upper-left corner. A box takes as many cells as it covers. ``pad`` widens both boxes, for distance
    rather than overlap conditions.
    """

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(prefix + c) for c in df.columns if c not in on])

    a = _gridded(named(left, "a_"), "a_", cell, pad)
    b = _gridded(named(right, "b_"), "b_", cell, pad)
    joined = a.join(b, [*on, "__gx", "__gy"])
    home_x = _cell(F.greatest("a_x_min", "b_x_min") - pad, cell)
    home_y = _cell(F.greatest("a_y_min", "b_y_min") - pad, cell)
    return joined.where((F.col("__gx") == home_x) & (F.col("__gy") == home_y)).drop("__gx", "__gy")


def overlap_join(
    left: DataFrame, right: DataFrame, min_iou: float, on: Sequence[str] = ("clip_id", "frame_index")
) -> DataFrame:
    """Same-frame pairs with IoU >= ``min_iou`` (> 0)."""
    pairs = near_pairs(left, right, on).withColumn("iou", g.iou(g.box("a_"), g.box("b_")))
    return pairs.where(F.col("iou") >= min_iou)


def shared_frames(reference: DataFrame, predicted: DataFrame, iou: float = 0.3) -> DataFrame:
    """(clip, reference track, predicted track, frames in which their boxes overlap)."""
    cols = ["clip_id", "frame_index", "track_id", *g.EDGES]
    pairs = overlap_join(reference.select(*cols), predicted.select(*cols), iou)
    return pairs.groupBy("clip_id", F.col("a_track_id").alias("ref_id"), F.col("b_track_id").alias("pred_id")).agg(
        F.count(F.lit(1)).alias("shared")
    )


def match_tracks(reference: DataFrame, predicted: DataFrame, iou: float = 0.3, min_shared: int = 3) -> DataFrame:
    return shared_frames(reference, predicted, iou).where(F.col("shared") >= min_shared)


def match_features(matches: DataFrame, ref_counts: DataFrame, pred_counts: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """The match relation with both sides' decisions and the one-to-one attribution.

    ``attributed`` marks, per predicted passage, the same-direction reference passage it
    shares most frames with (ties: smaller reference); ``place`` ranks the predicted passages
    attributed to one reference (ties: smaller prediction).
    """
    r = ref_counts.select(*keys, F.col("track_id").alias("ref_id"), F.col("direction").alias("ref_dir"))
    p = pred_counts.select(
        *keys, F.col("track_id").alias("pred_id"), F.col("direction").alias("pred_dir"),
        F.col("start_u").alias("pred_u0"), F.col("end_u").alias("pred_u1"),
    )
    m = matches.join(r, [*keys, "ref_id"]).join(p, [*keys, "pred_id"])
    m = m.withColumn("same", F.coalesce(F.col("ref_dir") == F.col("pred_dir"), F.lit(False)))
    by_pred = Window.partitionBy(*keys, "pred_id")
    best = by_pred.orderBy(F.col("same").desc(), F.col("shared").desc(), "ref_id")
    m = m.withColumn("follows", F.count(F.lit(1)).over(by_pred)).withColumn(
        "attributed", F.col("same") & (F.row_number().over(best) == 1)
    )
    by_ref = Window.partitionBy(*keys, "ref_id").orderBy(F.col("attributed").desc(), F.col("shared").desc(), "pred_id")
    return m.withColumn("place", F.row_number().over(by_ref))


def reference_outcomes(
    features: DataFrame, ref_counts: DataFrame, line: float = 0.5, line_margin: float = 0.05, keys: Sequence[str] = ("clip_id",)
) -> DataFrame:
    """Outcome of every reference passage."""
    margin = F.least(F.abs(F.col("pred_u0") - line), F.abs(F.col("pred_u1") - line))
    opposite = F.col("pred_dir").isNotNull() & F.col("ref_dir").isNotNull() & ~F.col("same")
    per_ref = features.groupBy(*keys, F.col("ref_id").alias("track_id")).agg(
        F.bool_or("attributed").alias("counted"),
        F.bool_or(opposite).alias("opposite"),
        F.count(F.lit(1)).alias("matched"),
        F.max("follows").alias("follows"),
        F.min(margin).alias("margin"),
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    outcome = (
        F.when(flag("counted"), "counted")
        .when(flag("opposite"), "wrong_direction")
        .when(F.col("matched").isNull(), "missed_fish")
        .when(F.col("follows") >= 2, "merged_track")
        .when(F.col("matched") >= 2, "split_track")
        .when(F.col("margin") < line_margin, "ambiguous_start_end")
        .otherwise("partial_track")
    )
    passages = ref_counts.where(F.col("direction").isNotNull())
    return passages.join(per_ref, [*keys, "track_id"], "left").select(
        *keys, "track_id", "direction", "start_frame", "end_frame", outcome.alias("outcome")
    )


def predicted_outcomes(features: DataFrame, pred_counts: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Outcome of every predicted passage."""
    per_pred = features.groupBy(*keys, F.col("pred_id").alias("track_id")).agg(
        F.bool_or(F.col("attributed") & (F.col("place") == 1)).alias("counted"),
        F.bool_or(F.col("attributed") & (F.col("place") > 1)).alias("duplicate"),
        F.bool_or(F.col("ref_dir").isNotNull()).alias("passing"),
    )
    outcome = (
        F.when(F.col("passing").isNull(), "background")
        .when(F.col("counted"), "counted")
        .when(F.col("duplicate"), "duplicate")
        .when(F.col("passing"), "wrong_direction")
        .otherwise("non_passing_fish")
    )
    passages = pred_counts.where(F.col("direction").isNotNull())
    return passages.join(per_pred, [*keys, "track_id"], "left").select(
        *keys, "track_id", "direction", "start_frame", "end_frame", outcome.alias("outcome")
    )


def outcome_totals(reference: DataFrame, predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per side and outcome, zero-filled over the declared outcomes."""
    seen = reference.select(*keys, F.lit("reference").alias("side"), "outcome").unionByName(
        predicted.select(*keys, F.lit("predicted").alias("side"), "outcome")
    )
    counted = seen.groupBy(*keys, "side").pivot(
        "outcome", list(dict.fromkeys(REFERENCE_OUTCOMES + PREDICTED_OUTCOMES))
    ).count()
    return counted.na.fill(0)


def direction_confusion(features: DataFrame, ref_counts: DataFrame, pred_counts: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Reference direction x direction of the best-matching prediction, zero-filled.

    Predicted passages that follow no reference track are added in row "none".
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    best = features.groupBy(*keys, F.col("ref_id").alias("track_id")).agg(
        F.max_by(none("pred_dir"), F.struct("shared", -F.col("pred_id"))).alias("predicted")
    )
    of_ref = ref_counts.join(best, [*keys, "track_id"], "left").select(
        none("direction").alias("reference"), none("predicted").alias("predicted")
    )
    followed = features.select(*keys, F.col("pred_id").alias("track_id"))
    stray = pred_counts.where(F.col("direction").isNotNull()).join(followed, [*keys, "track_id"], "left_anti").select(
        F.lit("none").alias("reference"), F.col("direction").alias("predicted")
    )
    return of_ref.unionByName(stray).groupBy("reference").pivot("predicted", list(DIRECTIONS)).count().na.fill(0)


# --- greedy one-to-one matching and suppression -------------------------------------------


#: A group (frame) of up to so many pairs is walked in order by one task, as a stream.
WALKED_PAIRS = 1_000_000


def _settle(
    pairs: DataFrame, group: Sequence[str], walk: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame], DataFrame], limit: int | None = None
) -> DataFrame:
    """Greedy choice over pairs in groups: ``walk`` settles groups of bounded size, one pass in order each.

    Larger groups are never gathered: ``step`` settles in parallel what can be settled at once
    and says what is left ``open``, until that is small enough to be walked. Only counts reach
    the driver.
    """
    limit = WALKED_PAIRS if limit is None else limit
    live, n = materialize_counted(pairs, F.lit(True))
    parts = []
    while n > limit:
        large, k = materialize_counted(live.groupBy(*group).count().where(F.col("count") > limit).select(*group), F.lit(True))
        if not k:
            break
        parts.append(walk(live.join(large, list(group), "left_anti")))
        stepped, n = materialize_counted(step(live.join(large, list(group), "left_semi")), F.col("open"))
        parts.append(stepped.where("not open").drop("open"))
        live = stepped.where("open").drop("open")
    parts.append(walk(live))
    return reduce(DataFrame.unionByName, parts)


def _in_order(group: Sequence[str], choose: Callable[[set, tuple], bool], ends: Sequence[str]):
    """Keep the rows that ``choose`` takes, given what its group took before; rows come sorted by group.

    Held at a time: the identifiers one group has used up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, set()
        for b in batches:
            keys = zip(*[b.column(c).to_pylist() for c in group])
            taken = []
            for i, (key, pair) in enumerate(zip(keys, zip(*[b.column(c).to_pylist() for c in ends]))):
                if key != at:
                    at, used = key, set()
                if choose(used, pair):
                    taken.append(i)
            yield b.take(pa.array(taken, pa.int64()))

    return run


def _free_ends(used: set, pair: tuple) -> bool:
    left, right = (0, pair[0]), (1, pair[1])
    if left in used or right in used:
        return False
    used.update((left, right))
    return True


def _newly_dropped(dropped: set, pair: tuple) -> bool:
    strong, weak = pair
    if strong in dropped or weak in dropped:
        return False
    dropped.add(weak)
    return True


def greedy_match(pairs: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """Greedy one-to-one matching per group in ``order`` (which must be total per group).

    Groups of up to WALKED_PAIRS pairs are walked in order, all in one job. In larger ones a pair
    that is the first choice of both its ends is exactly what the greedy pass takes next among
    their pairs, so all such pairs are taken together and the pairs they block are dropped, round
    by round.
    """
    l_key, r_key = [*group, left], [*group, right]

    def round_(df: DataFrame) -> DataFrame:
        rank_l = F.row_number().over(Window.partitionBy(*l_key).orderBy(*order))
        rank_r = F.row_number().over(Window.partitionBy(*r_key).orderBy(*order))
        live = df.withColumn("__rl", rank_l).withColumn("__rr", rank_r)
        live = live.withColumn("__take", (F.col("__rl") == 1) & (F.col("__rr") == 1))
        live = live.withColumn("__bl", F.max("__take").over(Window.partitionBy(*l_key)))
        live = live.withColumn("__br", F.max("__take").over(Window.partitionBy(*r_key)))
        live = live.where(F.col("__take") | ~(F.col("__bl") | F.col("__br")))
        return live.select(*df.columns, (~F.col("__take")).alias("open"))

    def walk(df: DataFrame) -> DataFrame:
        sorted_ = df.repartition(*group).sortWithinPartitions(*group, *order)
        return sorted_.mapInArrow(_in_order(group, _free_ends, (left, right)), df.schema)

    return _settle(pairs, group, walk, round_)


def suppress_overlaps(
    boxes: DataFrame, iou: float | None = None, containment: float | None = None,
    frame: Sequence[str] = ("clip_id", "frame_index"), det: str = "det_id",
) -> DataFrame:
    """Drop boxes that duplicate a kept, higher-scoring box of the same frame.

    Equal scores are ordered by ``det``. Only boxes that overlap another one take part: their
    overlaps are walked from the strongest box of a frame on, all frames in one job. In frames of
    more than WALKED_PAIRS overlaps, boxes with no open stronger neighbour are kept and their weaker
    neighbours dropped, round by round.
    """
    if iou is None and containment is None:
        return boxes
    slim = boxes.select(*frame, det, "score", *g.EDGES)
    test = F.lit(False)
    a, b = g.box("a_"), g.box("b_")
    if iou is not None:
        test = test | (g.iou(a, b) > iou)
    if containment is not None:
        test = test | (g.containment(a, b) > containment)
    stronger = (F.col("a_score") > F.col("b_score")) | (
        (F.col("a_score") == F.col("b_score")) & (F.col(f"a_{det}") < F.col(f"b_{det}"))
    )
    edges = near_pairs(slim, slim, frame).where(stronger & test).select(
        *frame, F.col(f"a_{det}").alias("strong"), F.col(f"b_{det}").alias("weak"), F.col("a_score").alias("score")
    )
    key = lambda c: [*frame, c]

    def round_(live: DataFrame) -> DataFrame:
        weak_ends = live.select(*frame, F.col("weak").alias("node")).distinct()
        # strong ends that are nobody's weak end are kept now
        kept = live.select(*frame, F.col("strong").alias("node")).distinct().join(weak_ends, key("node"), "left_anti")
        hit = live.join(kept.withColumnRenamed("node", "strong"), key("strong"), "left_semi")
        dropped = hit.select(*frame, F.col("weak").alias("node")).distinct()
        lost = dropped.select(*frame, F.col("node").alias("strong"), F.col("node").alias("weak"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("open"))
        rest = live.join(dropped.withColumnRenamed("node", "weak"), key("weak"), "left_anti").join(
            dropped.withColumnRenamed("node", "strong"), key("strong"), "left_anti"
        )
        return lost.unionByName(rest.withColumn("open", F.lit(True)))

    def walk(live: DataFrame) -> DataFrame:
        sorted_ = live.repartition(*frame).sortWithinPartitions(*frame, F.col("score").desc(), "strong", "weak")
        return sorted_.mapInArrow(_in_order(frame, _newly_dropped, ("strong", "weak")), live.schema)

    dropped = _settle(edges, frame, walk, round_).select(*frame, F.col("weak").alias(det)).distinct()
    return boxes.join(dropped, [*frame, det], "left_anti")


def match_detections(
    reference: DataFrame, detected: DataFrame, min_iou: float = 0.3, frame: Sequence[str] = ("clip_id", "frame_index")
) -> DataFrame:
    """Greedy same-frame matches in falling IoU (ties: smaller IDs): one row per match."""
    pairs = overlap_join(reference.select(*frame, "track_id", *g.EDGES), detected.select(*frame, "det_id", *g.EDGES), min_iou, frame)
    pairs = pairs.select(*frame, F.col("a_track_id").alias("track_id"), F.col("b_det_id").alias("det_id"), "iou")
    return greedy_match(pairs, frame, "track_id", "det_id", [F.col("iou").desc(), F.col("track_id"), F.col("det_id")])


def detection_summary(reference: DataFrame, detected: DataFrame, matches: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Matched, reference and detected boxes with recall and precision (null when undefined)."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = side(reference, "reference_boxes").join(side(detected, "detections"), list(keys), "full")
    out = out.join(side(matches, "matched"), list(keys), "left").na.fill(0)
    part = lambda d: F.col("matched").cast("double") / F.nullif(F.col(d), F.lit(0)).cast("double")
    return out.withColumn("recall", part("reference_boxes")).withColumn("precision", part("detections"))


def recall_by_size(
    reference: DataFrame, detected: DataFrame, m2_per_px: Column, bins: Sequence[float], min_iou: float = 0.3
) -> DataFrame:
    """Reference boxes per physical size bin and how many of them a detection overlaps.

    Edges belong to the upper bin. A box is found when any detection reaches ``min_iou``.
    """
    frame = ["clip_id", "frame_index"]
    hits = overlap_join(reference.select(*frame, "track_id", *g.EDGES), detected.select(*frame, *g.EDGES), min_iou)
    hits = hits.groupBy(*frame, F.col("a_track_id").alias("track_id")).agg(F.lit(1).alias("found"))
    size = g.area(g.box()) * m2_per_px
    index = F.lit(0)
    for edge in bins:
        index = index + F.when(size >= edge, 1).otherwise(0)
    return (
        reference.join(hits, [*frame, "track_id"], "left")
        .groupBy(index.alias("size_bin"))
        .agg(F.count(F.lit(1)).alias("reference_boxes"), F.count("found").alias("found"))
        .withColumn("recall", F.col("found").cast("double") / F.col("reference_boxes"))
    )


def match_hosts(a: DataFrame, b: DataFrame, max_px: float, frame: Sequence[str] = ("clip_id", "frame_index")) -> DataFrame:
    """Match two hosts' detections of the same frames by largest edge distance <= ``max_px``."""
    cols = [*frame, "det_id", "score", *g.EDGES]
    near = near_pairs(a.select(*cols), b.select(*cols), frame, pad=max_px)
    near = near.withColumn("distance", g.corner_distance(g.box("a_"), g.box("b_"))).where(F.col("distance") <= max_px)
    near = near.select(
        *frame, "a_det_id", "b_det_id", "distance", F.abs(F.col("a_score") - F.col("b_score")).alias("score_difference")
    )
    return greedy_match(near, frame, "a_det_id", "b_det_id", [F.col("distance"), F.col("a_det_id"), F.col("b_det_id")])
