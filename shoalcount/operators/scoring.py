"""Track features, review score, triage and the review queue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.functions import geometry as g
from shoalcount.operators.matching import near_pairs
from shoalcount.operators.ordered import position, running

# Component names in their declared order, and the floor used in the mean.
# Score components, bounds, ranks and calibrated defaults.
COMPONENTS = ("detection", "duration", "continuity", "motion", "separation", "line_distance")
COMPONENT_FLOOR = 0.01
CROWDING_IOU = 0.1
TRIAGE_RANK = {"unresolved": 0, "needs_review": 1, "suggested": 2}


@dataclass(frozen=True)
class ReviewConfig:
    suggest_threshold: float = 0.6
    unresolved_straightness: float = 0.3
    unresolved_line_margin: float = 0.02
    candidate_line_margin: float = 0.05
    candidate_min_observations: int = 5


@dataclass(frozen=True)
class Calibration:
    version: str = "review-v0"
    review: ReviewConfig = ReviewConfig()
    audit_fraction: float = 0.1
    audit_window_s: float = 5.0
    audit_margin_s: float = 1.0


CALIBRATIONS = {"review-v0": Calibration()}


def crowded_frames(boxes: DataFrame) -> DataFrame:
    """Frames per track in which another track's box overlaps with IoU > 0.1."""
    frame = ["clip_id", "frame_index"]
    slim = boxes.select(*frame, "track_id", *g.EDGES)
    pairs = near_pairs(slim, slim, frame).where(
        (F.col("a_track_id") != F.col("b_track_id")) & (g.iou(g.box("a_"), g.box("b_")) > CROWDING_IOU)
    )
    crowded = pairs.select(*frame, F.col("a_track_id").alias("track_id")).distinct()
    return crowded.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("crowded"))


def path_lengths(boxes: DataFrame, mx: Column | float, my: Column | float, block: int = 1024) -> DataFrame:
    """Path length, net displacement (metres) and score statistics per track.

    A track is cut into blocks of frames. Inside a block (at most one box per frame) the steps
    are added up on a sorted array; between blocks only the first and last centres meet. So
    the boxes shuffle once, and one endless track is still many small groups. Doubles are added in
    order of frames and blocks, so the sums do not hang on the order in which rows arrive. Boxes
    without a score do not count in the mean.
    """
    cx, cy = g.center_m(g.box(), F.lit(mx), F.lit(my))
    point = F.struct(F.col("frame_index").alias("f"), cx.alias("x"), cy.alias("y"), F.col("score").cast("double").alias("s"))
    keys = ["clip_id", "track_id"]
    blocks = boxes.groupBy(*keys, F.floor(F.col("frame_index") / block).alias("blk")).agg(
        F.sort_array(F.collect_list(point)).alias("pts"),
        F.count("score").alias("scored"),
        F.min("score").alias("min_score"),
    )
    step = "sqrt((pts[i].x-pts[i-1].x)*(pts[i].x-pts[i-1].x)+(pts[i].y-pts[i-1].y)*(pts[i].y-pts[i-1].y))"
    inner = F.expr(
        f"if(size(pts) < 2, 0D, aggregate(transform(sequence(1, size(pts) - 1), i -> {step}), 0D, (a, v) -> a + v))"
    )
    score_sum = F.aggregate(F.col("pts"), F.lit(0.0), lambda total, p: total + F.coalesce(p["s"], F.lit(0.0)))
    slim = blocks.select(
        *keys, "blk", inner.alias("inner"), F.element_at("pts", 1).alias("a"), F.element_at("pts", -1).alias("b"),
        score_sum.alias("score_sum"), "scored", "min_score",
    )
    prev = F.lag("b").over(Window.partitionBy(*keys).orderBy("blk"))
    dist = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    joined = slim.withColumn("prev", prev).withColumn("seam", F.coalesce(dist(F.col("a"), F.col("prev")), F.lit(0.0)))
    part = F.struct("blk", "score_sum", (F.col("inner") + F.col("seam")).alias("path"))
    total = lambda field: F.aggregate(F.col("parts"), F.lit(0.0), lambda t, p: t + p[field])
    out = joined.groupBy(*keys).agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.sum("scored").alias("scored"),
        F.min("min_score").alias("min_score"),
        F.min_by("a", "blk").alias("a"),
        F.max_by("b", "blk").alias("b"),
    )
    mean = total("score_sum") / F.nullif("scored", F.lit(0))
    return out.select(*keys, mean.alias("mean_score"), "min_score", total("path").alias("path_m"), dist(F.col("b"), F.col("a")).alias("net_m"))


def track_features(boxes: DataFrame, counts: DataFrame, mx: Column | float, my: Column | float, line: float = 0.5) -> DataFrame:
    """Review features of every track; ``counts`` are the counting rule's rows."""
    keys = ["clip_id", "track_id"]
    out = counts.join(path_lengths(boxes, mx, my), keys).join(crowded_frames(boxes), keys, "left")
    n, span = F.col("observations"), F.col("end_frame") - F.col("start_frame") + 1
    return out.select(
        *counts.columns, "mean_score", "min_score",
        span.alias("span_frames"),
        (F.lit(1.0) - n / span).alias("gap_fraction"),
        F.when(F.col("path_m") > 0, F.col("net_m") / F.col("path_m")).otherwise(F.lit(1.0)).alias("straightness"),
        (F.coalesce("crowded", F.lit(0)) / n).alias("crowding"),
        F.least(F.abs(F.col("start_u") - line), F.abs(F.col("end_u") - line)).alias("line_margin"),
        F.col("direction").isNotNull().alias("is_passage"),
    )


def _components() -> dict[str, Column]:
    c, one = F.col, F.lit(1.0)
    return {
        "detection": g.ramp(c("mean_score"), 0.2, 0.6),
        "duration": g.ramp(c("observations"), 3, 15),
        "continuity": one - g.ramp(c("gap_fraction"), 0.0, 0.5),
        "motion": F.least(F.greatest(c("straightness"), F.lit(0.0)), one),
        "separation": one - F.least(F.greatest(c("crowding"), F.lit(0.0)), one),
        "line_distance": g.ramp(c("line_margin"), 0.0, 0.15),
    }


def review(features: DataFrame, config: ReviewConfig = ReviewConfig()) -> DataFrame:
    """Add ``review_score`` (floored geometric mean), ``triage`` and ``review_reasons``."""
    comps = _components()
    logs = [F.log(F.greatest(comps[c], F.lit(COMPONENT_FLOOR))) for c in COMPONENTS]
    mean = logs[0]
    for term in logs[1:]:
        mean = mean + term
    scored = features.withColumn("review_score", F.exp(mean / len(COMPONENTS)))
    margin, passage = F.col("line_margin"), F.col("is_passage")
    special = (
        F.when(passage & (F.col("straightness") < config.unresolved_straightness), "back_and_forth")
        .when(passage & (margin < config.unresolved_line_margin), "endpoint_on_line")
        .when(
            ~passage & (margin < config.candidate_line_margin) & (F.col("observations") >= config.candidate_min_observations),
            "possible_missed_passage",
        )
    )
    scored = scored.withColumn("__special", special)
    triage = (
        F.when(F.col("__special").isin("back_and_forth", "endpoint_on_line"), "unresolved")
        .when(F.col("__special").isNotNull(), "needs_review")
        .when(passage & (F.col("review_score") < config.suggest_threshold), "needs_review")
        .otherwise("suggested")
    )
    weak = [F.when(comps[c] < 0.5, c) for c in COMPONENTS]
    reasons = F.array_compact(F.array(F.col("__special"), *weak))
    return scored.withColumn("triage", triage).withColumn("review_reasons", reasons).drop("__special")


def is_flagged() -> Column:
    """Tracks a reviewer already sees: passages, and anything not merely suggested."""
    return F.col("is_passage") | (F.col("triage") != "suggested")


def triage_rank(triage: Column) -> Column:
    rank = F.lit(len(TRIAGE_RANK))
    for name, value in TRIAGE_RANK.items():
        rank = F.when(triage == name, value).otherwise(rank)
    return rank


def queue_order(tie: Sequence[str] = ("track_id",)) -> list[Column]:
    """Triage rank (none last), passages first, lowest score (null last), then ``tie``."""
    return [
        triage_rank(F.col("triage")).asc(),
        F.when(F.col("direction").isNull(), 1).otherwise(0).asc(),
        F.col("review_score").asc_nulls_last(),
        *[F.col(t) for t in tie],
    ]


def _queue_bucket() -> Column:
    tier = triage_rank(F.col("triage")) * 2 + F.when(F.col("direction").isNull(), 1).otherwise(0)
    return tier * 256 + F.coalesce(F.floor(F.col("review_score") * 200), F.lit(255))


def queue_position(tracks: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """``queue_rank`` (0-based) of every track in its recording's review queue."""
    return position(tracks, list(keys), _queue_bucket(), queue_order(), "queue_rank")


def by_start_position(tracks: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """The order without triage: start frame, then track."""
    order = [F.col("start_frame"), F.col("track_id")]
    return position(tracks, list(keys), F.floor(F.col("start_frame") / 64), order, "queue_rank")


def page(tracks: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page in order. The limit is the feature; Spark keeps only offset + limit rows per task."""
    return tracks.orderBy(*order).offset(offset).limit(limit)


def page_with_total(tracks: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """:func:`page` with ``total``, the number of tracks of all pages; no row beyond the last page."""
    total = tracks.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(tracks, order, offset, limit).join(F.broadcast(total))


def next_unreviewed(ranked: DataFrame, current: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """The first unreviewed track after the current one, circularly in queue order.

    ``current`` has (keys, track_id); ``ranked`` has queue_rank and review_state.
    """
    keys = list(keys)
    open_ = F.col("review_state") == "automatic"
    order = ranked.select(*keys, "track_id", "queue_rank", (-F.col("queue_rank")).alias("__neg"), open_.alias("__open"))
    # from the last rank backwards, the latest open one seen is the next one ahead
    ahead = running(
        order, keys, F.floor(F.col("__neg") / 1024), [F.col("__neg")], F.when(F.col("__open"), F.col("__neg")), "__ahead", fn="max", exclusive=True
    )
    first = order.where("__open").groupBy(*keys).agg(F.min("queue_rank").alias("__first"))
    at = current.join(ahead.select(*keys, "track_id", "__ahead"), [*keys, "track_id"]).join(first, keys)
    at = at.select(*keys, F.col("track_id").alias("after_track"), F.coalesce(-F.col("__ahead"), F.col("__first")).alias("queue_rank"))
    return at.join(order.select(*keys, "queue_rank", F.col("track_id").alias("next_track")), [*keys, "queue_rank"]).select(*keys, "after_track", "next_track")
