"""Row-level box projections and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.functions import geometry as g


def mot_to_internal(df: DataFrame) -> DataFrame:
    """1-based (frame, left, top, w, h) to the 0-based internal convention."""
    x, y = F.col("bb_left") - 1.0, F.col("bb_top") - 1.0
    return df.withColumns(
        {
            "frame_index": F.col("frame") - 1,
            "x_min": x,
            "y_min": y,
            "x_max": x + F.col("bb_width"),
            "y_max": y + F.col("bb_height"),
        }
    ).drop("frame", "bb_left", "bb_top", "bb_width", "bb_height")


def internal_to_mot(df: DataFrame) -> DataFrame:
    """Inverse of :func:`mot_to_internal`."""
    return df.withColumns(
        {
            "frame": F.col("frame_index") + 1,
            "bb_left": F.col("x_min") + 1.0,
            "bb_top": F.col("y_min") + 1.0,
            "bb_width": F.col("x_max") - F.col("x_min"),
            "bb_height": F.col("y_max") - F.col("y_min"),
        }
    ).drop("frame_index", *g.EDGES)


def in_frame_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Half-open frame range; reaches the Parquet scan as a pushed filter."""
    return df.where((F.col("frame_index") >= start) & (F.col("frame_index") < stop))


def above(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("score") >= threshold)


def clip_boxes(df: DataFrame, width: Column | float, height: Column | float, min_px: float | None = None) -> DataFrame:
    """Clip to the frame; drop emptied boxes, or those under ``min_px`` on either side."""
    zero = F.lit(0.0)

    def clamp(name: str, size: Column | float) -> Column:
        return F.least(F.greatest(F.col(name), zero), F.lit(size).cast("double"))

    out = df.withColumns(
        {
            "x_min": clamp("x_min", width),
            "y_min": clamp("y_min", height),
            "x_max": clamp("x_max", width),
            "y_max": clamp("y_max", height),
        }
    )
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return out.where((w > 0) & (h > 0)) if min_px is None else out.where((w >= min_px) & (h >= min_px))


def flip_horizontal(df: DataFrame, width: Column | float) -> DataFrame:
    """Mirror left-right; passage directions swap with it."""
    return df.withColumns({"x_min": F.lit(width) - F.col("x_max"), "x_max": F.lit(width) - F.col("x_min")})


def scale_boxes(df: DataFrame, scale: Column) -> DataFrame:
    """Frame to canvas coordinates (or back, with the reciprocal)."""
    return df.withColumns({e: F.col(e) * scale for e in g.EDGES})


def unscale_boxes(df: DataFrame, scale: Column) -> DataFrame:
    return df.withColumns({e: F.col(e) / scale for e in g.EDGES})


def to_targets(df: DataFrame, max_labels: int, order: str) -> DataFrame:
    """(cx, cy, w, h) rows, the first ``max_labels`` of each frame.

    The cap is the feature: the target tensor has that many slots. Top-k per frame runs as a
    partial top-k before the shuffle, so a crowded frame sends at most k rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id", "frame_index").orderBy(order)
    b = g.box()
    return (
        df.withColumn("slot", F.row_number().over(w))
        .where(F.col("slot") <= max_labels)
        .select(
            "clip_id",
            "frame_index",
            "slot",
            ((b["x_min"] + b["x_max"]) / 2).alias("cx"),
            ((b["y_min"] + b["y_max"]) / 2).alias("cy"),
            (b["x_max"] - b["x_min"]).alias("w"),
            (b["y_max"] - b["y_min"]).alias("h"),
        )
    )


def sample_frames(clips: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th frame of each recording's window, frames without boxes included.

    The window is [frame_start, frame_stop) where the clips have these columns, else the whole recording.
    """
    first = F.coalesce("frame_start", F.lit(0)) if "frame_start" in clips.columns else F.lit(0)
    stop = F.coalesce("frame_stop", "num_frames") if "frame_stop" in clips.columns else F.col("num_frames")
    window = clips.select("clip_id", first.cast("bigint").alias("a"), (stop - 1).cast("bigint").alias("b")).where("a <= b")
    return window.select("clip_id", F.explode(F.sequence("a", "b", F.lit(stride).cast("bigint"))).alias("frame_index"))


def box_issue(width: Column | float, height: Column | float) -> Column:
    """First quality issue of a box (the classes exclude each other), or null."""
    b = g.box()
    return (
        F.when((b["x_max"] <= b["x_min"]) | (b["y_max"] <= b["y_min"]), "non_positive_box_size")
        .when(
            (b["x_max"] <= 0) | (b["y_max"] <= 0) | (b["x_min"] >= width) | (b["y_min"] >= height),
            "box_outside_image",
        )
        .when(
            (b["x_min"] < 0) | (b["y_min"] < 0) | (b["x_max"] > width) | (b["y_max"] > height),
            "box_partially_outside_image",
        )
    )


def physical_size_filter(df: DataFrame, area_px: Column, m2_per_px: Column, lo: float, hi: float) -> DataFrame:
    return df.where((area_px * m2_per_px).between(lo, hi))


def tracks_at(tracks: DataFrame, frame: Column) -> DataFrame:
    """Tracks visible at a frame (both ends inclusive)."""
    return tracks.where((F.col("start_frame") <= frame) & (frame <= F.col("end_frame")))


def windows_at(windows: DataFrame, frame: Column) -> DataFrame:
    """Audit windows containing a frame (half-open)."""
    return windows.where((F.col("start_frame") <= frame) & (frame < F.col("stop_frame")))
