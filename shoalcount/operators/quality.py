"""Dataset validation: issues per clip, statistics, status, report merge, manifest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.functions import names as nm
from shoalcount.operators.boxes import box_issue
from shoalcount.operators.ordered import islands, previous
from shoalcount.session import materialize

MAX_EXAMPLES = 5
# Codes that warn; every other code quarantines the clip.
WARNING_CODES = (
    "box_partially_outside_image",
    "image_size_differs_slightly",
    "unexpected_file",
    "missing_tiny_annotations",
    "no_boxes_in_window",
)


def severity(code: Column) -> Column:
    return F.when(code.isin(*WARNING_CODES), "warning").otherwise("error")


def collect_issues(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], example: Column) -> DataFrame:
    """Rows with a ``code`` as issues: count and the first five examples in order.

    Counts use a plain aggregate; examples go through a per-group top five, which Spark cuts
    on both sides of the shuffle. The cap is the report format, the counts are complete.
    """
    keys = list(keys)
    found = rows.where("code is not null").withColumn("example", example)
    counts = found.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys, "code").orderBy(*order))
    top = found.withColumn("r", rank).where(F.col("r") <= MAX_EXAMPLES)
    examples = top.groupBy(*keys, "code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "example"))), lambda x: x["example"]).alias("examples")
    )
    return counts.join(examples, [*keys, "code"]).withColumn("severity", severity(F.col("code")))


def coverage_issues(on_disk: DataFrame, metadata: DataFrame, key: str = "clip_name") -> DataFrame:
    """Clips without metadata, and metadata without annotations."""
    a = on_disk.select(key, F.lit(True).alias("a")).distinct()
    b = metadata.select(key, F.lit(True).alias("b")).distinct()
    code = F.when(F.col("b").isNull(), "missing_metadata").when(F.col("a").isNull(), "missing_annotations")
    return a.join(b, key, "full").withColumn("code", code).where("code is not null").select(key, "code")


def describe_box() -> Column:
    return F.format_string(
        "frame_index %d track %d box (%.3f, %.3f, %.3f, %.3f)", "frame_index", "track_id", "x_min", "y_min", "x_max", "y_max"
    )


def box_issues(boxes: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Frame-range issues of all boxes and shape issues of the boxes inside the clip."""
    sized = boxes.join(clips.select(key, "num_frames", "width", "height"), key)
    outside = (F.col("frame_index") < 0) | (F.col("frame_index") >= F.col("num_frames"))
    code = F.when(outside, "frame_out_of_range").otherwise(box_issue(F.col("width"), F.col("height")))
    order = [F.col(c) for c in ("frame_index", "track_id", "x_min", "y_min")]
    return collect_issues(sized.withColumn("code", code), [key], order, describe_box())


def duplicate_issues(boxes: DataFrame, key: str = "clip_id") -> DataFrame:
    """Tracks with several boxes in a frame, by how many too many."""
    per = boxes.groupBy(key, "track_id", "frame_index").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
    return per.groupBy(key).agg(F.lit("duplicate_track_frame").alias("code"), F.sum("extra").alias("count"))


def track_stats(boxes: DataFrame, key: str = "clip_id") -> DataFrame:
    """Boxes, tracks, tracks with gaps, single-box tracks and annotated frames per clip."""
    cells = boxes.groupBy(key, "track_id", "frame_index").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy(key, "track_id").agg(
        F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.count(F.lit(1)).alias("frames"), F.sum("n").alias("boxes")
    )
    stats = per.groupBy(key).agg(
        F.sum("boxes").alias("boxes"), F.count(F.lit(1)).alias("tracks"),
        F.count(F.when(F.col("hi") - F.col("lo") + 1 != F.col("frames"), 1)).alias("tracks_with_gaps"),
        F.count(F.when(F.col("frames") == 1, 1)).alias("single_observation_tracks"),
    )
    frames = cells.select(key, "frame_index").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("annotated_frames"))
    return stats.join(frames, key)


def tracks_cut_by_window(boxes: DataFrame, start: Column, stop: Column, key: str = "clip_id") -> DataFrame:
    """Tracks with boxes both inside and outside the frame window."""
    inside = (F.col("frame_index") >= start) & (F.col("frame_index") < stop)
    per = boxes.groupBy(key, "track_id").agg(F.bool_or(inside).alias("i"), F.bool_or(~inside).alias("o"))
    return per.where("i and o").groupBy(key).agg(F.count(F.lit(1)).alias("tracks_cut_by_window"))


def missing_frames(present: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Runs of frames in [0, num_frames) that have no file.

    Works on the gaps between the runs that exist, so a clip's whole range is never expanded; a
    recording's runs are looked back over in stretches of frames.
    """
    runs = islands(present.select(key, "frame_index").distinct(), [key], "frame_index")
    inside = materialize(runs.join(clips.select(key, "num_frames"), key).where("start < num_frames"))
    back = previous(inside, [key], F.floor(F.col("start") / 4096), [F.col("start")], ["stop"])
    gaps = back.select(key, (F.coalesce("prev_stop", F.lit(-1)) + 1).alias("start"), (F.col("start") - 1).alias("stop"))
    last = inside.groupBy(key).agg(F.max("stop").alias("last"))
    tail = clips.join(last, key, "left").select(
        key, (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("num_frames") - 1).alias("stop")
    )
    return gaps.unionByName(tail).where("start <= stop")


def frames_beyond(present: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    return present.join(clips.select(key, "num_frames"), key).where("frame_index >= num_frames").select(key, "frame_index")


def range_text(start: Column, stop: Column) -> Column:
    return F.when(start == stop, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), stop.cast("string")))


def rows_not_in(subset: DataFrame, full: DataFrame) -> DataFrame:
    """Distinct rows of a subset file absent from the full file; nulls compare equal."""
    cols = subset.columns
    left = subset.distinct().alias("s")
    right = full.select(*cols).distinct().alias("f")
    on = None
    for c in cols:
        same = F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
        on = same if on is None else on & same
    return left.join(right, on, "left_anti")


def clip_status(clips: DataFrame, issues: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """quarantined / warning / ok, with the reasons."""
    keys = list(keys)
    is_error = F.col("severity") == "error"
    codes = issues.select(*keys, "code", "severity").distinct()
    per = codes.groupBy(*keys).agg(
        F.bool_or(is_error).alias("bad"),
        F.array_sort(F.collect_list(F.when(is_error, F.col("code")))).alias("quarantine_reasons"),
        F.array_sort(F.collect_list(F.when(~is_error, F.col("code")))).alias("warning_codes"),
    )
    out = clips.join(per, keys, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns(
        {
            "status": F.when(F.col("bad"), "quarantined").when(F.col("bad").isNotNull(), "warning").otherwise("ok"),
            "quarantine_reasons": F.coalesce("quarantine_reasons", empty),
            "warning_codes": F.coalesce("warning_codes", empty),
        }
    ).drop("bad")


def validation_lines(status: DataFrame, issues: DataFrame, stats: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """One JSON line a clip: location, clip_name, status, quarantine_reasons, issues in order of code, stats or null.

    A clip has one issue per code, so a line is bounded by the codes.
    """
    keys = list(keys)
    entry = F.struct("code", "severity", "count", *[c for c in ("message", "examples") if c in issues.columns])
    per = issues.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("issues"))
    of = stats.select(*keys, F.struct(*[c for c in stats.columns if c not in keys]).alias("stats"))
    j = status.join(per, keys, "left").join(of, keys, "left")
    none = F.array().cast(per.schema["issues"].dataType)
    line = F.struct("location", "clip_name", "status", "quarantine_reasons", F.coalesce("issues", none).alias("issues"), "stats")
    return j.select(*keys, F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


def write_validation_report(lines: DataFrame, path: str, keys: Sequence[str] = ("clip_id",)) -> None:
    """Report lines in order of the clips over files of even size."""
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("errorifexists").text(path)


def status_summary(status: DataFrame) -> DataFrame:
    """Clips per status by location and overall."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return status.rollup("location").agg(F.count(F.lit(1)).alias("clips"), n("ok"), n("warning"), n("quarantined"))


def issue_totals(issues: DataFrame, key: str = "clip_id") -> DataFrame:
    per = issues.groupBy("code", key).agg(F.sum("count").alias("n"))
    return per.groupBy("code").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("clips"))


def merge_reports(clips: DataFrame, claims: DataFrame) -> DataFrame:
    """Each clip from the report that checked its frames, else from the first report.

    ``clips``: (report, clip_id, ...); ``claims``: (report, clip_id). A clip claimed twice raises.
    """
    n = F.count(F.lit(1))
    per = claims.groupBy("clip_id").agg(n.alias("n"), F.min("report").alias("claimed"))
    message = F.concat(F.lit("clip in more than one frames subset: "), F.col("clip_id").cast("string"))
    per = per.select("clip_id", F.when(F.col("n") > 1, F.raise_error(message).cast("int")).otherwise(F.col("claimed")).alias("claimed"))
    j = clips.join(per, "clip_id", "left")
    return j.where(F.col("report") == F.coalesce("claimed", F.lit(0))).drop("claimed")


def manifest_rows(status: DataFrame, stats: DataFrame | None, holdout: DataFrame) -> DataFrame:
    """One manifest row per clip: split, partition, status, parsed name, statistics.

    ``status`` has location, clip_name, status, reasons and metadata columns, and where ``stats``
    is None the statistics too.
    """
    h = holdout.select("clip_name", F.lit(True).alias("__h")).distinct()
    p = nm.parse_clip_name(F.col("clip_name"))
    rows = status if stats is None else status.join(stats, "clip_name", "left")
    rows = rows.join(h, "clip_name", "left")
    rows = rows.withColumns({"official_split": nm.official_split(F.col("location")), "__p": p, "__h": F.coalesce("__h", F.lit(False))})
    message = F.concat(F.lit("holdout clip is not a training clip: "), F.col("clip_name"))
    part = F.when(~F.col("__h"), F.col("official_split")).when(F.col("official_split") == "train", "holdout").otherwise(F.raise_error(message).cast("string"))
    return rows.withColumns(
        {
            "partition": part,
            "tuning_allowed": nm.tuning_allowed(F.col("official_split")) & ~F.col("__h"),
            "usable": F.col("status") != "quarantined",
            "recording_id": F.col("__p.recording_id"),
            "recording_date": F.col("__p.recording_date"),
            "recording_frame_start": F.col("__p.start"),
            "recording_frame_stop": F.col("__p.stop"),
        }
    ).drop("__p", "__h")


def bad_name() -> Column:
    """Whether the name is invalid or covers another number of frames than the metadata says."""
    p = nm.parse_clip_name(F.col("clip_name"))
    return p.isNull() | (p["stop"] - p["start"] != F.col("num_frames"))


def name_issues(clips: DataFrame) -> DataFrame:
    return clips.where(bad_name()).select("clip_name", F.lit("invalid_clip_name").alias("code"))


def image_size_issues(frames: DataFrame, clips: DataFrame, tolerance: int = 1, key: str = "clip_id") -> DataFrame:
    """Frames whose decoded size (image_width, image_height; null = unreadable) differs from
    the metadata, per clip and size."""
    j = frames.join(clips.select(key, "width", "height"), key)
    worst = F.greatest(F.abs(F.col("image_width") - F.col("width")), F.abs(F.col("image_height") - F.col("height")))
    code = (
        F.when(F.col("image_width").isNull(), "unreadable_frame")
        .when(worst == 0, None)
        .when(worst <= tolerance, "image_size_differs_slightly")
        .otherwise("image_size_mismatch")
    )
    return j.withColumn("code", code).where("code is not null").groupBy(key, "code", "image_width", "image_height").agg(
        F.count(F.lit(1)).alias("count")
    )
