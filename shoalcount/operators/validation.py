"""Validation of whole recordings: annotation text, frame files and metadata to issues and statistics.

Every check is an aggregate per recording. Text is parsed once and its numbers are stored, for
the checks that read them; boxes are read once into (recording, track, frame) cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.operators.boxes import box_issue
from shoalcount.operators.quality import bad_name, coverage_issues, severity
from shoalcount.session import materialize
from shoalcount.sources import mot

KEY = "clip_id"
SHAPES = ("non_positive_box_size", "box_outside_image", "box_partially_outside_image")
ROW = ("frame", "track_id", "bb_left", "bb_top", "bb_width", "bb_height")


def _n() -> Column:
    return F.count(F.lit(1))


def _n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def frame_checks(frames: DataFrame, clips: DataFrame, checked: DataFrame, windowed: bool, tolerance: int = 1) -> DataFrame:
    """One row per checked recording: its frame window, number of frames, and counts of frame and image faults.

    ``frames``: clip_id, frame_index, image_width, image_height, one row a file; a null index
    stands for an empty folder, null sizes for a frame that cannot be decoded. A recording of
    ``checked`` without rows has no folder. ``windowed``: the frames are one stretch of the
    recording instead of all of it.
    """
    # frames opened from recordings are many times what the plan takes them for: never broadcast
    j = checked.select(KEY).distinct().join(clips.select(KEY, "num_frames", "width", "height"), KEY).join(frames.distinct().hint("merge"), KEY, "left")
    index = F.col("frame_index")
    worst = F.greatest(F.abs(F.col("image_width") - F.col("width")), F.abs(F.col("image_height") - F.col("height")))
    unreadable = index.isNotNull() & F.col("image_width").isNull()
    per = j.withColumn("folder", index.isNotNull() | F.coalesce("empty_folder", F.lit(False))).groupBy(KEY).agg(
        F.any_value("num_frames").alias("num_frames"), F.bool_or("folder").alias("folder"), F.count("frame_index").alias("files"),
        F.min(index).alias("lo"), F.max(index).alias("hi"), _n_if(index < F.col("num_frames")).alias("inside"),
        _n_if(index >= F.col("num_frames")).alias("frame_window_out_of_range"), _n_if(unreadable).alias("unreadable_frame"),
        _n_if((worst > 0) & (worst <= tolerance)).alias("image_size_differs_slightly"), _n_if(worst > tolerance).alias("image_size_mismatch"),
    )
    expected = F.col("hi") - F.col("lo") + 1 - F.col("files") if windowed else F.col("num_frames") - F.col("inside")
    return per.withColumns({
        "missing_clip_directory": F.when(F.col("folder"), 0).otherwise(1),
        "missing_frames": F.when(~F.col("folder"), 0).when(F.col("files") == 0, 1).otherwise(expected),
    })


def box_checks(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per recording that has boxes: counts of faults, and statistics of the boxes in its window.

    ``windows``: clip_id, num_frames, width, height, frame_start, frame_stop. Frames outside the
    recording count over all boxes, everything else over the boxes in the window.
    """
    sized = boxes.join(windows, KEY)
    index = F.col("frame_index")
    shape = box_issue(F.col("width"), F.col("height"))
    cells = sized.groupBy(KEY, "track_id", "frame_index").agg(
        _n().alias("n"), F.any_value((index >= F.col("frame_start")) & (index < F.col("frame_stop"))).alias("inside"),
        F.any_value((index < 0) | (index >= F.col("num_frames"))).alias("beyond"), *[_n_if(shape == s).alias(s) for s in SHAPES],
    )
    within = lambda value: F.coalesce(F.sum(F.when(F.col("inside"), value)), F.lit(0))
    tracks = cells.groupBy(KEY, "track_id").agg(
        F.coalesce(F.sum(F.when(F.col("beyond"), F.col("n"))), F.lit(0)).alias("frame_out_of_range"),
        within(F.col("n") - 1).alias("duplicate_track_frame"), *[within(F.col(s)).alias(s) for s in SHAPES], within(F.col("n")).alias("boxes"),
        _n_if(F.col("inside")).alias("frames"), _n_if(~F.col("inside")).alias("out"),
        (F.max(F.when(F.col("inside"), index)) - F.min(F.when(F.col("inside"), index)) + 1).alias("span"),
    )
    some = F.col("frames") > 0
    per = tracks.groupBy(KEY).agg(
        *[F.sum(c).alias(c) for c in ("frame_out_of_range", "duplicate_track_frame", *SHAPES, "boxes")], _n_if(some).alias("tracks"),
        _n_if(some & (F.col("span") != F.col("frames"))).alias("tracks_with_gaps"), _n_if(F.col("frames") == 1).alias("single_observation_tracks"),
        _n_if(some & (F.col("out") > 0)).alias("tracks_cut_by_window"),
    )
    seen = cells.where("inside").select(KEY, "frame_index").distinct().groupBy(KEY).agg(_n().alias("annotated_frames"))
    return per.join(seen, KEY, "left")


def parsed_rows(lines: DataFrame) -> DataFrame:
    """The numbers of a text and the ``error`` of each row, stored: a filter on them parses nothing again."""
    return materialize(mot.parse_lines(lines).select(KEY, *ROW, "error"))


def extra_rows(subset: DataFrame, full: DataFrame) -> DataFrame:
    """Rows (parsed text) of the subset file that the full file lacks, counted per recording."""
    known = full.select(KEY, *ROW).distinct()
    return subset.join(known, [KEY, *ROW], "left_anti").groupBy(KEY).agg(_n().alias("tiny_rows_not_in_gt"))


STATS = (
    "frame_start", "frame_stop", "boxes", "tracks", "annotated_frames", "tracks_with_gaps", "single_observation_tracks",
    "tracks_cut_by_window", "frames_checked",
)
FRAME_CODES = (
    "missing_clip_directory", "missing_frames", "frame_window_out_of_range", "unreadable_frame", "image_size_differs_slightly", "image_size_mismatch",
)
BOX_CODES = ("frame_out_of_range", "duplicate_track_frame", *SHAPES)


def check_clips(
    files: DataFrame, lines: DataFrame, clips: DataFrame, checked: DataFrame, frames: DataFrame, subset_files: DataFrame | None = None,
    subset_lines: DataFrame | None = None, tolerance: int = 1,
) -> DataFrame:
    """One row per recording with metadata or annotations: identity, a count per code, and statistics.

    ``files``: clip_id, location, clip_name, gt_sha256 of the annotation files; ``lines``:
    clip_id, line_number, line of their text; ``clips``: metadata. With ``subset_files`` and
    ``subset_lines`` the recordings come as windows of frames with rows of their own.

    The checks of a recording stop where the next ones would have no ground: without metadata or
    annotations, at unreadable text (``mot_format``), and, for windows, without frames. It then
    has no statistics (``checked_boxes`` is false). Blank lines do not count; an annotation file
    without rows has statistics of zeros.
    """
    windowed = subset_lines is not None
    parsed = parsed_rows(lines)
    bad = parsed.where("error is not null").select(KEY).distinct().withColumn("bad_text", F.lit(True))
    known = clips.select(KEY, "location", "clip_name", "num_frames", "width", "height", "framerate")
    cover = coverage_issues(files, clips, KEY).withColumnRenamed("code", "cover")
    fc = frame_checks(frames.withColumn("empty_folder", F.col("frame_index").isNull()), clips, checked, windowed, tolerance)
    base = (
        known.withColumns({"has_meta": F.lit(True), "bad_name": bad_name()})
        .join(files.select(KEY, F.col("location").alias("f_location"), F.col("clip_name").alias("f_name"), "gt_sha256", F.lit(True).alias("has_file")), KEY, "full")
        .withColumns({"location": F.coalesce("location", "f_location"), "clip_name": F.coalesce("clip_name", "f_name")}).drop("f_location", "f_name")
        .join(cover, KEY, "left").join(bad, KEY, "left").join(fc.drop("num_frames"), KEY, "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    readable = yes("has_meta") & yes("has_file") & ~yes("bad_text")
    some = F.coalesce(F.col("files") > 0, F.lit(False))
    base = base.withColumns({
        "checked_frames": readable, "checked_boxes": readable & some if windowed else readable,
        "frame_start": F.col("lo") if windowed else F.lit(0).cast("bigint"), "frame_stop": F.col("hi") + 1 if windowed else F.col("num_frames").cast("bigint"),
    })
    # frames outside the recording are looked for before the window is known
    beyond = F.when(F.col("checked_boxes"), F.col("frame_start")).otherwise(0), F.when(F.col("checked_boxes"), F.col("frame_stop")).otherwise(0)
    windows = base.where("checked_frames").select(KEY, "num_frames", "width", "height", beyond[0].alias("frame_start"), beyond[1].alias("frame_stop"))
    good = parsed.where("error is null").drop("error")
    boxes = good.select(
        KEY, (F.col("frame") - 1).alias("frame_index"), "track_id", (F.col("bb_left") - 1).alias("x_min"), (F.col("bb_top") - 1).alias("y_min"),
        (F.col("bb_left") - 1 + F.col("bb_width")).alias("x_max"), (F.col("bb_top") - 1 + F.col("bb_height")).alias("y_max"),
    )
    out = base.join(box_checks(boxes, windows), KEY, "left")
    if windowed:
        sub = parsed_rows(subset_lines)
        torn = sub.where("error is not null").select(KEY).distinct().withColumn("bad_subset", F.lit(True))
        out = out.join(extra_rows(sub.where("error is null").drop("error"), good), KEY, "left").join(torn, KEY, "left")
        out = out.join(subset_files.select(KEY, F.lit(True).alias("has_subset")).distinct(), KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = lambda condition: F.when(condition, 1).otherwise(0)
    images = F.when(F.col("checked_boxes"), 1).otherwise(0)
    counts = {
        "invalid_clip_name": one(yes("bad_name")), "missing_metadata": one(F.col("cover") == "missing_metadata"),
        "missing_annotations": one(F.col("cover") == "missing_annotations"), "mot_format": one(yes("has_meta") & yes("bad_text")),
        **{c: F.when(F.col("checked_frames"), zero(c)).otherwise(0) for c in FRAME_CODES[:3]}, **{c: zero(c) * images for c in FRAME_CODES[3:]},
        "frame_out_of_range": zero("frame_out_of_range"), **{c: zero(c) * images for c in BOX_CODES[1:]},
    }
    if windowed:
        torn = F.col("checked_boxes") & yes("has_subset") & yes("bad_subset")
        counts |= {
            "mot_format": counts["mot_format"] + one(torn), "missing_tiny_annotations": one(F.col("checked_boxes") & ~yes("has_subset")),
            "tiny_rows_not_in_gt": F.when(torn, 0).otherwise(zero("tiny_rows_not_in_gt")) * images, "no_boxes_in_window": one(F.col("checked_boxes") & (zero("boxes") == 0)),
        }
    whole = {c: zero(c) for c in STATS[2:8]} | {"frame_start": F.col("frame_start"), "frame_stop": F.col("frame_stop"), "frames_checked": zero("files")}
    return out.select(
        KEY, "location", "clip_name", "num_frames", "width", "height", "framerate", "gt_sha256", "checked_boxes",
        *[v.cast("bigint").alias(c) for c, v in counts.items()], *[F.when(F.col("checked_boxes"), whole[c]).cast("bigint").alias(c) for c in STATS],
    )


def issue_codes(checks: DataFrame) -> list[str]:
    """The code columns of :func:`check_clips`."""
    cols = checks.columns
    return cols[cols.index("checked_boxes") + 1 : cols.index(STATS[0])]


def issues_of(checks: DataFrame) -> DataFrame:
    """(clip_id, code, severity, count) of what was found."""
    opened = checks.select(KEY, F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("count")) for c in issue_codes(checks)])))
    return opened.where("count > 0").select(KEY, "code", severity(F.col("code")).alias("severity"), "count")
