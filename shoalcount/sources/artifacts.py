"""Track, observation and audit tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount import schemas


def write_tracks(tracks: DataFrame, path: str, framerate: str = "framerate") -> None:
    """Track summaries with derived times; append-only. Files hold ranges of (clip, track), so a scan by
    recording reads the few files and row groups whose statistics cover it, and a hot recording is many files."""
    out = tracks.withColumns(
        {"start_time_s": F.col("start_frame") / F.col(framerate), "end_time_s": F.col("end_frame") / F.col(framerate)}
    )
    names = [f.name for f in schemas.TRACKS.fields if f.name in out.columns]
    spread = out.select("clip_id", *names).repartitionByRange("clip_id", "track_id")
    spread.sortWithinPartitions("clip_id", "track_id").write.mode("append").parquet(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track summaries; review columns missing from older files are null."""
    raw = spark.read.option("mergeSchema", "true").parquet(path)
    empty = spark.createDataFrame([], schemas.TRACKS)
    full = raw.unionByName(empty, allowMissingColumns=True)
    return full.select("clip_id", *[F.col(f.name).cast(f.dataType) for f in schemas.TRACKS.fields])


def write_observations(boxes: DataFrame, path: str, clips_per_file: int | None = None) -> None:
    """Boxes range-partitioned on (clip, frame): a huge clip spreads over files and a frame
    window touches few row groups."""
    cols = ["clip_id", *schemas.OBSERVATIONS.fieldNames()]
    spread = boxes.select(*cols)
    spread = spread.repartitionByRange(clips_per_file, "clip_id", "frame_index") if clips_per_file else spread.repartitionByRange("clip_id", "frame_index")
    spread.sortWithinPartitions("clip_id", "frame_index", "track_id").write.mode("append").parquet(path)


def write_audit_windows(windows: DataFrame, unflagged: DataFrame, calibration_version: str, path: str) -> None:
    """Audit windows (clip_id, window_index, frames, times) with their recording's unflagged frames; append-only.

    A recording without windows keeps one row, with nulls for the window.
    """
    names = schemas.AUDIT_WINDOWS.fieldNames()
    rows = unflagged.select("clip_id", "unflagged_frames").join(windows.select("clip_id", *names), "clip_id", "left")
    rows = rows.withColumn("calibration_version", F.lit(calibration_version)).repartitionByRange("clip_id", "window_index")
    rows.sortWithinPartitions("clip_id", "window_index").write.mode("append").parquet(path)


def read_audit_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The windows, and per recording its calibration version and unflagged frames."""
    rows = spark.read.parquet(path)
    windows = rows.where("window_index is not null").select("clip_id", *[F.col(f.name).cast(f.dataType) for f in schemas.AUDIT_WINDOWS.fields])
    return windows, rows.select("clip_id", "calibration_version", "unflagged_frames").distinct()


#: The longest window of frames that is served at once.
MAX_OBSERVATION_FRAMES = 500


def observation_window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """:func:`read_observations` for display: the window must be 1 to MAX_OBSERVATION_FRAMES frames long."""
    if not 0 < stop - start <= MAX_OBSERVATION_FRAMES:
        raise ValueError(f"a window holds 1 to {MAX_OBSERVATION_FRAMES} frames, not {stop - start}")
    return read_observations(spark, path, start, stop)


def read_observations(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Boxes of a half-open frame window; the bounds reach the Parquet scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("frame_index") >= start)
    if stop is not None:
        df = df.where(F.col("frame_index") < stop)
    return df


def write_detections(detections: DataFrame, path: str, floor: float = 0.05) -> None:
    """The detection cache: stored once at a low threshold, filtered by every later variant."""
    kept = detections.where(F.col("score") >= floor)
    kept.repartitionByRange("clip_id", "frame_index").sortWithinPartitions("clip_id", "frame_index").write.mode("errorifexists").parquet(path)


def read_detections(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    return spark.read.parquet(path).where(F.col("score") >= threshold)
