"""Immutable, content-hashed manifest versions."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount.operators.merkle import table_digest

VERSION = re.compile(r"^[a-z0-9.]+-v\d+$")


class ManifestVersionError(ValueError):
    """The version exists with other content, or its content no longer matches its hash."""


def content_hash(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row with the SHA-256 of the table's content (a tree of hashes) and its number of rows."""
    return table_digest(rows, F.concat_ws("|", *key))


def totals(rows: DataFrame) -> DataFrame:
    """Clips, usable clips, window frames and boxes per partition."""
    usable = F.col("usable")
    return rows.groupBy("partition").agg(
        F.count(F.lit(1)).alias("clips"),
        F.count(F.when(usable, 1)).alias("usable_clips"),
        F.coalesce(F.sum(F.when(usable, F.col("frame_stop") - F.col("frame_start"))), F.lit(0)).alias("window_frames"),
        F.coalesce(F.sum(F.when(usable, F.col("boxes"))), F.lit(0)).alias("boxes"),
    )


def _sidecar(spark: SparkSession, path: str):
    try:
        return spark.read.json(f"{path}.sidecar").first()
    except AnalysisException:
        return None


def write_manifest(rows: DataFrame, out_dir: str, version: str, inputs: dict[str, str]) -> str:
    """Write a version once. The same content again is a no-op; other content is refused."""
    if not VERSION.match(version):
        raise ValueError(f"manifest version must look like 'tiny-v1': {version!r}")
    spark, path = rows.sparkSession, f"{out_dir}/{version}"
    digest = content_hash(rows, ["location", "clip_name"]).first()
    found = _sidecar(spark, path)
    stamp = ";".join(f"{k}={v}" for k, v in sorted(inputs.items()))
    if found is not None:
        if found["content_sha256"] != digest["content_sha256"] or found["inputs"] != stamp:
            raise ManifestVersionError(f"manifest {version} already exists with different content or inputs")
        return path
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    side = spark.createDataFrame([(version, digest["rows"], digest["content_sha256"], stamp)], "version string, rows bigint, content_sha256 string, inputs string")
    side.coalesce(1).write.mode("errorifexists").json(f"{path}.sidecar")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read a version and check it against its hash."""
    rows, found = spark.read.parquet(path), _sidecar(spark, path)
    if found is None or content_hash(rows, ["location", "clip_name"]).first()["content_sha256"] != found["content_sha256"]:
        raise ManifestVersionError(f"{path} does not match its content hash")
    return rows


def select_rows(manifest: DataFrame, partitions: list[str], limit: int | None = None) -> DataFrame:
    """Usable, validated rows, with ``limit`` the first by location and name. Test is refused,
    holdout comes alone, and a row that may not be tuned on raises."""
    if "test" in partitions:
        raise ValueError("test rows are kept out of tuning")
    holdout = "holdout" in partitions
    if holdout and partitions != ["holdout"]:
        raise ValueError("holdout goes with no other partition")
    rows = manifest.where(F.col("partition").isin(*partitions) & F.col("usable") & F.col("frames_validated"))
    bad = F.col("official_split") != "train" if holdout else ~F.col("tuning_allowed")
    guard = F.when(bad, F.raise_error(F.lit("a selected row may not be tuned on")).cast("string"))
    rows = rows.withColumn("clip_name", F.coalesce(guard, F.col("clip_name")))
    return rows.orderBy("location", "clip_name").limit(limit) if limit else rows


def release_rows(manifest: DataFrame, partition: str, location: str) -> DataFrame:
    if partition not in ("test", "holdout"):
        raise ValueError(f"releases are evaluated on test or holdout, not {partition!r}")
    return manifest.where((F.col("partition") == partition) & (F.col("location") == location) & F.col("usable"))


def select_clips(clips: DataFrame, include: DataFrame) -> DataFrame:
    """Clips (location, recording_date, clip_name) of whole locations or recording days.

    ``include`` has (location, day); a null day keeps the whole location.
    """
    i = include.select(F.col("location").alias("__l"), F.col("day").alias("__d")).distinct()
    on = (F.col("location") == F.col("__l")) & (F.col("__d").isNull() | (F.col("recording_date") == F.col("__d")))
    return clips.join(i, on, "left_semi")


def missing_days(clips: DataFrame, include: DataFrame) -> DataFrame:
    """Requested days without any clip: an error in the subset's definition."""
    days = clips.select("location", F.col("recording_date").alias("day")).distinct()
    return include.where("day is not null").join(days, ["location", "day"], "left_anti")


def in_location_order(rows: DataFrame, locations: list[str]) -> DataFrame:
    """Declared location order, then clip name."""
    place = F.array_position(F.array(*[F.lit(x) for x in locations]), F.col("location"))
    return rows.orderBy(place, "clip_name")
