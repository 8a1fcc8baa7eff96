"""File inventories, checksums and archive listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount.operators.merkle import ordered_digest


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, content) of every file below ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("size"), "content")


def inventory(files: DataFrame) -> DataFrame:
    return files.select("path", "size", F.sha2("content", 256).alias("sha256"))


def compare_inventory(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are unknown or whose hash changed."""
    k = known.select("path", F.col("sha256").alias("known_sha256"))
    j = found.join(k, "path", "left")
    problem = F.when(F.col("known_sha256").isNull(), "unknown").when(F.col("sha256") != F.col("known_sha256"), "changed")
    return j.withColumn("problem", problem).where("problem is not null").select("path", "problem")


def verify_checksums(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries (path, size, md5) with verified / size_mismatch / md5_mismatch / missing."""
    got = files.select("path", F.col("size").alias("got_size"), F.md5("content").alias("got_md5"))
    j = registry.join(got, "path", "left")
    status = (
        F.when(F.col("got_size").isNull(), "missing")
        .when(F.col("got_size") != F.col("size"), "size_mismatch")
        .when(F.col("got_md5") != F.col("md5"), "md5_mismatch")
        .otherwise("verified")
    )
    return j.select("path", status.alias("status"))


def frame_files(listing: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """A listing (clip_id, name) with ``frame_index``; null marks a stray file."""
    index = F.regexp_extract("name", r"^(\d+)" + suffix.replace(".", r"\.") + "$", 1)
    return listing.withColumn("frame_index", F.when(index != "", index.try_cast("bigint")))


def check_frame_members(members: DataFrame) -> DataFrame:
    """Archive members (archive, name): one verdict per archive.

    Frames must be 0..N-1 in one folder without duplicates; hidden and system files are ignored.
    """
    base = F.regexp_extract("name", r"([^/]+)$", 1)
    ignored = F.col("name").endswith("/") | base.startswith(".") | F.col("name").startswith("__MACOSX/")
    kept = members.where(~ignored).withColumn("index", F.regexp_extract(base, r"(?i)^(\d+)\.(?:jpg|jpeg|png)$", 1).try_cast("bigint"))
    kept = kept.withColumn("folder", F.regexp_extract("name", r"^(?:([^/]+)/)?[^/]+$", 1))
    deep = (F.size(F.split("name", "/")) > 2) | F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    per = kept.groupBy("archive", "index").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(deep).alias("deep"), F.min("folder").alias("lo"), F.max("folder").alias("hi")
    )
    agg = per.groupBy("archive").agg(
        F.sum("n").alias("files"), F.bool_or("deep").alias("deep"), F.bool_or(F.col("index").isNull()).alias("other"),
        F.bool_or(F.col("index").isNotNull() & (F.col("n") > 1)).alias("twice"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count("index").alias("frames"), F.max("index").alias("last"),
    )
    problem = (
        F.when(F.col("deep"), "unexpected path")
        .when(F.col("other"), "not a frame file")
        .when(F.col("twice"), "frame appears twice")
        .when(F.col("lo") != F.col("hi"), "frames must be in one folder")
        .when(F.col("last") != F.col("frames") - 1, "frames missing")
    )
    return agg.select("archive", "frames", problem.alias("problem"))


def select_members(members: DataFrame, prefix: str, known: DataFrame, selected: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """Archive members mapped to (location, clip, frame), or the reason they are skipped.

    ``known`` (clip_name) and ``selected`` (clip_name, location) meet the members in equi joins.
    """
    body = F.regexp_extract("name", f"^{re.escape(prefix)}([^/]+){re.escape(suffix)}$", 1)
    clip, frame = F.regexp_extract(body, r"^(.+)_(\d+)$", 1), F.regexp_extract(body, r"^(.+)_(\d+)$", 2)
    m = members.withColumns({"clip_name": F.when(clip != "", clip), "frame_index": frame.try_cast("bigint")})
    m = m.join(known.select("clip_name", F.lit(True).alias("__known")).distinct(), "clip_name", "left")
    m = m.join(selected.select("clip_name", "location"), "clip_name", "left")
    reason = (
        F.when(F.col("clip_name").isNull(), "unexpected_name")
        .when(F.col("__known").isNull(), "unknown_clip")
        .when(F.col("location").isNull(), "not_selected")
    )
    return m.withColumn("skipped", reason).drop("__known")


def detection_digests(rows: DataFrame, decimals: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SHA-256 per frame (clip_id, frame_index) and per clip over boxes and scores, exact or rounded.

    A frame's detections are taken in the order of their values, so their numbering does not
    matter; a clip's digest is the root of a tree of hashes over its frames in order.
    """
    v = {c: F.col(c) if decimals is None else F.round(c, decimals) for c in (*_BOX, "score")}
    entries = F.array_sort(F.collect_list(F.struct(*[x.alias(c) for c, x in v.items()])))  # one frame's detections
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", *[e[c].cast("string") for c in v])), ",")
    frames = rows.groupBy("clip_id", "frame_index").agg(F.sha2(text, 256).alias("sha256"))
    leaves = frames.select("clip_id", F.col("frame_index").alias("at"), F.col("sha256").alias("digest"))
    return frames, ordered_digest(leaves, ["clip_id"]).withColumnRenamed("digest", "sha256")


_BOX = ("x_min", "y_min", "x_max", "y_max")
