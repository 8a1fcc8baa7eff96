"""Tracker text files (frame,id,left,top,width,height,conf,x,y,z), one file per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = 10
TRAILER = "1.0,-1,-1,-1"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line) with exact 1-based numbers.

    Files are read in splits, so one huge file is many tasks: a line's number is its place in
    its split plus the lines of the splits before it.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"),
    )
    splits = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("base"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("path", "block", "base", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = raw.join(offsets, ["path", "block"])
    return numbered.select("path", (F.col("before") + F.col("mid") - F.col("base") + 1).alias("line_number"), "line")


def _integer(token: Column) -> Column:
    """Plain integers, and decimals with a zero fraction; null otherwise."""
    value = token.try_cast("double")
    plain = F.when(token.rlike(r"^[+-]?\d+$"), token.try_cast("bigint"))
    return F.coalesce(plain, F.when((value == F.floor(value)) & (F.abs(value) < 2**53), value.cast("bigint")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parsed columns plus ``error`` (null for a good row). Blank lines are dropped."""
    text = lines.where(F.trim("line") != "").withColumn("t", F.split(F.trim("line"), ","))
    token = lambda i: F.trim(F.try_element_at("t", F.lit(i + 1)))
    names = ("bb_left", "bb_top", "bb_width", "bb_height")
    parsed = text.withColumns({"frame": _integer(token(0)), "track_id": _integer(token(1))})
    parsed = parsed.withColumns({n: token(i + 2).try_cast("double") for i, n in enumerate(names)})
    finite = F.lit(True)
    number = F.lit(True)
    for n in names:
        number = number & F.col(n).isNotNull()
        finite = finite & ~F.isnan(n) & (F.abs(n) != float("inf"))
    error = (
        F.when(F.size("t") != COLUMNS, F.concat(F.lit(f"expected {COLUMNS} columns, got "), F.size("t").cast("string")))
        .when(F.col("frame").isNull() | F.col("track_id").isNull(), "not an integer")
        .when(~number, "not a number")
        .when(~finite, "non-finite box value")
    )
    return parsed.withColumn("error", error).drop("t")


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error", "line")


def rejects(parsed: DataFrame) -> DataFrame:
    """Bad rows with their file and line."""
    return parsed.where("error is not null").select(
        "path", "line_number", "error", F.concat_ws(":", F.col("path"), F.col("line_number").cast("string")).alias("where")
    )


def format_line() -> Column:
    """One text line from the 1-based columns (3 decimals)."""
    return F.format_string(
        f"%d,%d,%.3f,%.3f,%.3f,%.3f,{TRAILER}", "frame", "track_id", "bb_left", "bb_top", "bb_width", "bb_height"
    )


def write_mot(boxes: DataFrame, path: str) -> None:
    """Tracker text: a folder per clip, as the lines do not name it, rows in (frame, track) order over its files.

    Rows are dealt by ranges of (clip, frame), so a hot recording is written by many tasks.
    """
    rows = _in_ranges(boxes)
    rows.select("clip_id", format_line().alias("value")).write.partitionBy("clip_id").text(path)


def _in_ranges(boxes: DataFrame) -> DataFrame:
    from shoalcount.operators.boxes import internal_to_mot

    order = ("clip_id", "frame", "track_id")
    return internal_to_mot(boxes).repartitionByRange(*order).sortWithinPartitions(*order)


def write_mot_lines(boxes: DataFrame, path: str) -> None:
    """Lines of many recordings as Parquet (clip_id, frame, track_id, line) in order: files carry statistics, no folders."""
    _in_ranges(boxes).select("clip_id", "frame", "track_id", format_line().alias("line")).write.mode("append").parquet(path)


def read_mot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of stored lines, parsed like text; a filter on clip_id reaches the scan."""
    lines = spark.read.parquet(path).select("clip_id", "line")
    return good_rows(parse_lines(lines))
