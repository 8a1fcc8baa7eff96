"""Clip metadata: JSON lists with strict fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INTS = ("num_frames", "width", "height")
METERS = ("x_meter_start", "x_meter_stop", "y_meter_start", "y_meter_stop")
FIELDS = ("clip_name", "num_frames", "framerate", "width", "height", *METERS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of metadata files; a JSON list is one document, hence one row."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def entries(documents: DataFrame) -> DataFrame:
    """One row per list entry: (source, index, fields as a string map)."""
    parsed = F.from_json("text", "array<map<string,string>>")
    return documents.select("source", F.posexplode(parsed).alias("index", "fields"))


def check_entries(rows: DataFrame) -> DataFrame:
    """Typed columns plus ``error``: unknown, missing or out-of-range fields, and every copy of
    a duplicate clip name."""
    allowed = F.array(*[F.lit(f) for f in FIELDS])
    get = lambda f: F.try_element_at("fields", F.lit(f))
    typed = rows.withColumns(
        {
            "clip_name": get("clip_name"),
            "framerate": get("framerate").try_cast("double"),
            **{f: get(f).try_cast("double") for f in INTS},
            **{f: get(f).try_cast("double") for f in METERS},
        }
    )
    unknown = F.array_except(F.map_keys("fields"), allowed)
    absent = F.array_except(allowed, F.map_keys("fields"))
    numbers = ["framerate", *INTS, *METERS]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    fraction = F.lit(False)
    low = F.col("framerate") <= 0
    for n in INTS:
        fraction = fraction | (F.col(n) != F.floor(n))
        low = low | (F.col(n) <= 0)
    error = (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.size(absent) > 0, F.concat(F.lit("missing field "), F.array_join(F.array_sort(absent), ",")))
        .when(F.col("clip_name") == "", "empty clip_name")
        .when(bad, "not a finite number")
        .when(fraction, "not an integer")
        .when(low, "not positive")
    )
    checked = typed.withColumn("error", error)
    copies = F.count(F.when(F.col("error").isNull(), 1)).over(Window.partitionBy("source", "clip_name"))
    checked = checked.withColumn("__copies", copies)
    duplicate = F.col("error").isNull() & (F.col("__copies") > 1)
    out = checked.withColumn("error", F.when(duplicate, "duplicate clip_name").otherwise(F.col("error")))
    return out.withColumns({f: F.col(f).cast("bigint") for f in INTS}).drop("__copies", "fields")
