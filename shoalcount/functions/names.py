"""Identifiers: clip names, camera slices, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_NAME = r"^(.*?(\d{4}-\d{2}-\d{2})_\d{6})_(\d+)_(\d+)$"

# The benchmark's locations and their official split.
OFFICIAL_SPLITS = {
    "kenai-train": "train",
    "kenai-val": "val",
    "kenai-rightbank": "test",
    "kenai-channel": "test",
    "elwha": "test",
    "nushagak": "test",
}


def parse_clip_name(name: Column) -> Column:
    """STRUCT(recording_id, recording_date, start, stop), or null for an invalid name.

    Invalid: no match, an impossible date, or an empty frame range.
    """
    part = lambda i: F.regexp_extract(name, CLIP_NAME, i)
    date = F.try_to_date(part(2), "yyyy-MM-dd")
    start, stop = part(3).try_cast("bigint"), part(4).try_cast("bigint")
    parsed = F.struct(part(1).alias("recording_id"), date.alias("recording_date"), start.alias("start"), stop.alias("stop"))
    return F.when(name.rlike(CLIP_NAME) & date.isNotNull() & (stop > start), parsed)


def camera(name: Column) -> Column:
    found = F.regexp_extract(name, r"_(LeftFar|LeftNear|RightFar|RightNear)_", 1)
    return F.when(found == "", "other").otherwise(found)


def camera_slice(name: Column) -> Column:
    """'<camera> stratum <n>' or 'other'."""
    pattern = r"_(Left|Right)(Far|Near)_Stratum(\d)"
    label = F.concat(
        F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2), F.lit(" stratum "), F.regexp_extract(name, pattern, 3)
    )
    return F.when(name.rlike(pattern), label).otherwise("other")


def official_split(location: Column) -> Column:
    """The location's split; an unknown location raises."""
    known = F.create_map(*[F.lit(x) for kv in OFFICIAL_SPLITS.items() for x in kv])
    message = F.concat(F.lit("unknown location "), F.coalesce(location, F.lit("null")))
    return F.coalesce(F.try_element_at(known, location), F.raise_error(message).cast("string"))


def tuning_allowed(split: Column) -> Column:
    return split != "test"
