"""The supplied tables as the shapes this library works on.

Integer arithmetic only, so every view has an exact SQL twin (``checks/adapter_sql.py``).
A recording is one user block in one week of the event stream: the number of recordings grows
with the number of users, and a recording never holds more than ``TRACKS_PER_CLIP`` objects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount.operators.ordered import position, running

WIDTH, HEIGHT, FRAMERATE = 640, 480, 10.0
METERS = (0.0, 12.0, 0.0, 9.0)  # x start, x stop, y start, y stop
TRACKS_PER_CLIP = 150
CAMERAS = ("LeftFar", "LeftNear", "RightFar", "RightNear")


# Declared schemas: no footer-inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _view(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Build a view's plan once per session and folder. Only the plan is kept, no data; views
    that share a parent then also share its exchange at run time."""
    plans: dict[tuple[SparkSession, str], DataFrame] = {}

    @wraps(fn)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        if (spark, sf_dir) not in plans:
            plans[spark, sf_dir] = fn(spark, sf_dir)
        return plans[spark, sf_dir]

    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


@_view
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per (recording, object) in time order: the frame index."""
    clip = F.expr(f"bigint((day(ts) - 1) div 7 + 5 * (user_id div {TRACKS_PER_CLIP}))")
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", clip.alias("clip_id"), F.col("user_id").alias("track_id")
    )
    hour = F.datediff(F.to_date("ts"), F.lit("2000-01-01")) * 24 + F.hour("ts")
    return position(events, ["clip_id", "track_id"], hour, [F.col("ts"), F.col("event_id")], "frame_index")


def _reference(sight: DataFrame) -> DataFrame:
    x = F.expr(
        "200 + (track_id * 37) % 240 + ((track_id * 13 + clip_id * 7) % 41 - 20) * frame_index + event_id % 3 - 1"
    )
    return sight.withColumn("x", x).withColumn("y", F.expr("(track_id * 53) % 440"))


def _boxes(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "clip_id",
        "track_id",
        "frame_index",
        F.col("x").cast("double").alias("x_min"),
        F.col("y").cast("double").alias("y_min"),
        (F.col("x") + 30).cast("double").alias("x_max"),
        (F.col("y") + 20).cast("double").alias("y_max"),
        *extra,
    )


@_view
def reference_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated boxes: (clip_id, track_id, frame_index, box)."""
    return _boxes(_reference(sightings(spark, sf_dir)))


@_view
def timed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated boxes with the time of their frame."""
    return _boxes(_reference(sightings(spark, sf_dir)), F.col("ts").cast("timestamp").alias("ts"))


@_view
def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = _reference(sightings(spark, sf_dir))
    seen = ref.where("event_id % 13 <> 0 and track_id % 17 <> 0 and not (track_id % 7 = 3 and frame_index >= 5)")
    base = seen.select(
        "event_id",
        "clip_id",
        "frame_index",
        F.expr(
            "case when track_id % 9 = 0 and frame_index >= 6 then track_id * 2 + 1"
            " when track_id % 9 = 1 and frame_index >= 6 then (track_id - 1) * 2"
            " else track_id * 2 end"
        ).alias("track_id"),
        F.expr(
            "case when track_id % 10 = 7 and (frame_index < 2 or frame_index >= 8) then 610 - x"
            " else x + event_id % 5 - 2 end"
        ).alias("x"),
        "y",
        F.expr("double(20 + event_id % 80) / 100.0D").alias("score"),
    )
    # One pass over the base: each row yields itself plus its copies, instead of a self-union.
    copies = F.expr(
        "filter(array(struct(0L as dt, 0L as dx, 0L as dy, true as keep),"
        " struct(100000L as dt, 3L as dx, 2L as dy, track_id % 11 = 0 as keep),"
        " struct(200000L as dt, 0L as dx, 500L as dy, track_id % 13 = 0 as keep)), c -> c.keep)"
    )
    return base.withColumn("c", F.explode(copies)).select(
        "event_id",
        "clip_id",
        "frame_index",
        (F.col("track_id") + F.col("c.dt")).alias("track_id"),
        (F.col("x") + F.col("c.dx")).alias("x"),
        (F.col("y") + F.col("c.dy")).alias("y"),
        "score",
    )


@_view
def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker output: split, merged, reversed, missing, duplicate and background tracks."""
    return _boxes(_predicted(spark, sf_dir), "score")


@_view
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections: predicted boxes without track identity, with a detection ID."""
    df = _predicted(spark, sf_dir).withColumn("det_id", F.expr("event_id * 4 + track_id div 100000"))
    return _boxes(df, "score", "det_id").drop("track_id")


@_view
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording dimension: name, location, size, frame rate and metre extents."""
    frames = sightings(spark, sf_dir).groupBy("clip_id").agg((F.max("frame_index") + 1).alias("num_frames"))
    camera = F.element_at(F.array(*[F.lit(c) for c in CAMERAS]), (F.col("clip_id") % 4 + 1).cast("int"))
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("k"), F.lower("r_name").alias("location")
    )
    named = frames.withColumn("k", F.col("clip_id") % 5).join(region, "k")
    return named.select(
        "clip_id",
        F.format_string(
            "%s_%s_Stratum%d_2018-06-%02d_120000_%d_%d",
            "location", camera, F.col("clip_id") % 2 + 1, F.col("clip_id") % 28 + 1,
            F.col("clip_id") * 10000, F.col("clip_id") * 10000 + F.col("num_frames"),
        ).alias("clip_name"),
        "location",
        "num_frames",
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.lit(FRAMERATE).alias("framerate"),
        *[F.lit(v).alias(n) for n, v in zip(("x_meter_start", "x_meter_stop", "y_meter_start", "y_meter_stop"), METERS)],
    )


LOCATIONS = ("kenai-train", "kenai-val", "kenai-rightbank", "kenai-channel", "elwha", "nushagak")


@_view
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-clip reference counts and two systems' counts, one clip per customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"))
    locations = F.array(*[F.lit(x) for x in LOCATIONS])
    cameras = F.array(*[F.lit(x) for x in CAMERAS])
    c = c.withColumns(
        {
            "location": F.element_at(locations, (F.col("nation") % 6 + 1).cast("int")),
            "camera": F.element_at(cameras, (F.col("k") % 4 + 1).cast("int")),
            "num_frames": F.expr("150 + (k * 31) % 400"),
            "framerate": F.lit(FRAMERATE),
            "ref_right": F.expr("k % 4"),
            "ref_left": F.expr("(k div 4) % 3"),
        }
    )
    return c.withColumns(
        {
            "clip_name": F.format_string(
                "%s_%s_Stratum%d_2018-06-%02d_120000_%d_%d", "location", "camera", F.col("k") % 2 + 1,
                F.col("k") % 28 + 1, F.col("k") * 1000, F.col("k") * 1000 + F.col("num_frames"),
            ),
            "code": F.format_string("s%07d", "k"),
            "a_right": F.expr("greatest(ref_right + case (k * 7) % 5 when 0 then 1 when 1 then -1 else 0 end, 0)"),
            "a_left": F.expr("greatest(ref_left + case when k % 7 = 0 then -1 when k % 13 = 0 then 2 else 0 end, 0)"),
            "b_right": F.expr("ref_right + case when k % 9 = 0 then 1 else 0 end"),
            "b_left": F.expr("greatest(ref_left - case when k % 8 = 0 then 1 else 0 end, 0)"),
        }
    )


@_view
def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study trials, one per clip of :func:`clip_counts`."""
    return clip_counts(spark, sf_dir).select(
        F.when(F.col("nation") == 0, "D1").otherwise(F.format_string("P%d", "nation")).alias("participant"),
        (F.col("k") % 2 + 1).cast("int").alias("block"),
        F.when(F.col("k") % 2 == 0, "manual").otherwise("assisted").alias("condition"),
        F.col("code").alias("clip"),
        (F.col("k") % 10 == 9).alias("practice"),
        F.expr("15000 + (k * 7919) % 60000").alias("active_ms"),
        F.col("b_right").alias("final_right"),
        F.col("b_left").alias("final_left"),
        "k",
    )


@_view
def study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_counts(spark, sf_dir).select(
        F.col("code").alias("clip"), "ref_right", "ref_left", F.col("a_right").alias("auto_right"), F.col("a_left").alias("auto_left")
    )


@_view
def review_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users per job; a few jobs that are reviewed have no result."""
    u = table(spark, sf_dir, "events").select(F.expr("user_id div 2").alias("job_id")).where("job_id % 31 <> 30").distinct()
    return u.withColumns({"num_frames": F.lit(300).cast("bigint"), "audit_windows": F.lit(4), "unflagged_frames": 100 + F.col("job_id") % 7})


@_view
def job_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tracks per user, with an automatic direction and a frame span."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    t = u.select(
        F.expr("user_id div 2").alias("job_id"),
        F.explode(F.expr("transform(sequence(0L, 9L), i -> (user_id % 2) * 10 + i)")).alias("track_id"),
    )
    return t.selectExpr(
        "job_id", "track_id", "case (track_id + job_id) % 3 when 0 then 'right' when 1 then 'left' end as direction",
        "(track_id * 37 + job_id * 11) % 200 as start_frame", "(track_id * 37 + job_id * 11) % 200 + 20 + track_id % 30 as end_frame",
    )


@_view
def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log: a reviewer per job who now and then sends stale or invalid events."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id div 2 as job_id", "event_type",
        "event_id % 5 <> 0 and event_id % 7 <> 0 as fine", "event_id % 7 = 0 as stale",
    )
    bucket, order = F.expr("event_id div 4096"), [F.col("event_id")]
    e = running(e, ["job_id"], bucket, order, F.expr("bigint(fine)"), "before", exclusive=True)
    added = F.when(F.col("fine") & (F.col("event_type") == "purchase"), F.col("event_id"))
    e = running(e, ["job_id"], bucket, order, added, "last_added", fn="max", exclusive=True)
    return e.selectExpr(
        "job_id", "event_id", "ts",
        "coalesce(before, 0) - if(stale, 1, 0) as base_revision",
        """case when not fine and event_id % 4 = 2 then 'add_passage'
                when not fine then 'accept'
                when event_type = 'click' then 'accept'
                when event_type = 'view' then 'reject'
                when event_type = 'error' then 'set_direction'
                when event_type = 'purchase' then 'add_passage'
                when event_id % 2 = 0 and last_added is not null then 'reject'
                when event_id % 3 = 0 then 'mark_audited'
                else 'mark_unresolved' end as action""",
        """case when not fine then if(event_id % 4 = 0, 999, if(event_id % 4 = 3, event_id % 20, null))
                when event_type in ('click', 'view', 'error') then event_id % 20
                when event_type = 'signup' and not (event_id % 2 = 0 and last_added is not null) and event_id % 3 <> 0
                then event_id % 20 end as track_id""",
        """case when not fine and event_id % 4 = 1 then 'p999999999'
                when fine and event_type = 'signup' and event_id % 2 = 0 and last_added is not null
                then concat('p', last_added) end as passage_id""",
        """case when not fine and event_id % 4 = 2 then 'right'
                when fine and event_type = 'error' then case event_id % 3 when 0 then 'right' when 1 then 'left' end
                when fine and event_type = 'purchase' then if(event_id % 2 = 0, 'right', 'left') end as direction""",
        """case when not fine and event_id % 4 = 2 then 500
                when fine and event_type = 'purchase' then event_id % 300 end as frame_index""",
        """int(case when not fine and event_id % 4 = 3 then 1
                when fine and event_type = 'purchase' and event_id % 2 = 0 then event_id % 4
                when fine and event_type = 'signup' and not (event_id % 2 = 0 and last_added is not null) and event_id % 3 = 0
                then event_id % 4 end) as audit_window""",
    )


@_view
def dataset_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows of uneven quality: one clip per supplier."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as clip_id", "l_orderkey % 40 as track_id", "l_partkey % 120 as frame_index",
        "double(int(l_extendedprice) % 700 - 30) as x_min", "double(l_orderkey % 500 - 10) as y_min",
        "double(int(l_extendedprice) % 700 - 30) + l_quantity - 2 as x_max", "double(l_orderkey % 500 - 10) + l_linenumber * 5 as y_max",
    )


@_view
def dataset_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as clip_id", "s_name as clip_name", "concat('loc', s_nationkey % 5) as location",
        "100L as num_frames", "640 as width", "480 as height",
    )


@_view
def service_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs table, one job per order."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as job_id", "o_custkey as clip_id", "o_orderpriority as pipeline_version",
        "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400) as created_at",
        "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else if(o_orderkey % 3 = 0, 'failed', 'running') end as status",
        "concat(o_custkey % 300, ':', o_orderpriority) as cache_key", "concat('k', o_custkey % 700) as idempotency_key",
        "o_orderkey % 4 as attempts", "3 as max_attempts", "3600 + (o_orderkey % 50) * 3600 as deadline_seconds",
        "if(o_orderkey % 6 = 0, o_orderkey - 1, null) as cached_from", "5 + (o_orderkey * 37) % 3000 as seconds", "o_totalprice",
    )
    return o.selectExpr(
        "*", "created_at + make_dt_interval(0, 0, 1, 0) as started_at", "created_at + make_dt_interval(0, 2, 0, 0) as lease_expires_at",
        "created_at + make_dt_interval(0, 0, 0, seconds) as finished_at",
    )


@_view
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest-shaped rows, one clip per customer."""
    m = clip_counts(spark, sf_dir).selectExpr(
        "location", "clip_name", "k", "num_frames",
        "case when location in ('kenai-train') then 'train' when location = 'kenai-val' then 'val' else 'test' end as official_split",
        "case when k % 11 = 0 then 'quarantined' when k % 7 = 0 then 'warning' else 'ok' end as status",
        "k % 13 <> 0 as frames_validated", "0L as frame_start", "num_frames as frame_stop", "k % 50 as boxes",
        "location = 'kenai-train' and k % 5 = 0 as held",
    )
    return m.selectExpr(
        "location", "clip_name", "official_split", "if(held, 'holdout', official_split) as partition", "official_split <> 'test' and not held as tuning_allowed",
        "status", "status <> 'quarantined' as usable", "frames_validated", "num_frames", "frame_start", "frame_stop", "boxes",
    )


GRID = 8


@_view
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 byte frames from the embeddings, one clip per label."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "bigint(label) as clip_id", "embedding")
    e = position(e, ["clip_id"], F.expr("vec_id div 256"), [F.col("vec_id")], "frame_index")
    return e.select("clip_id", "frame_index", F.posexplode("embedding").alias("i", "e")).selectExpr(
        "clip_id", "frame_index", f"i div {GRID} as y", f"i % {GRID} as x", "int(greatest(least(128 + floor(double(e) * 500), 255), 0)) as value"
    ).withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})
