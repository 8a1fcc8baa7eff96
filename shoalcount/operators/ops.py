"""Service tables: queue and worker reports, caches, idempotency, alert conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount import schemas
from shoalcount.functions.hashing import content_key
from shoalcount.operators.ordered import position, previous, running

# Job states, the duration histogram's bucket edges, liveness in seconds.
JOB_STATUSES = ("queued", "running", "succeeded", "failed")
JOB_SECONDS_BUCKETS = (5, 15, 30, 60, 120, 300, 600, 1200, 1800, 3600)
STALE_SECONDS = 60


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def table_violations(rows: DataFrame, table: str) -> DataFrame:
    """(column, rule, rows): breaches of a service table's constraints. A column that is missing or of another kind raises."""
    known = schemas.SERVICE[table]
    for f in known.fields:
        if f.name not in rows.columns or rows.schema[f.name].dataType != f.dataType:
            raise ValueError(f"{table}.{f.name} must be {f.dataType.simpleString()}")
    breach: dict[tuple[str, str], Column] = {}
    for name in known.fieldNames():
        if name not in schemas.NULLABLE.get(table, ()):
            breach[name, "null"] = F.col(name).isNull()
    for name, allowed in schemas.VALUES.get(table, {}).items():
        breach[name, "value"] = ~F.col(name).isin(*allowed)
    for name in schemas.POSITIVE.get(table, ()):
        breach[name, "positive"] = F.col(name) <= 0
    for name in schemas.NOT_NEGATIVE.get(table, ()):
        breach[name, "negative"] = F.col(name) < 0
    counted = rows.agg(*[F.count(F.when(c, 1)).alias(f"{n}|{r}") for (n, r), c in breach.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(r).alias("rule"), F.col(f"`{n}|{r}`").alias("rows")) for n, r in breach])
    found = counted.select(F.explode(listed).alias("e")).select("e.*").where("rows > 0")
    for key in (schemas.KEYS[table], *[(u,) for u in schemas.UNIQUE.get(table, ())]):
        there = rows.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).count()
        more = there.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows")).where("rows > 0")
        found = found.unionByName(more.select(F.lit(",".join(key)).alias("column"), F.lit("repeated").alias("rule"), "rows"))
    return found


def job_gauges(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs by status (every status, 0 if none), queue depth and age of the oldest queued job."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    oldest = F.min(F.when(F.col("status") == "queued", F.col("created_at")))
    return jobs.agg(
        *[n(s).alias(f"jobs_{s}") for s in JOB_STATUSES],
        n("queued").alias("queue_depth"),
        F.coalesce(_seconds(F.lit(now), oldest), F.lit(0.0)).alias("oldest_queued_seconds"),
    )


def live_workers(heartbeats: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS, *group: str) -> DataFrame:
    """Workers whose last heartbeat is recent enough, per group."""
    last = heartbeats.groupBy(*group, "worker_id").agg(F.max("heartbeat_at").alias("heartbeat_at"))
    live = F.count(F.when(_seconds(now, F.col("heartbeat_at")) <= stale_seconds, 1))
    return last.groupBy(*group).agg(live.alias("live_workers"), F.count(F.lit(1)).alias("workers"))


def backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """Runnable jobs (queued, or running with an expired lease) with their age rank per pipeline."""
    runnable = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < now))
    kept = jobs.where(runnable).select("pipeline_version", "job_id", "created_at", _seconds(now, F.col("created_at")).alias("age_seconds"))
    day = F.floor(F.unix_seconds("created_at") / 86400)
    return position(kept, ["pipeline_version"], day, [F.col("created_at"), F.col("job_id")], "rank")


def job_problems(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs past their deadline, or with an expired lease after the last attempt."""
    running_ = F.col("status") == "running"
    late = running_ & (_seconds(now, F.col("started_at")) > F.col("deadline_seconds"))
    spent = running_ & (F.col("lease_expires_at") < now) & (F.col("attempts") >= F.col("max_attempts"))
    lapsed = running_ & (F.col("lease_expires_at") < now)
    problem = F.when(late, "deadline exceeded").when(spent, "lease expired after the last attempt").when(lapsed, "lease expired")
    return jobs.withColumn("problem", problem).where("problem is not null").select("job_id", "problem")


def expired_uploads(clips: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Expired, undeleted uploads that no queued or running job needs."""
    gone = clips.where((F.col("expires_at") <= now) & F.col("deleted_at").isNull())
    return gone.join(jobs.where(F.col("status").isin("queued", "running")).select("clip_id"), "clip_id", "left_anti")


def cache_hits(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request with the earliest succeeded original job of the same cache key.

    The candidates are reduced to one per key before the join, so a popular key joins one row.
    """
    done = jobs.where((F.col("status") == "succeeded") & F.col("cached_from").isNull())
    first = done.groupBy("cache_key").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("cached_from"))
    return requests.join(first, "cache_key", "left")


def first_results(items: DataFrame, jobs: DataFrame, pipeline: str) -> DataFrame:
    """Each catalogue item (demo_id, clip_id) with its clip's first original success under
    ``pipeline``; ``available`` is false without one."""
    done = jobs.where(
        (F.col("status") == "succeeded") & F.col("cached_from").isNull() & (F.col("pipeline_version") == pipeline)
    )
    first = done.groupBy("clip_id").agg(F.min(F.struct("finished_at", "job_id")).alias("f"))
    return items.join(first, "clip_id", "left").select(
        *items.columns, F.col("f.job_id").alias("job_id"), F.col("f.finished_at").alias("computed_at"), F.col("f").isNotNull().alias("available")
    )


def request_keys(requests: DataFrame, fields: Sequence[str], name: str = "request_sha256") -> DataFrame:
    return requests.withColumn(name, content_key(**{f: F.col(f) for f in fields}))


def idempotency_report(requests: DataFrame) -> DataFrame:
    """Per idempotency key: requests, distinct contents, the job that answers it, conflict or not."""
    return requests.groupBy("idempotency_key").agg(
        F.count(F.lit(1)).alias("requests"),
        F.countDistinct("request_sha256").alias("contents"),
        F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"),
    ).withColumn("conflict", F.col("contents") > 1)


def duration_histogram(jobs: DataFrame, seconds: Column, *group: str) -> DataFrame:
    """Cumulative histogram of successful jobs' wall times, with count and sum.

    Jobs are counted per bucket while scanning; only bucket counts are shuffled.
    """
    done = jobs.where(F.col("status") == "succeeded").withColumn("s", seconds)
    counts = [F.count(F.when(F.col("s") <= le, 1)).alias(f"le_{le}") for le in JOB_SECONDS_BUCKETS]
    return done.groupBy(*group).agg(*counts, F.count(F.lit(1)).alias("le_inf"), F.round(F.sum("s"), 3).alias("sum_seconds"))


def stage_times(runs: DataFrame, *group: str) -> DataFrame:
    """Seconds and ms/frame per stage from rows with a ``stages`` map and ``frames``."""
    rows = runs.select(*group, "frames", F.explode("stages").alias("stage", "seconds"))
    total, frames = F.sum("seconds"), F.sum("frames")
    return rows.groupBy(*group, "stage").agg(
        F.round(total, 3).alias("seconds"), frames.alias("frames"), F.round(1000 * total / frames, 6).alias("ms_per_frame")
    )


def range_delta(samples: DataFrame, key: str, at: str, value: str, seconds: int = 1800) -> DataFrame:
    """Max minus min of a gauge over the trailing ``seconds`` at every sample.

    A series is cut into chunks of that length; a chunk's window also needs the chunk before,
    so each sample is sent to its own and the next chunk and an endless series is many tasks.
    """
    t = F.unix_seconds(at)
    chunk = F.floor(t / seconds)
    spread = samples.withColumn("__t", t).withColumn("__chunk", F.explode(F.array(chunk, chunk + 1)))
    spread = spread.withColumn("__own", F.floor(F.col("__t") / seconds) == F.col("__chunk"))
    w = Window.partitionBy(key, "__chunk").orderBy("__t").rangeBetween(-seconds, 0)
    out = spread.withColumn("delta", F.max(value).over(w) - F.min(value).over(w))
    return out.where("__own").drop("__t", "__chunk", "__own")


def sustained(samples: DataFrame, key: str, at: str, condition: Column, seconds: int) -> DataFrame:
    """Stretches of consecutive samples over which a condition holds for at least ``seconds``.

    Of samples at one time, those that do not meet it come first.
    """
    bucket, order = F.floor(F.unix_seconds(at) / 86400), [F.col(at), F.col("on")]
    s = samples.select(key, at, F.coalesce(condition, F.lit(False)).alias("on"))
    p = previous(s, [key], bucket, order, ["on"])
    p = p.withColumn("new", F.when(F.col("on") & ~F.coalesce("prev_on", F.lit(False)), 1).otherwise(0))
    r = running(p, [key], bucket, order, F.col("new"), "run").where("on")
    spans = r.groupBy(key, "run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("samples"))
    return spans.where(_seconds(F.col("stop"), F.col("start")) >= seconds).drop("run")


def windowed_rates(events: DataFrame, at: str, failed: Column, value: Column, length: str, slide: str, *group: str) -> DataFrame:
    """Events, failures and mean value per sliding event-time window (batch or stream).

    The mean comes from an exact decimal sum, so it does not depend on the order of addition.
    """
    n = F.count(F.lit(1))
    return events.groupBy(F.window(at, length, slide), *group).agg(
        n.alias("events"), F.count(F.when(failed, 1)).alias("failures"),
        (F.sum(value.cast("decimal(28,6)")).cast("double") / n).alias("mean_value"),
    )
