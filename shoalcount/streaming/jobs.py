"""Structured Streaming versions of the event-log operators.

Results go to files, never to the driver; checkpoints live beside them. What a job leaves out
that its batch twin has (tracks still under way, the tracker's rule on short tracks) is said
where it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoalcount.functions import geometry as g
from shoalcount.operators import tracking as tk
from shoalcount.operators.counting import DEFAULT_POLICY, CountingPolicy, apply_rule
from shoalcount.operators.ops import windowed_rates
from shoalcount.operators.ordered import previous
from shoalcount.operators.quantiles import quantiles
from shoalcount.operators.reviews import VERDICT_SCHEMA, step
from shoalcount.session import scratch_dir


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available, then read the results back from files."""
    spark, out = stream.sparkSession, scratch_dir(stream.sparkSession, "stream")
    schema = stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{out}/data").outputMode("append")
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            # a repeated batch overwrites its own folder, so a restart adds nothing twice
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(save).outputMode(mode)
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{out}/data")
    return spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")


# --- review log ----------------------------------------------------------------------------

_REVIEW_STATE = "revision long, passages array<string>"


def _review_step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    revision, passages = state.get if state.exists else (0, [])
    passages = set(passages)
    events = pd.concat(list(batches)).sort_values("event_id")
    events = events.astype(object).where(events.notna(), None)
    out = []
    for job, event_id, base, action, passage, error in events.itertuples(index=False):
        refusal = step(revision, passages, event_id, base, action, passage, error)
        revision += refusal is None
        out.append((job, event_id, refusal is None, revision if refusal is None else None, refusal))
    state.update((revision, sorted(passages)))
    yield pd.DataFrame(out, columns=["job_id", "event_id", "accepted", "resulting_revision", "refusal"])


def fold_review_stream(prepared: DataFrame) -> DataFrame:
    """Accept or refuse reviews as they arrive. State per job: its revision and added passages.

    ``prepared`` are events with their static verdict (``operators.reviews.prepare``).
    """
    cols = ["job_id", "event_id", "base_revision", "action", "passage_id", "error"]
    return prepared.select(*cols).groupBy("job_id").applyInPandasWithState(
        _review_step, VERDICT_SCHEMA, _REVIEW_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- tracking ------------------------------------------------------------------------------


def track_stream(detections: DataFrame, config, mx: float, my: float) -> DataFrame:
    """Label detections with live tracks as frames arrive, one state per recording.

    Frames of a recording must arrive in order across batches. Only live tracks are kept.
    """

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            tracker, last = pickle.loads(state.get[0])  # our own checkpointed state
        else:
            tracker, last = (tk._Kalman(config) if isinstance(config, tk.KalmanConfig) else tk._ByteTrack(config)), None
        rows = pd.concat(list(batches)).sort_values(["frame_index", "det_id"])
        out = []
        for frame, f in rows.groupby("frame_index", sort=True):
            quiet = 0 if last is None else min(int(frame) - last - 1, config.patience + 1)
            for _ in range(quiet):
                tracker.step(f.iloc[:0][["cx", "cy", *g.EDGES, "score"]].to_numpy(float))
            last = int(frame)
            labels = tracker.step(f[["cx", "cy", *g.EDGES, "score"]].to_numpy(float))
            out.append(f[["clip_id", "frame_index", "det_id"]].assign(local_id=labels))
        state.update((pickle.dumps((tracker, last)),))
        yield pd.concat(out)

    cx, cy = g.center_m(g.box(), F.lit(mx), F.lit(my))
    ready = detections.select("clip_id", "frame_index", "det_id", cx.alias("cx"), cy.alias("cy"), *g.EDGES, "score")
    return ready.groupBy("clip_id").applyInPandasWithState(
        advance, "clip_id long, frame_index long, det_id long, local_id long", "tracker binary", "append", GroupStateTimeout.NoTimeout
    )


# --- event-time windows --------------------------------------------------------------------


def completed_sessions(events: DataFrame, keys: list[str], at: str, gap: str, delay: str, *values: Column) -> DataFrame:
    """Tracks that ended: a session is emitted only once its gap has passed the watermark, so a
    passage still under way is never counted."""
    w = events.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap))
    out = w.agg(F.count(F.lit(1)).alias("observations"), *values)
    return out.select("*", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop")).drop("session_window")


def completed_tracks(
    boxes: DataFrame, keys: list[str], at: str, gap: str, delay: str, width: float, height: float, policy: CountingPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Tracks that ended, with the counting rule applied to their first and last box.

    ``boxes``: keys, ``at`` (time of the frame), frame_index and box, in any number of batches. A
    track ends when none of its boxes came for ``gap``; it is given out once the watermark has
    passed that end, and only then counted. State per open track: its two end boxes.
    """
    u, v = g.normalized_center(g.box(), F.lit(float(width)), F.lit(float(height)))
    centre = F.struct(u.alias("u"), v.alias("v"))
    ends = completed_sessions(
        boxes, keys, at, gap, delay, F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"),
        F.min_by(centre, "frame_index").alias("__a"), F.max_by(centre, "frame_index").alias("__b"),
    )
    return apply_rule(ends, policy)


def failure_windows(events: DataFrame, at: str, failed: Column, value: Column, length: str, slide: str, delay: str) -> DataFrame:
    return windowed_rates(events.withWatermark(at, delay), at, failed, value, length, slide)


def deduplicate(requests: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """One request per idempotency key within the watermark."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def last_heartbeats(heartbeats: DataFrame, worker: str, at: str) -> DataFrame:
    """Latest heartbeat per worker, kept up to date (update mode)."""
    return heartbeats.groupBy(worker).agg(F.max(at).alias("heartbeat_at"))


def monitoring_series(detections: DataFrame, at: str, value: str, period: str, *group: str) -> DataFrame:
    """Count, mean and median of a model output per period and group."""
    rows = detections.withColumn("window", F.window(at, period))
    keys = ["window", *group]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    medians = quantiles(rows, keys, value, {"median": 0.5})
    return counted.join(medians, keys, "left").withColumn("median", F.round("median", 6))


def share_series(rows: DataFrame, at: str, period: str, share: Column, *group: str) -> DataFrame:
    """Rows per period and group and the share of them for which ``share`` holds (unresolved reviews, say)."""
    held = F.avg(F.coalesce(share, F.lit(False)).cast("double"))
    return rows.groupBy(F.window(at, period), *group).agg(F.count(F.lit(1)).alias("n"), F.round(held, 6).alias("share"))


def gap_series(rows: DataFrame, keys: list[str], at: str, period: str) -> DataFrame:
    """Per period the number of gaps between consecutive rows of a key, with median and 95th percentile in seconds.

    A gap belongs to the period in which it ends.
    """
    stamp = F.unix_micros(at)
    ends = previous(rows.select(*keys, at), keys, F.floor(stamp / 86_400_000_000), [F.col(at)], [at])
    gaps = ends.where(F.col(f"prev_{at}").isNotNull()).select(F.window(at, period).alias("window"), ((stamp - F.unix_micros(f"prev_{at}")) / 1e6).alias("gap_s"))
    counted = gaps.groupBy("window").agg(F.count(F.lit(1)).alias("gaps"))
    spread = quantiles(gaps, ["window"], "gap_s", {"median_s": 0.5, "p95_s": 0.95})
    return counted.join(spread, "window").withColumns({c: F.round(c, 6) for c in ("median_s", "p95_s")})


def drift(series: DataFrame, baseline: DataFrame, *group: str) -> DataFrame:
    """Series beside the reference mean of its group (``baseline``: group, mean_ref)."""
    j = series.join(baseline, list(group))
    return j.withColumn("ratio", F.round(F.col("mean") / F.col("mean_ref"), 6))
