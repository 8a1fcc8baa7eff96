"""Random audit windows over footage no flagged track covers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalcount.operators.intervals import free_runs

WINDOW_SCHEMA = "clip_id long, window_index int, start_frame long, stop_frame long"


def _draw(starts: np.ndarray, stops: np.ndarray, window: int, fraction: float, seed: int) -> list[tuple[int, int]]:
    """Windows over one recording's free runs, every possible start equally likely."""
    lengths = stops - starts
    total = int(lengths.sum())
    if (lengths < window).all():
        longest = int(np.lexsort((starts, -lengths))[0])
        return [(int(starts[longest]), int(stops[longest]))]
    rng = np.random.default_rng(seed)
    chosen: list[tuple[int, int]] = []
    while len(chosen) * window < fraction * total:
        room = np.maximum(stops - starts - window + 1, 0)
        if not room.any():
            break
        edges = np.cumsum(room)
        pick = int(rng.integers(int(edges[-1])))
        run = int(np.searchsorted(edges, pick, side="right"))
        at = int(starts[run] + pick - (edges[run] - room[run]))
        chosen.append((at, at + window))
        starts = np.insert(starts, run + 1, at + window)
        stops = np.insert(stops, run, at)
    return sorted(chosen)


def audit_windows(clips: DataFrame, flagged: DataFrame, window: int, fraction: float, margin: int) -> DataFrame:
    """(clip, window_index, start, stop) for every recording with free footage.

    Spark reduces the recording to its free runs first; the seeded draw per recording sees
    only those. The seed is the SHA-256 of the clip's name.
    """
    if window < 1 or not 0 < fraction <= 1:
        raise ValueError(f"no audit with window {window}, fraction {fraction}, margin {margin}")
    runs = free_runs(clips, flagged, margin).join(clips.select("clip_id", "clip_name"), "clip_id")

    def per_clip(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_frame")
        name = str(pdf["clip_name"].iloc[0])
        seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
        found = _draw(pdf["start_frame"].to_numpy(), pdf["stop_frame"].to_numpy(), window, fraction, seed)
        return pd.DataFrame(
            {
                "clip_id": pdf["clip_id"].iloc[0],
                "window_index": range(len(found)),
                "start_frame": [a for a, _ in found],
                "stop_frame": [b for _, b in found],
            }
        )

    return runs.groupBy("clip_id").applyInPandas(per_clip, WINDOW_SCHEMA)


def with_times(windows: DataFrame, clips: DataFrame) -> DataFrame:
    """Start and stop in seconds."""
    return windows.join(clips.select("clip_id", "framerate"), "clip_id").withColumns(
        {"start_time_s": F.col("start_frame") / F.col("framerate"), "stop_time_s": F.col("stop_frame") / F.col("framerate")}
    ).drop("framerate")
