"""Experiments over one stored detection table: tracker grids, ablations, stepwise tuning."""

from __future__ import annotations

import dataclasses
from collections.abc import Collection, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalcount.operators import counting as ct
from shoalcount.operators import matching as mt
from shoalcount.operators import tracking as tk
from shoalcount.session import materialize
from shoalcount.sources.reports import settings


def evaluate_trackers(
    detections: DataFrame, ref_tracks: DataFrame, clips: DataFrame, configs: Sequence, mx: float, my: float, width: int, height: int,
) -> DataFrame:
    """Errors of every configuration in one job: one tracking pass over (variant, clip)."""
    tracks = tk.track(materialize(detections), configs, mx, my)  # read three times
    counts = ct.count_trajectories(tracks, width, height, keys=("variant", "clip_id", "track_id"))
    pred = ct.tally(counts, ["variant", "clip_id"]).select("variant", "clip_id", F.col("right").alias("pred_right"), F.col("left").alias("pred_left"))
    ref = ct.tally(ref_tracks).select("clip_id", F.col("right").alias("ref_right"), F.col("left").alias("ref_left"))
    names = F.explode(F.array(*[F.lit(c.name) for c in configs])).alias("variant")
    grid = clips.select("clip_id", names).join(ref, "clip_id", "left").join(pred, ["variant", "clip_id"], "left").fillna(0)
    error, passages = F.sum(ct.absolute_error()), F.sum(F.col("ref_right") + F.col("ref_left"))
    return grid.groupBy("variant").agg(
        error.alias("errors"), F.sum(ct.missed()).alias("missed"), F.sum(ct.false_passages()).alias("false_passages"), ct.ratio(error, passages).alias("nmae")
    )


def passage_errors(reference: DataFrame, predicted: DataFrame, rc: DataFrame, pc: DataFrame) -> DataFrame:
    """Passage-level errors on both sides of one variant's tracks; one row. ``rc`` and ``pc``: the
    counted trajectories of both, stored."""
    f = materialize(mt.match_features(mt.match_tracks(reference, predicted), rc, pc))
    both = mt.reference_outcomes(f, rc).select("outcome").unionByName(mt.predicted_outcomes(f, pc).select("outcome"))
    return both.agg(F.count(F.when(F.col("outcome") != "counted", 1)).alias("passage_errors"))


def grid_product(base: Any, vary: Mapping[str, Sequence[Any]]) -> list[Any]:
    """Configurations over the product of values, named after them."""
    named = [(",".join(f"{k}={v}" for k, v in values.items()), values) for values in settings({"vary": vary})]
    return [dataclasses.replace(base, name=name, **values) for name, values in named]


Variant = tuple[tk.KalmanConfig, float | None, float | None]
TRACKER_FIELDS = frozenset(f.name for f in dataclasses.fields(tk.KalmanConfig)) - {"name", "score_threshold"}


def _section(where: str, given: Mapping[str, Any] | None, allowed: Collection[str]) -> dict[str, Any]:
    values = dict(given or {})
    if unknown := set(values) - set(allowed):
        raise ValueError(f"{where}: no such setting {sorted(unknown)}")
    return values


def pipeline_variants(plan: Mapping[str, Any]) -> list[Variant]:
    """Variants of a plan for :func:`analyses.ablation`: tracker, suppression IoU and containment.

    ``base`` has ``score_threshold`` and a ``tracker`` section. A variant may set
    ``score_threshold``, single fields of ``tracker`` (the others stay the base's) and
    ``suppression`` (``iou``, ``containment``; what it does not set is off). Anything else, a score
    threshold outside (0, 1) and a plan that does not begin with ``current`` are refused.
    """
    base = _section("base", plan["base"], ("score_threshold", "tracker"))
    tracker = _section("base tracker", base.get("tracker"), TRACKER_FIELDS)
    out: list[Variant] = []
    for name, overrides in plan["variants"].items():
        own = _section(name, overrides, ("score_threshold", "suppression", "tracker"))
        threshold = own.get("score_threshold", base["score_threshold"])
        if not 0 < threshold < 1:
            raise ValueError(f"{name}: score_threshold must lie between 0 and 1")
        fields = tracker | _section(f"{name} tracker", own.get("tracker"), TRACKER_FIELDS)
        suppression = _section(f"{name} suppression", own.get("suppression"), ("iou", "containment"))
        config = tk.KalmanConfig(name=name, score_threshold=threshold, **fields)
        out.append((config, suppression.get("iou"), suppression.get("containment")))
    if not out or out[0][0].name != "current":
        raise ValueError("variants begin with 'current'")
    return out


def tune(
    detections: DataFrame, ref_tracks: DataFrame, clips: DataFrame, base: tk.KalmanConfig, experiments: Sequence[Mapping[str, Sequence[Any]]],
    mx: float, my: float, width: int, height: int,
) -> tuple[tk.KalmanConfig, list[dict[str, Any]]]:
    """Coordinate descent: each experiment is one job over its whole grid, and the best values
    carry over. Evaluated settings are remembered. The log flags a best value at a grid's edge."""
    seen: dict[tuple, tuple[float, int]] = {}
    key = lambda c: tuple(v for k, v in dataclasses.asdict(c).items() if k != "name")

    def score(configs: Sequence[tk.KalmanConfig]) -> None:
        fresh = {key(c): c for c in configs if key(c) not in seen}
        if not fresh:
            return
        named = [dataclasses.replace(c, name=f"v{i}") for i, c in enumerate(fresh.values())]
        found = evaluate_trackers(detections, ref_tracks, clips, named, mx, my, width, height).collect()  # a row per setting
        for row in found:
            c = next(n for n in named if n.name == row["variant"])
            seen[key(c)] = (row["nmae"], row["errors"])

    best, log = base, []
    score([base])
    for vary in experiments:
        candidates = grid_product(best, vary)
        score(candidates)
        winner = min(candidates, key=lambda c: seen[key(c)])
        improved = seen[key(winner)] < seen[key(best)]
        edges = [n for n, v in vary.items() if len(v) > 2 and getattr(winner, n) in (v[0], v[-1])] if improved else []
        log.append({"vary": dict(vary), "best": winner.name, "nmae": seen[key(winner)][0], "kept": improved, "grid_edge": edges})
        best = winner if improved else best
    return best, log


def apply_variant(detections: DataFrame, variant: Variant) -> DataFrame:
    """The detections that a variant's tracker sees: above its threshold, without suppressed ones."""
    config, iou, containment = variant
    return mt.suppress_overlaps(detections.where(F.col("score") >= config.score_threshold), iou, containment)
