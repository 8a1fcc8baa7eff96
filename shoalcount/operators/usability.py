"""Usability study: time ratios, errors and questionnaires by participant and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount import schemas
from shoalcount.functions.hashing import drawn, hash32
from shoalcount.operators.counting import ratio
from shoalcount.operators.stats import DRAWS, dense_index, draw_sums, interval, numbered, packed, resample
from shoalcount.session import materialize

# The study's targets and names.
TARGET_SAVING = 0.30
MIN_GROUP = 3
DEVELOPER_PREFIX = "D"
CONDITIONS = ("manual", "assisted")


def scored_trials(trials: DataFrame, plan: DataFrame, excluded: DataFrame) -> DataFrame:
    """Trials without practice and exclusions, with the plan's counts and per-trial errors.

    A trial whose clip is not in the plan raises while the job runs.
    """
    kept = trials.where(~F.col("practice")).join(excluded.select("participant", "clip"), ["participant", "clip"], "left_anti")
    t = kept.join(plan.withColumn("__planned", F.lit(True)), "clip", "left")
    lost = F.raise_error(F.concat(F.lit("no clip "), F.col("clip"), F.lit(" in the plan")))
    t = t.withColumn("clip", F.when(F.col("__planned"), F.col("clip")).otherwise(lost.cast("string"))).drop("__planned")
    dist = lambda p, side: F.abs(F.col(f"{p}_{side}") - F.col(f"ref_{side}"))
    change = [dist("auto", s) - dist("final", s) for s in ("right", "left")]
    zero = F.lit(0)
    return t.withColumns(
        {
            "active_s": F.col("active_ms") / 1000.0,
            "error": dist("final", "right") + dist("final", "left"),
            "auto_error": dist("auto", "right") + dist("auto", "left"),
            "passages": F.col("ref_right") + F.col("ref_left"),
            "fixed": F.greatest(change[0], zero) + F.greatest(change[1], zero),
            "introduced": F.greatest(-change[0], zero) + F.greatest(-change[1], zero),
        }
    )


def _pick(condition: str, col: str) -> Column:
    return F.sum(F.when(F.col("condition") == condition, F.col(col)))


def _n(condition: str) -> Column:
    return F.count(F.when(F.col("condition") == condition, 1))


def participant_results(trials: DataFrame) -> DataFrame:
    """Per participant: clips, mean times, time ratio (of means), nMAE by condition, errors
    fixed and introduced, and whether the target is met."""
    out = trials.groupBy("participant").agg(
        *[_n(c).alias(f"clips_{c}") for c in CONDITIONS],
        *[(_pick(c, "active_s") / _n(c)).alias(f"mean_s_{c}") for c in CONDITIONS],
        *[ratio(_pick(c, "error"), _pick(c, "passages")).alias(f"nmae_{c}") for c in CONDITIONS],
        ratio(_pick("assisted", "auto_error"), _pick("assisted", "passages")).alias("automatic_nmae"),
        _pick("assisted", "fixed").alias("errors_fixed"),
        _pick("assisted", "introduced").alias("errors_introduced"),
    )
    r = F.col("mean_s_assisted") / F.col("mean_s_manual")
    return out.withColumns(
        {
            "time_ratio": r,
            "time_saving": 1 - r,
            "nmae_difference": F.col("nmae_assisted") - F.col("nmae_manual"),
            "role": F.when(F.col("participant").startswith(DEVELOPER_PREFIX), "developer").otherwise("independent"),
            "target_met": (1 - r >= TARGET_SAVING) & (F.col("nmae_assisted") <= F.col("nmae_manual")),
        }
    )


_SUMS = ["active_s", "error", "passages", "one"]


def _wide(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys with the sums of both conditions side by side."""
    return sums.groupBy(*keys).agg(*[_pick(c, v).alias(f"{c}_{v}") for c in CONDITIONS for v in _SUMS])


def _time_ratio() -> Column:
    return (F.col("assisted_active_s") / F.col("assisted_one")) / (F.col("manual_active_s") / F.col("manual_one"))


def participant_intervals(trials: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """Intervals from resampling each participant's clips within each condition."""
    t = trials.withColumn("one", F.lit(1))
    sums = resample(t, ["participant", "condition"], "clip", _SUMS, resamples, seed, salt=["participant", "condition"])
    per = _wide(sums, ["participant", "draw"]).select(
        "participant", _time_ratio().alias("ratio"),
        (ratio(F.col("assisted_error"), F.col("assisted_passages")) - ratio(F.col("manual_error"), F.col("manual_passages"))).alias("diff"),
    )
    return per.groupBy("participant").agg(*interval("ratio", "time_ratio"), *interval("diff", "nmae_difference"))


def group_results(trials: DataFrame, strict: bool = True) -> DataFrame:
    """Geometric mean of the independent participants' ratios and the pooled nMAE; no row with
    fewer than three of them. A participant without trials in a condition raises; not ``strict``,
    such a person has no time ratio and only adds to the pooled counts."""
    people = trials.where(~F.col("participant").startswith(DEVELOPER_PREFIX))
    per = _wide(people.withColumn("one", F.lit(1)), ["participant"])
    lacking = F.raise_error(F.concat(F.col("participant"), F.lit(" has no trial in a condition")))
    whole = F.lit(not strict) | (F.col("manual_one").isNotNull() & F.col("assisted_one").isNotNull())
    per = per.withColumn("participant", F.when(whole, F.col("participant")).otherwise(lacking.cast("string")))
    out = per.agg(
        F.count("participant").alias("__people"),
        F.count(F.lit(1)).alias("participants"),
        F.exp(F.avg(F.log(_time_ratio()))).alias("time_ratio_geometric_mean"),
        *[ratio(F.sum(f"{c}_error"), F.sum(f"{c}_passages")).alias(f"nmae_{c}") for c in CONDITIONS],
    )
    out = out.where((F.col("participants") >= MIN_GROUP) & (F.col("__people") > 0)).drop("__people")
    out = out.withColumn("nmae_difference", F.col("nmae_assisted") - F.col("nmae_manual"))
    met = (1 - F.col("time_ratio_geometric_mean") >= TARGET_SAVING) & (F.col("nmae_difference") <= 0)
    return out.withColumn("target_met", F.coalesce(met, F.lit(False)))


def group_intervals(trials: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """Two-stage resampling: people with replacement, then each drawn person's clips within
    each condition."""
    t = trials.where(~F.col("participant").startswith(DEVELOPER_PREFIX)).withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    people = materialize(dense_index(t.select("g", "participant").distinct(), ["g"], "participant", "k"))
    size = people.groupBy("g").agg(F.count(F.lit(1)).alias("np"))
    slots = numbered(people.select("g", "k").join(size, "g"), "draw", resamples)
    person = drawn(hash32(seed, "people"), F.col("draw").cast("bigint"), F.col("k"), F.col("np"))
    asked = slots.select("g", (F.col("draw").cast("bigint") * F.col("np") + F.col("k")).alias("at"), F.floor(F.col("draw") / DRAWS).alias("bunch"), person.alias("k"))
    # a person is drawn once a draw on average: a bunch of draws is a piece of work
    chosen = asked.join(people, ["g", "k"]).groupBy("participant", "bunch").agg(F.sort_array(F.collect_list("at")).alias("draws"))

    keys = ["participant", "condition"]
    blocks = packed(t, keys, "clip", _SUMS)
    work = blocks.join(chosen.drop("bunch"), "participant").withColumn("stream", hash32(seed, F.col("condition")))
    sums = draw_sums(work, keys, _SUMS).join(F.broadcast(size.select("np")))  # one row
    sums = sums.withColumns({"slot": F.col("draw") % F.col("np"), "draw": F.floor(F.col("draw") / F.col("np"))})
    per = _wide(sums, ["draw", "slot"])
    sample = per.groupBy("draw").agg(
        F.exp(F.avg(F.log(_time_ratio()))).alias("ratio"),
        (ratio(F.sum("assisted_error"), F.sum("assisted_passages")) - ratio(F.sum("manual_error"), F.sum("manual_passages"))).alias("diff"),
    )
    return sample.agg(*interval("ratio", "time_ratio"), *interval("diff", "nmae_difference"))


def review_action_rows(trials: DataFrame, history: DataFrame, tracks: DataFrame) -> DataFrame:
    """The accepted review events behind each assisted trial's result, one row each, with the automatic track.

    ``trials`` has participant, clip, practice, condition, job_id and revision; events after that
    revision are left out. ``tracks``: job_id, track_id, outcome, direction, triage.
    """
    asked = trials.where("condition = 'assisted'").select("participant", "clip", "practice", "job_id", F.col("revision").alias("__last"))
    events = history.select("job_id", "event_id", "action", "track_id", "direction", "frame_index", "resulting_revision")
    auto = tracks.select("job_id", "track_id", *[F.col(c).alias(f"automatic_{c}") for c in ("outcome", "direction", "triage")])
    rows = asked.join(events, "job_id").where(F.col("resulting_revision") <= F.col("__last")).join(auto, ["job_id", "track_id"], "left")
    return rows.select(*schemas.REVIEW_ACTIONS.fieldNames())


ACTIONS = ("accept", "reject", "set_direction", "mark_unresolved", "add_passage", "mark_audited")


def review_actions(rows: DataFrame) -> DataFrame:
    """Scored review events by participant and action, and directions set on non-passages."""
    kept = rows.where(~F.col("practice"))
    on_none = (F.col("action") == "set_direction") & F.col("automatic_direction").isNull()
    return kept.groupBy("participant").agg(
        *[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ACTIONS],
        F.count(F.when(on_none, 1)).alias("set_direction_on_non_passages"),
    )


def sus_score(answers: Column) -> Column:
    """System usability score 0-100 from ten answers 1-5."""
    points = F.transform(answers, lambda a, i: F.when(i % 2 == 0, a - 1).otherwise(5 - a))
    return F.aggregate(points, F.lit(0), lambda acc, v: acc + v.cast("int")) * 2.5


def tlx_raw(answers: Column) -> Column:
    total = F.aggregate(answers, F.lit(0), lambda acc, v: acc + v.cast("int"))
    return total / F.size(answers)


def check_trials(trials: DataFrame, blocks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every trial with the reason it does not fit the plan, or null.

    ``blocks``: (participant, block, condition, clip); ``jobs``: (participant, clip, job_id).
    """
    people = blocks.select("participant").distinct().withColumn("known", F.lit(True))
    conditions = blocks.select("participant", "block", F.col("condition").alias("planned")).distinct()
    members = blocks.select("participant", "block", "clip", F.lit(True).alias("member")).distinct()
    j = jobs.select("participant", "clip", "job_id")
    out = (
        trials.join(people, "participant", "left")
        .join(conditions, ["participant", "block"], "left")
        .join(members, ["participant", "block", "clip"], "left")
        .join(j, ["participant", "clip"], "left")
    )
    manual = F.col("condition") == "manual"
    reason = (
        F.when(F.col("known").isNull(), "unknown participant")
        .when(~F.coalesce(F.col("planned") == F.col("condition"), F.lit(False)), "wrong condition for block")
        .when(F.col("member").isNull(), "clip not in block")
        .when(manual & (F.col("final_right").isNull() | F.col("final_left").isNull()), "manual trial needs both counts")
        .when(~manual & F.col("job_id").isNull(), "no job for clip")
    )
    return out.withColumn("reason", reason).drop("known", "planned", "member")
