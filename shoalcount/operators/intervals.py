"""Interval work per recording: neighbours in time, free footage, point-in-window joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.operators.ordered import running
from shoalcount.session import materialize

BIN = 64


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))


def nearby_counts(probes: DataFrame, others: DataFrame, gap: int, own: Column, name: str = "nearby", key: str = "clip_id") -> DataFrame:
    """``probes`` with the number of ``others`` that overlap them or come within ``gap`` frames.

    Those that have begun by a track's end + gap, less those that ended before its start - gap:
    two running sums, no pairs. ``own`` tells whether the track itself is among the others.
    """
    def upto(rows: DataFrame, at: Column, of: Column, strict: bool, column: str) -> DataFrame:
        o = others.select(key, of.alias("__at"), F.lit(1).alias("__one"), F.lit(int(strict)).alias("__kind"))
        p = rows.withColumns({"__at": at, "__one": F.lit(0), "__kind": F.lit(int(not strict))})
        both = materialize(p.withColumn("__probe", F.lit(True)).unionByName(o.withColumn("__probe", F.lit(False)), allowMissingColumns=True))
        walked = running(both, [key], F.floor(F.col("__at") / 1024), [F.col("__at"), F.col("__kind")], F.col("__one"), column)
        return walked.where("__probe").select(*rows.columns, column)

    begun = upto(probes, F.col("end_frame") + gap, F.col("start_frame"), False, "__begun")
    done = upto(begun, F.col("start_frame") - gap, F.col("end_frame"), True, "__done")
    count = F.col("__begun") - F.col("__done") - own.cast("int")
    return done.withColumn(name, count.cast("bigint")).select(*probes.columns, name)


def sums_below(points: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """(key, probe, total): the weight of a probe's points that lie below ``y`` and came no later than ``at``.

    ``points``: key, x (not negative), at, weight; ``probes``: key, probe, y, at. A sweep along ``at``
    over blocks of x: [0, y) is one block for every bit set in y, a point lies in one block a
    level, so both become a few rows each and every block is a running sum. No pairs are formed,
    and a key of any size is spread over its blocks and stretches of ``at``.
    """
    reach = points.agg(F.max("x").alias("x")).crossJoin(probes.agg(F.max("y").alias("y"))).select(F.greatest("x", "y", F.lit(0)).alias("m")).first()["m"]
    levels = [F.lit(i).alias("level") for i in range(int(reach or 0).bit_length())] or [F.lit(0).alias("level")]
    # only even blocks are ever asked for: the odd ones are what a larger block holds
    held = F.filter(F.array(*[F.struct(lv, F.shiftright("x", i).alias("block")) for i, lv in enumerate(levels)]), lambda b: b["block"] % 2 == 0)
    bit = lambda i: F.shiftright("y", i).bitwiseAND(F.lit(1)) == 1
    asked = F.array(*[F.when((F.col("y") > 0) & bit(i), F.struct(lv, (F.shiftright("y", i + 1) * 2).cast("bigint").alias("block"))) for i, lv in enumerate(levels)])
    p = points.withColumn("b", F.explode(held)).select(key, "b.level", F.col("b.block").cast("bigint").alias("block"), "at", "weight", F.lit(None).cast("bigint").alias("probe"))
    q = probes.withColumn("b", F.explode(F.filter(asked, lambda b: b.isNotNull()))).select(key, "b.level", "b.block", "at", F.lit(0).cast("bigint").alias("weight"), "probe")
    both = materialize(p.unionByName(q))
    order = [F.col("at"), F.col("probe").isNotNull()]
    walked = running(both, [key, "level", "block"], F.floor(F.col("at") / 1024), order, F.col("weight"), "__sum")
    return walked.where("probe is not null").groupBy(key, "probe").agg(F.sum("__sum").alias("total"))


def has_nearby(probes: DataFrame, others: DataFrame, gap: int, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """``probes`` with a flag ``nearby``: does any of ``others`` come within ``gap`` frames?

    The two sides must be disjoint. No pairs are formed: the latest end among the others that
    start early enough decides, a running maximum over one sort.
    """
    o = others.select(*keys, F.col("start_frame").alias("__at"), F.col("end_frame").alias("__end"), F.lit(0).alias("__kind"))
    p = probes.withColumns({"__at": F.col("end_frame") + gap, "__end": F.lit(None).cast("bigint"), "__kind": F.lit(1)})
    both = p.unionByName(o, allowMissingColumns=True)
    order = [F.col("__at"), F.col("__kind")]
    seen = running(both, list(keys), F.floor(F.col("__at") / 1024), order, F.col("__end"), "__latest", fn="max")
    flag = F.coalesce(F.col("__latest") >= F.col("start_frame") - gap, F.lit(False))
    return seen.where("__kind = 1").withColumn("nearby", flag).select(*probes.columns, "nearby")


def free_runs(clips: DataFrame, flagged: DataFrame, margin: int, key: str = "clip_id") -> DataFrame:
    """Half-open runs of [0, num_frames) outside every flagged [first, last], each widened by
    ``margin`` frames."""
    sized = flagged.join(clips.select(key, "num_frames"), key)
    lo = F.greatest(F.lit(0), F.col("first") - margin)
    hi = F.greatest(F.lit(0), F.least(F.col("num_frames"), F.col("last") + 1 + margin))
    taken = sized.select(key, lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    walked = running(
        taken, [key], F.floor(F.col("lo") / 1024), [F.col("lo"), F.col("hi")], F.col("hi"), "prev", fn="max", exclusive=True
    )
    gaps = walked.select(key, F.coalesce("prev", F.lit(0)).alias("start_frame"), F.col("lo").alias("stop_frame"))
    ends = taken.groupBy(key).agg(F.max("hi").alias("end"))
    tail = clips.join(ends, key, "left").select(
        key, F.coalesce("end", F.lit(0)).alias("start_frame"), F.col("num_frames").alias("stop_frame")
    )
    return gaps.unionByName(tail).where("stop_frame > start_frame")


def points_in_windows(points: DataFrame, windows: DataFrame, frame: str = "frame_index", key: str = "clip_id") -> DataFrame:
    """Points whose frame lies in one of their recording's half-open windows (semi join on bins)."""
    w = windows.select(key, F.col("start_frame").alias("__lo"), F.col("stop_frame").alias("__hi")).where("__hi > __lo")
    w = w.withColumn("__bin", F.explode(_bins(F.col("__lo"), F.col("__hi") - 1))).withColumnRenamed(key, "__key")
    p = points.withColumn("__pbin", F.floor(F.col(frame) / BIN))
    on = (
        (F.col(key) == F.col("__key"))
        & (F.col("__pbin") == F.col("__bin"))
        & (F.col(frame) >= F.col("__lo"))
        & (F.col(frame) < F.col("__hi"))
    )
    return p.join(w, on, "left_semi").drop("__pbin")
