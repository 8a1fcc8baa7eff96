"""How fast a review queue leads to the counting errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.functions.hashing import hash32
from shoalcount.operators.ordered import global_running_sum
from shoalcount.operators.stats import numbered
from shoalcount.session import materialize

COST = "decimal(18,6)"  # exact sums, so a budget boundary does not depend on addition order


def queue_items(tracks: DataFrame, framerate: Column, overhead_s: float = 3.0) -> DataFrame:
    """One item per predicted track: its review cost in seconds."""
    span = F.col("end_frame") - F.col("start_frame") + 1
    return tracks.select("clip_id", "track_id", (F.lit(overhead_s) + span / framerate).cast(COST).alias("cost_s"))


def reveals(features: DataFrame, ref_out: DataFrame, pred_out: DataFrame) -> DataFrame:
    """(clip, track, error_id): the errors that reviewing a predicted track shows."""
    missed = ref_out.where(F.col("outcome") != "counted").select("clip_id", F.col("track_id").alias("ref_id"))
    seen = features.select("clip_id", F.col("pred_id").alias("track_id"), "ref_id").join(missed, ["clip_id", "ref_id"])
    name = lambda kind, col: F.concat_ws(":", F.col("clip_id").cast("string"), F.lit(kind), F.col(col).cast("string"))
    of_ref = seen.select("clip_id", "track_id", name("missed", "ref_id").alias("error_id"))
    of_self = pred_out.where(F.col("outcome") != "counted").select("clip_id", "track_id", name("false", "track_id").alias("error_id"))
    return of_ref.unionByName(of_self)


def unreachable(ref_out: DataFrame, revealed: DataFrame) -> DataFrame:
    """Missed reference passages that no predicted track follows."""
    missed = ref_out.where(F.col("outcome") != "counted").select(
        "clip_id", "track_id",
        F.concat_ws(":", F.col("clip_id").cast("string"), F.lit("missed"), F.col("track_id").cast("string")).alias("error_id"),
    )
    return missed.join(revealed.select("error_id"), "error_id", "left_anti")


def _levels(budgets: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(b).cast("decimal(3,2)") for b in budgets])).alias("budget")


def _shares(first_seen: DataFrame, totals: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """Share of all and of reachable errors whose first item falls inside each budget."""
    found = first_seen.select("*", _levels(budgets)).crossJoin(F.broadcast(totals.select("total_cost")))
    found = found.where(F.col("seen_at") <= F.col("budget") * F.col("total_cost"))
    return _with_found(totals, found.groupBy("budget").agg(F.count(F.lit(1)).alias("found")), budgets, [])


def _with_found(totals: DataFrame, counted: DataFrame, budgets: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Shares from the errors found per (keys, budget)."""
    # one row per (keys, budget) even where no error is found: totals carry the keys
    grid = totals.select(*keys, "total_cost", "reachable", "unreachable", _levels(budgets))
    out = grid.join(counted, [*keys, "budget"], "left").fillna(0, ["found"])
    every = F.col("reachable") + F.col("unreachable")
    share = lambda den: F.when(den == 0, F.lit(1.0)).otherwise(F.col("found") / den)
    return out.select(*keys, "budget", share(every).alias("all_errors"), share(F.col("reachable")).alias("reachable_errors"))


def _error_totals(revealed: DataFrame, missing: DataFrame) -> DataFrame:
    reach = revealed.agg(F.countDistinct("error_id").alias("reachable"))
    return reach.crossJoin(missing.agg(F.count(F.lit(1)).alias("unreachable")))  # one row by one row


def found_curve(
    items: DataFrame, revealed: DataFrame, missing: DataFrame, budgets: Sequence[float], order: Sequence[Column]
) -> DataFrame:
    """Share of errors found within each share of the review time, reviewing in ``order``.

    ``order`` must end in (clip_id, track_id).
    """
    walked = global_running_sum(items, order, F.col("cost_s"), "cum")
    first = (
        walked.select("clip_id", "track_id", "cum").join(revealed, ["clip_id", "track_id"])
        .groupBy("error_id").agg(F.min("cum").alias("seen_at"))
    )
    totals = items.agg(F.sum("cost_s").alias("total_cost")).crossJoin(_error_totals(revealed, missing))  # one row
    return _shares(first, totals, budgets)


def _place(seed: int) -> Column:
    """An item's place in random order ``r``, before ties."""
    return hash32(F.lit(seed), F.col("r"), F.col("clip_id"), F.col("track_id"))


#: Buckets of an order, for finding where the budgets end; numbers of orders dealt out together.
BUCKETS, STEP = 512, 20


def _budget_ends(items: DataFrame, total: DataFrame, budgets: Sequence[float], repeats: int, seed: int) -> DataFrame:
    """(r, budget, last): the last item (h, clip_id, track_id) of each random order within each budget.

    Costs are summed per bucket of the order; only the buckets about a budget's end are sorted.
    A budget below the first item's cost has no row.
    """
    copies = numbered(items, "r", repeats, STEP).withColumn("h", _place(seed))
    copies = copies.withColumn("b", F.shiftright("h", 32 - (BUCKETS - 1).bit_length()).cast("int"))
    sums = materialize(copies.groupBy("r", "b").agg(F.sum("cost_s").alias("cost")))  # at most repeats x BUCKETS rows
    order = Window.partitionBy("r").orderBy("b")
    before = F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = total.select(_levels(budgets), "total_cost").select("budget", (F.col("budget") * F.col("total_cost")).alias("limit"))
    begun = sums.select("r", "b", before.alias("before"), F.lag("b").over(order).alias("previous"))
    begun = begun.crossJoin(F.broadcast(limits)).where("before <= limit")
    # a budget ends in the last bucket that begins within it, or with the whole bucket before that
    ends = begun.groupBy("r", "budget", "limit").agg(F.max_by(F.struct("b", "before", "previous"), "b").alias("e"))
    whole = lambda b, begin, all_: F.struct(F.col(b).alias("b"), begin.alias("before"), F.lit(all_).alias("whole"))
    near = materialize(ends.select("r", "budget", "limit", F.inline(F.array(
        whole("e.b", F.col("e.before"), False), whole("e.previous", F.col("e.before"), True)
    ))).where("b is not null"))
    inside = Window.partitionBy("r", "b").orderBy("h", "clip_id", "track_id").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = copies.join(F.broadcast(near.select("r", "b").distinct()), ["r", "b"])
    walked = sorted_.select("r", "b", F.struct("h", "clip_id", "track_id").alias("item"), F.sum("cost_s").over(inside).alias("run"))
    within = walked.join(F.broadcast(near), ["r", "b"]).where(F.col("whole") | (F.col("before") + F.col("run") <= F.col("limit")))
    return within.groupBy("r", "budget").agg(F.max("item").alias("last"))


def random_order_curve(
    items: DataFrame, revealed: DataFrame, missing: DataFrame, budgets: Sequence[float], repeats: int, seed: int = 0
) -> DataFrame:
    """The same curve averaged over ``repeats`` replayable random orders.

    An error is found within a budget if an item that shows it comes no later than the budget's
    last one, so an order is sorted only where the budgets end.
    """
    items = materialize(items.select("clip_id", "track_id", "cost_s"))
    total = items.agg(F.sum("cost_s").alias("total_cost"))  # one row
    last = _budget_ends(items, total, budgets, repeats, seed)
    rising = sorted(set(budgets))
    level = [F.lit(b).cast("decimal(3,2)") for b in rising]
    ends = last.groupBy("r").agg(*[F.max(F.when(F.col("budget") == b, F.col("last"))).alias(f"last{i}") for i, b in enumerate(level)])
    shows = revealed.join(items.select("clip_id", "track_id"), ["clip_id", "track_id"]).select("error_id", "clip_id", "track_id")
    # an error's rows stay together while their copies are made, so these are not moved
    dealt = shows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1), F.lit(STEP)))).repartition("error_id", "first")
    copies = dealt.withColumn("r", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + STEP - 1, F.lit(repeats - 1)))))
    item = copies.withColumn("item", F.struct(_place(seed).alias("h"), "clip_id", "track_id")).join(F.broadcast(ends), "r")
    reached = F.coalesce(*[F.when(F.col("item") <= F.col(f"last{i}"), b) for i, b in enumerate(level)])
    first = item.select("error_id", "first", "r", reached.alias("reached")).groupBy("error_id", "first", "r").agg(F.min("reached").alias("reached"))
    per_level = first.where("reached is not null").groupBy("r", "reached").agg(F.count(F.lit(1)).alias("n"))
    counted = per_level.select("*", _levels(rising)).where("reached <= budget").groupBy("r", "budget").agg(F.sum("n").alias("found"))
    totals = total.crossJoin(_error_totals(revealed, missing)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    per = _with_found(totals, counted, budgets, ["r"])
    return per.groupBy("budget").agg(
        F.round(F.avg("all_errors"), 9).alias("all_errors"), F.round(F.avg("reachable_errors"), 9).alias("reachable_errors")
    )
