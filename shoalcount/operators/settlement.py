"""Which events of a review log were accepted, without walking the log.

An event is accepted if it is based on the job's revision of the moment and is valid; each
accepted event makes the next revision. So the one accepted at base r is the first valid event
based on r that comes after the one accepted at base r - 1.

Where the first valid events of all bases already ascend, they are the accepted ones: one
aggregate and one join on (job, base). That is so for every client that waits for a revision
before it builds on it. From the first base where a job's log does not ascend, every event
points to its successor (the next later event based on one revision more), and the chain from
the last certain event is found by doubling the pointers: as many rounds as the logarithm of
its length, for all such jobs at once. Nothing here is grouped by job: keys are (job, base) and
(job, event), so one job may hold any share of the log.

Rejecting an added passage is valid only if its addition was accepted. Such events are first
taken as valid; where a chain then holds one whose addition is not in it, what is certain up
to there decides about it and all others of its kind, and the rest is settled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.operators.ordered import running
from shoalcount.session import materialize, materialize_counted

UNKNOWN_JOB = "job has no result to review"
STALE = "stale revision"
UNKNOWN_PASSAGE = "unknown added passage"
ONLY_REJECTED = "added passages can only be rejected"

_NODE = ("job_id", "base", "event_id", "adds", "add_id", "add_base")


def on_passage() -> Column:
    """Whether an event is about an added passage (and neither adds one nor marks an audit)."""
    return F.col("passage_id").isNotNull() & ~F.coalesce(F.col("action").isin("add_passage", "mark_audited"), F.lit(False))


def _addition() -> Column:
    """The event that a passage's name says it was added by; null if no event could have."""
    n = F.expr("try_cast(substr(passage_id, 2) as bigint)")
    return F.when(F.concat(F.lit("p"), n.cast("string")) == F.col("passage_id"), n)


def _candidates(ready: DataFrame) -> DataFrame:
    """Events that may be accepted: valid but for what depends on earlier acceptance."""
    no = F.lit(None).cast("bigint")
    valid = ready.where(F.col("error").isNull() & (F.col("base") >= 0))
    plain = valid.where(~F.col("on_passage")).select("job_id", "base", "event_id", (F.col("action") == "add_passage").alias("adds"), no.alias("add_id"), no.alias("add_base"))
    added = valid.where("action = 'add_passage'").select("job_id", F.col("event_id").alias("add_id"), F.col("base").alias("add_base"))
    asked = valid.where(F.col("on_passage") & (F.col("action") == "reject")).join(added, ["job_id", "add_id"])
    return plain.unionByName(asked.where("add_id < event_id and add_base < base").withColumn("adds", F.lit(False)).select(*_NODE))


def _chain(candidates: DataFrame) -> DataFrame:
    """The events accepted if all candidates are valid."""
    first = candidates.groupBy("job_id", "base").agg(F.min(F.struct(*_NODE[2:])).alias("e")).select("job_id", "base", "e.*")
    before = first.select("job_id", (F.col("base") + 1).alias("base"), F.col("event_id").alias("prior"))
    linked = materialize(first.join(before, ["job_id", "base"], "left"))
    gap = F.min(F.when((F.col("base") > 0) & F.col("prior").isNull(), F.col("base")))
    twist = F.min(F.when(F.col("prior") >= F.col("event_id"), F.col("base")))
    ends = linked.where("(base > 0 and prior is null) or prior >= event_id").groupBy("job_id").agg(gap.alias("gap"), twist.alias("twist"))
    ends, twisted = materialize_counted(ends, F.coalesce(F.col("twist") < F.coalesce("gap", F.lit(2**62)), F.lit(False)))
    straight = linked.join(ends, "job_id", "left").where(F.col("base") < F.coalesce(F.least("gap", "twist"), F.lit(2**62))).select(*_NODE)
    if not twisted:
        return straight
    roots = linked.join(ends.where("twist < coalesce(gap, 4611686018427387904)"), "job_id").where(F.col("base") == F.col("twist") - 1)
    return straight.unionByName(_reached(candidates, roots.select("job_id", F.col("base").alias("root_base"), F.col("event_id").alias("root"))))


def _reached(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """The successors of each job's root, and theirs, by pointer doubling; the roots left out."""
    here = (F.col("base") == F.col("root_base")) & (F.col("event_id") == F.col("root"))
    later = (F.col("base") > F.col("root_base")) & (F.col("event_id") > F.col("root"))
    nodes = materialize(candidates.join(roots, "job_id").where(here | later).withColumn("on", here).drop("root", "root_base"))
    asking = nodes.select("job_id", (F.col("base") + 1).alias("base"), "event_id", F.lit(None).cast("bigint").alias("next"))
    offered = nodes.select("job_id", "base", "event_id", (-F.col("event_id")).alias("next"))
    both = materialize(asking.unionByName(offered))
    # ordered from the newest, the largest of the negated ids met so far is the nearest later event
    seen = running(both, ["job_id", "base"], F.floor(-F.col("event_id") / 4096), [-F.col("event_id")], F.col("next"), "nearest", fn="max")
    links = seen.where("next is null").select("job_id", "event_id", (-F.col("nearest")).alias("to"))
    walk, open_ends = materialize_counted(nodes.join(links, ["job_id", "event_id"]), F.col("on") & F.col("to").isNotNull())
    while open_ends:
        hit = walk.where("on and to is not null").select("job_id", F.col("to").alias("event_id"), F.lit(True).alias("hit"))
        jump = walk.select("job_id", F.col("event_id").alias("to"), F.col("to").alias("far"))
        wider = walk.join(jump, ["job_id", "to"], "left").join(hit, ["job_id", "event_id"], "left")
        wider = wider.select(*_NODE, (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"), F.col("far").alias("to"))
        walk, open_ends = materialize_counted(wider, F.col("on") & F.col("to").isNotNull())
    return walk.where("on").join(roots.select("job_id", F.col("root").alias("event_id")), ["job_id", "event_id"], "left_anti").select(*_NODE)


def settle(ready: DataFrame) -> DataFrame:
    """Per event job_id, event_id, accepted, resulting_revision, refusal.

    ``ready``: job_id, event_id (unique within a job, in order of arrival), base_revision, action,
    passage_id, error (why the event is invalid whatever was accepted before, or null).
    """
    ready = materialize(
        ready.select(
            "job_id", F.col("event_id").cast("bigint").alias("event_id"), F.col("base_revision").cast("bigint").alias("base"), "action", "error",
            F.coalesce(on_passage(), F.lit(False)).alias("on_passage"), _addition().alias("add_id"),
        )
    )
    candidates = materialize(_candidates(ready))
    while True:
        chain = materialize(_chain(candidates))
        kept = chain.select("job_id", F.col("event_id").alias("add_id"))
        unmet = chain.where("add_id is not null").join(kept, ["job_id", "add_id"], "left_anti").groupBy("job_id").agg(F.min("base").alias("at"))
        unmet, jobs = materialize_counted(unmet, F.lit(True))
        if not jobs:
            break
        # additions based on less than "at" are settled: who waits for one that is not in the chain is out
        certain = candidates.join(unmet, "job_id", "left").join(kept.withColumn("kept", F.lit(True)), ["job_id", "add_id"], "left")
        out = F.col("add_id").isNotNull() & F.col("kept").isNull() & (F.col("add_base") < F.col("at"))
        candidates = materialize(certain.where(~F.coalesce(out, F.lit(False))).select(*_NODE))
    return _verdicts(ready, chain)


def _verdicts(ready: DataFrame, chain: DataFrame) -> DataFrame:
    no = F.lit(None).cast("bigint")
    since = chain.select("job_id", (F.col("base") + 1).alias("base"), F.col("event_id").alias("after"), no.alias("until"))
    until = chain.select("job_id", "base", no.alias("after"), F.col("event_id").alias("until"))
    spans = since.unionByName(until).groupBy("job_id", "base").agg(F.max("after").alias("after"), F.max("until").alias("until"))
    made = chain.where("adds").select("job_id", F.col("event_id").alias("add_id"), F.lit(True).alias("made"))
    e = ready.join(spans, ["job_id", "base"], "left").join(made, ["job_id", "add_id"], "left")
    current = ((F.col("base") == 0) | (F.col("after") < F.col("event_id"))) & (F.col("until").isNull() | (F.col("event_id") <= F.col("until")))
    known = F.coalesce(F.col("made") & (F.col("add_id") < F.col("event_id")), F.lit(False))
    refusal = (
        F.when(F.coalesce(F.col("error") == UNKNOWN_JOB, F.lit(False)), F.lit(UNKNOWN_JOB))
        .when(~F.coalesce(current, F.lit(False)), F.lit(STALE))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("on_passage") & ~known, F.lit(UNKNOWN_PASSAGE))
        .when(F.col("on_passage") & (F.col("action") != "reject"), F.lit(ONLY_REJECTED))
    )
    e = e.withColumn("refusal", refusal).withColumn("accepted", F.col("refusal").isNull())
    return e.select("job_id", "event_id", "accepted", F.when(F.col("accepted"), F.col("base") + 1).alias("resulting_revision"), "refusal")
