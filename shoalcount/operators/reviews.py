"""The review log: acceptance of events, decisions, counts at a revision, reports.

Everything that does not depend on earlier acceptance is checked first in column expressions;
``settlement`` then finds the accepted events of whole logs by joins on (job, revision), and
``step`` says the same of one event after another for a stream. Decisions are ordinary
aggregates over the accepted events.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.operators.counting import ratio, river_direction
from shoalcount.operators.intervals import sums_below
from shoalcount.operators.ordered import previous, running
from shoalcount.operators.settlement import ONLY_REJECTED, STALE, UNKNOWN_JOB, UNKNOWN_PASSAGE, settle
from shoalcount.session import materialize

PAYLOAD = "action string, track_id bigint, passage_id string, direction string, frame_index bigint, audit_window int, reason string"
ACTIONS = ("accept", "reject", "set_direction", "mark_unresolved", "add_passage", "mark_audited")
# Decision states by action on a track.
TRACK_STATES = {"accept": "accepted", "reject": "rejected", "set_direction": "corrected", "mark_unresolved": "unresolved"}
VERDICT_SCHEMA = "job_id long, event_id long, accepted boolean, resulting_revision long, refusal string"


def parse_payload(json_text: Column) -> Column:
    return F.from_json(json_text, PAYLOAD)


def static_error() -> Column:
    """Why an event is invalid whatever was accepted before, or null. Expects the payload's
    columns and ``known_job``, ``num_frames``, ``audit_windows``, ``known_track``."""
    action, window = F.col("action"), F.col("audit_window")
    on_window = action.isin("add_passage", "mark_audited")
    return (
        F.when(F.col("known_job").isNull(), UNKNOWN_JOB)
        .when(window.isNotNull() & ~on_window, "audit_window goes with add_passage or mark_audited")
        .when(window.isNotNull() & ~((window >= 0) & (window < F.col("audit_windows"))), "audit_window out of range")
        .when((action == "mark_audited") & window.isNull(), "mark_audited needs an audit_window")
        .when(
            (action == "add_passage") & (F.col("direction").isNull() | F.col("frame_index").isNull()),
            "add_passage needs a direction and a frame_index",
        )
        .when(
            (action == "add_passage") & ~((F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("num_frames"))),
            "frame_index out of range",
        )
        .when(on_window | F.col("passage_id").isNotNull(), None)
        .when(F.coalesce(F.col("known_track"), F.lit(False)) == False, "unknown track")  # noqa: E712
        .when(~action.isin(*ACTIONS), "unknown action")
    )


def prepare(events: DataFrame, tracks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with their static verdict: only what acceptance needs. Events of an unknown job stay, as refused."""
    known = tracks.select("job_id", "track_id", F.lit(True).alias("known_track"))
    there = jobs.select("job_id", "num_frames", "audit_windows", F.lit(True).alias("known_job"))
    e = events.join(known, ["job_id", "track_id"], "left").join(there, "job_id", "left")
    return e.select("job_id", "event_id", "base_revision", "action", "passage_id", static_error().alias("error"))


def step(revision: int, passages: set[str], event_id: int, base: int, action: str, passage: str | None, error: str | None):
    """(refusal or None) for the next event of a job; updates ``passages``."""
    if error == UNKNOWN_JOB:
        return error
    if base != revision:
        return STALE
    if error is not None:
        return error
    if action == "add_passage":
        passages.add(f"p{event_id}")
    elif action != "mark_audited" and passage is not None:
        if passage not in passages:
            return UNKNOWN_PASSAGE
        if action != "reject":
            return ONLY_REJECTED
    return None


def fold_reviews(events: DataFrame, tracks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per event: accepted and its revision, or the reason it was refused."""
    return settle(prepare(events, tracks, jobs))


def accepted_events(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    ok = verdicts.where("accepted").select("job_id", "event_id", "resulting_revision")
    return events.join(ok, ["job_id", "event_id"])


def as_of(accepted: DataFrame, revision: Column | None = None) -> DataFrame:
    """Accepted events up to a revision (all by default)."""
    return accepted if revision is None else accepted.where(F.col("resulting_revision") <= revision)


def track_decisions(accepted: DataFrame, tracks: DataFrame) -> DataFrame:
    """The latest decision per (job, track): last write wins. One aggregate, no window."""
    on_track = F.col("passage_id").isNull() & F.col("action").isin(*TRACK_STATES)
    last = F.max_by(F.struct("action", "direction", "event_id"), "event_id")
    d = accepted.where(on_track).groupBy("job_id", "track_id").agg(last.alias("d"))
    state = F.element_at(F.create_map(*[F.lit(x) for kv in TRACK_STATES.items() for x in kv]), F.col("d.action"))
    auto = tracks.select("job_id", "track_id", F.col("direction").alias("automatic"))
    direction = F.when(F.col("d.action") == "accept", F.col("automatic")).when(F.col("d.action") == "set_direction", F.col("d.direction"))
    return d.join(auto, ["job_id", "track_id"]).select(
        "job_id", "track_id", state.alias("state"), direction.alias("direction"), F.col("d.event_id").alias("event_id")
    )


def passages(accepted: DataFrame) -> DataFrame:
    """Added passages with their state."""
    gone = accepted.where(F.col("passage_id").isNotNull() & ~F.col("action").isin("add_passage", "mark_audited"))
    gone = gone.select("job_id", "passage_id", F.lit("rejected").alias("state")).distinct()
    added = accepted.where(F.col("action") == "add_passage").select(
        "job_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("passage_id"), "direction", "frame_index", "audit_window"
    )
    return added.join(gone, ["job_id", "passage_id"], "left").withColumn("state", F.coalesce("state", F.lit("added")))


def audits(accepted: DataFrame) -> DataFrame:
    return accepted.where(F.col("action") == "mark_audited").select("job_id", "audit_window").distinct()


def track_outcomes(tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every track with its review state and final direction."""
    d = decisions.select("job_id", "track_id", "state", F.col("direction").alias("decided"))
    out = tracks.join(d, ["job_id", "track_id"], "left")
    return out.withColumns(
        {
            "review_state": F.coalesce("state", F.lit("automatic")),
            "final_direction": F.when(F.col("state").isNull(), F.col("direction")).otherwise(F.col("decided")),
        }
    ).drop("state", "decided")


def reviewed_counts(outcomes: DataFrame, added: DataFrame) -> DataFrame:
    """Counts of a revision per job."""
    n = lambda cond: F.count(F.when(cond, 1))
    live = F.col("review_state") != "unresolved"
    t = outcomes.groupBy("job_id").agg(
        n(live & (F.col("final_direction") == "right")).alias("right"),
        n(live & (F.col("final_direction") == "left")).alias("left"),
        F.count(F.lit(1)).alias("tracks"),
        n(F.col("review_state") != "automatic").alias("reviewed_tracks"),
        n(~live).alias("unresolved"),
    )
    p = added.where("state = 'added'").groupBy("job_id").agg(
        n(F.col("direction") == "right").alias("pr"), n(F.col("direction") == "left").alias("pl"), F.count(F.lit(1)).alias("added_passages")
    )
    out = t.join(p, "job_id", "left").fillna(0, ["pr", "pl", "added_passages"])
    return out.withColumns({"right": F.col("right") + F.col("pr"), "left": F.col("left") + F.col("pl")}).drop("pr", "pl")


def audit_windows_view(windows: DataFrame, checked: DataFrame, added: DataFrame) -> DataFrame:
    """Audit windows (job, audit_window, start, stop) with state and passages added."""
    done = checked.select("job_id", "audit_window", F.lit("checked").alias("state"))
    found = added.where("state = 'added' and audit_window is not null").groupBy("job_id", "audit_window").agg(
        F.count(F.lit(1)).alias("passages_added")
    )
    out = windows.join(done, ["job_id", "audit_window"], "left").join(found, ["job_id", "audit_window"], "left")
    return out.withColumn("state", F.coalesce("state", F.lit("pending"))).fillna(0, ["passages_added"])


def audit_totals(view: DataFrame, unflagged: DataFrame) -> DataFrame:
    frames = F.col("stop_frame") - F.col("start_frame")
    done = F.col("state") == "checked"
    t = view.groupBy("job_id").agg(
        F.count(F.when(done, 1)).alias("windows_checked"),
        F.coalesce(F.sum(F.when(done, frames)), F.lit(0)).alias("checked_frames"),
        F.sum("passages_added").alias("passages_added_in_audits"),
    )
    return t.join(unflagged, "job_id").withColumn(
        "checked_fraction_of_unflagged", F.round(ratio(F.col("checked_frames"), F.col("unflagged_frames")), 9)
    )


def latest_revision(revisions: DataFrame, values: Sequence[str], at: int | None = None) -> DataFrame:
    """The newest revision per job, or the newest not after ``at``."""
    r = revisions if at is None else revisions.where(F.col("revision") <= at)
    return r.groupBy("job_id").agg(F.max("revision").alias("revision"), F.max_by(F.struct(*values), "revision").alias("v")).select(
        "job_id", "revision", "v.*"
    )


def counts_now() -> Column:
    """Whether a track of :func:`track_outcomes` adds to the counts."""
    return (F.col("review_state") != "unresolved") & F.col("final_direction").isNotNull()


def decision_history(accepted: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per track the revisions [from_revision, to_revision) over which it adds to the count."""
    on_track = F.col("passage_id").isNull() & F.col("action").isin(*TRACK_STATES)
    changes = accepted.where(on_track).join(tracks.select("job_id", "track_id", F.col("direction").alias("auto")), ["job_id", "track_id"])
    counts = (
        F.when(F.col("action") == "accept", F.col("auto").isNotNull())
        .when(F.col("action") == "set_direction", F.col("direction").isNotNull())
        .otherwise(False)
    )
    moves = changes.select("job_id", "track_id", F.col("resulting_revision").alias("rev"), counts.alias("counts"))
    start = tracks.select("job_id", "track_id", F.lit(0).cast("bigint").alias("rev"), F.col("direction").isNotNull().alias("counts"))
    every = moves.unionByName(start)
    # Ordered from the newest, the preceding row is the next change.
    walked = previous(
        every.withColumn("neg", -F.col("rev")), ["job_id", "track_id"], F.floor(-F.col("rev") / 1024), [F.col("neg")], ["rev"], "next_"
    )
    return walked.where("counts").select(
        "job_id", "track_id", F.col("rev").alias("from_revision"), F.coalesce("next_rev", F.lit(2**62)).alias("to_revision")
    )


def replay(accepted: DataFrame, tracks: DataFrame, gap: int = 10) -> DataFrame:
    """The "count" decisions with the number of counted tracks near them at their base revision.

    A count decision sets a direction on a track the automatic result did not count. Every
    stretch of revisions over which a track counts is one more at its first and one less after
    its last; near are those that begin by the end of the decision's track, less those that end
    before it begins, less the track itself.
    """
    spans = materialize(decision_history(accepted, tracks))
    frames = tracks.select("job_id", "track_id", "start_frame", "end_frame")
    uncounted = tracks.where("direction is null").select("job_id", "track_id", "start_frame", "end_frame")
    asked = materialize(
        accepted.where("action = 'set_direction' and passage_id is null").join(uncounted, ["job_id", "track_id"])
        .select("job_id", "event_id", "base_revision", "track_id", "direction", "start_frame", "end_frame")
    )
    one = F.lit(1).cast("bigint")
    moves = spans.select("job_id", "track_id", F.col("from_revision").alias("at"), one.alias("weight")).unionByName(
        spans.where(F.col("to_revision") < 2**62).select("job_id", "track_id", F.col("to_revision").alias("at"), (-one).alias("weight"))
    )
    placed = moves.join(frames, ["job_id", "track_id"])

    def below(x: str, y: Column) -> DataFrame:
        points = placed.select("job_id", F.col(x).cast("bigint").alias("x"), "at", "weight")
        probes = asked.select("job_id", F.col("event_id").alias("probe"), y.cast("bigint").alias("y"), F.col("base_revision").alias("at"))
        return sums_below(points, probes, "job_id").withColumnRenamed("probe", "event_id").withColumnRenamed("total", f"by_{x}")

    own = moves.select("job_id", "track_id", "at", "weight", F.lit(None).cast("bigint").alias("event_id")).unionByName(
        asked.select("job_id", "track_id", F.col("base_revision").alias("at"), (one * 0).alias("weight"), "event_id")
    )
    own = running(materialize(own), ["job_id", "track_id"], F.floor(F.col("at") / 1024), [F.col("at"), F.col("event_id").isNotNull()], F.col("weight"), "own")
    out = asked.join(below("start_frame", F.col("end_frame") + gap + 1), ["job_id", "event_id"], "left")
    out = out.join(below("end_frame", F.col("start_frame") - gap), ["job_id", "event_id"], "left")
    out = out.join(own.where("event_id is not null").select("job_id", "event_id", "own"), ["job_id", "event_id"])
    near = F.coalesce("by_start_frame", F.lit(0)) - F.coalesce("by_end_frame", F.lit(0)) - F.col("own")
    return out.select("job_id", "event_id", "base_revision", "track_id", "direction", near.alias("counted_nearby"))


def replay_coverage(decisions: DataFrame, rate: DataFrame, groups: DataFrame) -> DataFrame:
    """Question coverage per group and overall. ``rate``: uncounted tracks per job and how many
    of them would show the question."""
    per = decisions.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("count_decisions"), F.count(F.when(F.col("counted_nearby") > 0, 1)).alias("asked")
    )
    joined = groups.join(per, "job_id", "left").join(rate, "job_id", "left").fillna(0)
    cols = ("count_decisions", "asked", "uncounted_tracks", "with_question")
    return joined.rollup("group").agg(*[F.sum(c).alias(c) for c in cols])


def report_rows(outcomes: DataFrame, added: DataFrame, framerate: float, upstream: Column) -> DataFrame:
    """Flat report: one row per track and per added passage; blanks where a value is absent."""
    t = outcomes.select(
        "job_id", F.lit("track").alias("kind"), F.col("track_id").cast("string").alias("id"), "start_frame", "end_frame",
        (F.col("start_frame") / framerate).alias("start_time_s"), (F.col("end_frame") / framerate).alias("end_time_s"),
        F.col("direction").alias("automatic_direction"), "review_state", "final_direction",
        river_direction(F.col("final_direction"), upstream).alias("final_river_direction"),
    )
    live = F.when(F.col("state") == "added", F.col("direction"))
    p = added.select(
        "job_id", F.lit("added_passage").alias("kind"), F.col("passage_id").alias("id"), F.col("frame_index").alias("start_frame"),
        F.col("frame_index").alias("end_frame"), (F.col("frame_index") / framerate).alias("start_time_s"),
        (F.col("frame_index") / framerate).alias("end_time_s"), F.col("state").alias("review_state"),
        live.alias("final_direction"), river_direction(live, upstream).alias("final_river_direction"),
    )
    return t.unionByName(p, allowMissingColumns=True)


def report_header(counts: DataFrame, automatic: DataFrame, upstream: Column) -> DataFrame:
    """The report's key/value preamble, one row per entry."""
    both = counts.join(automatic.select("job_id", F.col("right").alias("auto_right"), F.col("left").alias("auto_left")), "job_id")
    up = upstream

    def river(p: str) -> dict[str, Column]:
        r, left = F.col(f"{p}right"), F.col(f"{p}left")
        u = F.when(up == "right", r).when(up == "left", left)
        dn = F.when(up == "right", left).when(up == "left", r)
        return {"right": r, "left": left, "upstream": u, "downstream": dn, "net_upstream": u - dn}

    entries = [(f"automatic_{k}", v) for k, v in river("auto_").items()] + [(f"reviewed_{k}", v) for k, v in river("").items()]
    entries.append(("reviewed_unresolved", F.col("unresolved")))
    kv = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in entries])
    return both.select("job_id", F.explode(kv).alias("kv")).select("job_id", "kv.key", "kv.value")


# --- the nested report, in sections ---------------------------------------------------------

#: The report's parts in order; those marked are lists of entries.
SECTIONS = {
    "recording": False, "counting": False, "pipeline": False, "job": False, "revision": False, "revision_kind": False, "counts": False,
    "unresolved": True, "tracks": True, "added_passages": True, "audit": False, "audit_windows": True, "review_events": True,
}


def counts_view(counts: dict[str, Column], upstream: Column) -> Column:
    """Right, left, and both by the river's direction (null where that is not known), and the rest as it is."""
    up = F.when(upstream == "right", counts["right"]).when(upstream == "left", counts["left"])
    down = F.when(upstream == "right", counts["left"]).when(upstream == "left", counts["right"])
    named = {"right": counts["right"], "left": counts["left"], "upstream": up, "downstream": down, "net_upstream": up - down}
    return F.struct(*[c.alias(k) for k, c in {**named, **{k: c for k, c in counts.items() if k not in named}}.items()])


def report_sections(
    headers: DataFrame, automatic: DataFrame, outcomes: DataFrame, added: DataFrame, audit: DataFrame, totals: DataFrame, history: DataFrame, framerate: str = "recording.framerate"
) -> DataFrame:
    """A job's report as rows (job_id, section, place, label, body): one a part, one an entry of a list.

    ``headers``: job_id, upstream (right, left or null) and structs recording, counting, pipeline and job. ``automatic``
    has right and left per job; the others are the tables of one revision: :func:`track_outcomes`,
    :func:`passages`, :func:`audit_windows_view`, :func:`audit_totals` and accepted events up to it.
    Entries stand in order of ``place``, then ``label``. No job is ever one row.
    """
    number = {name: i for i, name in enumerate(SECTIONS)}
    made = F.to_json

    def rows(df: DataFrame, name: str, body: Column, place: Column | None = None, label: Column | None = None) -> DataFrame:
        at = F.lit(0) if place is None else place
        text = F.lit("") if label is None else label
        return df.select("job_id", F.lit(number[name]).alias("section"), at.cast("bigint").alias("place"), text.alias("label"), body.alias("body"))

    known = headers.select("job_id", "upstream", F.col(framerate).alias("rate"))
    keep = {"ignoreNullFields": "false"}
    latest = headers.select("job_id").join(history.groupBy("job_id").agg(F.max("resulting_revision").alias("r")), "job_id", "left")
    latest = latest.select("job_id", F.coalesce("r", F.lit(0)).alias("r"))
    parts = [rows(headers, name, made(name, keep)) for name in ("recording", "counting", "pipeline", "job")]
    parts.append(rows(latest, "revision", F.col("r").cast("string")))
    parts.append(rows(latest, "revision_kind", F.when(F.col("r") == 0, '"automatic"').otherwise('"reviewed"')))

    now = reviewed_counts(outcomes, added)
    auto = {"right": F.coalesce("auto_right", F.lit(0)), "left": F.coalesce("auto_left", F.lit(0))}
    both = known.join(latest, "job_id").join(now, "job_id", "left").join(
        automatic.select("job_id", F.col("right").alias("auto_right"), F.col("left").alias("auto_left")), "job_id", "left"
    )
    reviewed = counts_view({c: F.coalesce(c, F.lit(0)) for c in now.columns if c != "job_id"}, F.col("upstream"))
    view = F.struct(counts_view(auto, F.col("upstream")).alias("automatic"), F.when(F.col("r") > 0, reviewed).alias("reviewed"))
    parts.append(rows(both, "counts", made(view, keep)))

    t = outcomes.join(known, "job_id")
    extra = [c for c in ("mean_score", "triage", "review_score", "review_reasons") if c in outcomes.columns]
    entry = F.struct(
        "track_id", "start_frame", "end_frame", (F.col("start_frame") / F.col("rate")).alias("start_time_s"), (F.col("end_frame") / F.col("rate")).alias("end_time_s"),
        F.col("direction").alias("automatic_direction"), "review_state", "final_direction",
        river_direction(F.col("final_direction"), F.col("upstream")).alias("final_river_direction"), *extra,
    )
    parts.append(rows(t.where("review_state = 'unresolved'"), "unresolved", made(entry, keep), F.col("track_id")))
    parts.append(rows(t, "tracks", made(entry, keep), F.col("track_id")))

    river = river_direction(F.col("direction"), F.col("upstream")).alias("river_direction")
    p = F.struct("passage_id", "state", "direction", river, "frame_index", (F.col("frame_index") / F.col("rate")).alias("time_s"))
    parts.append(rows(added.join(known, "job_id"), "added_passages", made(p, keep), None, F.col("passage_id")))
    parts.append(rows(totals.join(known.select("job_id"), "job_id", "left_semi"), "audit", made(F.struct(*[c for c in totals.columns if c != "job_id"]), keep)))
    w = F.struct(*[c for c in audit.columns if c != "job_id"])
    parts.append(rows(audit.join(known.select("job_id"), "job_id", "left_semi"), "audit_windows", made(w, keep), F.col("audit_window")))
    fields = [c for c in ("event_id", "base_revision", "resulting_revision", "action", "track_id", "passage_id", "direction", "frame_index", "audit_window", "reason") if c in history.columns]
    parts.append(rows(history.join(known.select("job_id"), "job_id", "left_semi"), "review_events", made(F.struct(*fields)), F.col("event_id")))
    return reduce(DataFrame.unionByName, parts)


def report_text(sections: DataFrame) -> DataFrame:
    """(job_id, section, place, label, text): a job's texts in that order, laid end to end, are its JSON document."""
    names = list(SECTIONS)
    title = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("section") + 1)
    lists = [i for i, n in enumerate(names) if SECTIONS[n]]
    order = F.struct("place", "label")
    first = sections.groupBy("job_id", "section").agg(F.min(order).alias("first"))
    s = sections.join(first, ["job_id", "section"])
    body = F.when(F.col("section").isin(lists), F.concat(F.when(order > F.col("first"), ",").otherwise(""), "body"))
    entries = s.select("job_id", "section", "place", "label", body.otherwise(F.concat(F.lit(',"'), title, F.lit('":'), "body")).alias("text"))
    low, high = -(2**63), 2**63 - 1
    frame = [(-1, low, '{"report_version":1'), (len(names), high, "}")]
    frame += [(i, p, x) for i in lists for p, x in ((low, f',"{names[i]}":['), (high, "]"))]
    edges = F.array(*[F.struct(F.lit(i).alias("section"), F.lit(p).cast("bigint").alias("place"), F.lit("").alias("label"), F.lit(x).alias("text")) for i, p, x in frame])
    return sections.select("job_id").distinct().select("job_id", F.explode(edges).alias("e")).select("job_id", "e.*").unionByName(entries)


def write_reports(text: DataFrame, path: str) -> None:
    """Reports in order of job and section over files of even size: a job is a stretch of lines, of one file or several."""
    order = ("job_id", "section", "place", "label")
    text.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)
