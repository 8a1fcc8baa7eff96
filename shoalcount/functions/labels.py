"""Human-readable labels and text formats at the report boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain-language reasons and states.
REASON_LABELS = {
    "back_and_forth": "moves back and forth",
    "endpoint_on_line": "starts or ends on the counting line",
    "possible_missed_passage": "may be part of a missed passage",
    "detection": "weak detections",
    "duration": "short track",
    "continuity": "gaps in the track",
    "motion": "irregular motion",
    "separation": "overlaps another track",
    "line_distance": "starts or ends near the line",
}
STATE_LABELS = {
    "automatic": "not reviewed",
    "accepted": "accepted",
    "rejected": "rejected",
    "corrected": "corrected",
    "unresolved": "unresolved",
}
UNCOUNTED_REASONS = {
    "stationary": "Not counted: the track barely moves.",
    "no_crossing": (
        "Not counted: the track does not end on the other side of the counting line "
        "(a fish that crosses and comes back counts zero). It may be a piece of a fish that "
        "another track already counts."
    ),
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def reason_text(reasons: Column) -> Column:
    """Labels of all reasons, comma-separated; unknown reasons as they are."""
    known = _lookup(REASON_LABELS)
    return F.array_join(F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.coalesce(F.try_element_at(known, r), r)), ", ")


def state_label(state: Column) -> Column:
    return F.try_element_at(_lookup(STATE_LABELS), state)


def uncounted_reason(outcome: Column) -> Column:
    return F.try_element_at(_lookup(UNCOUNTED_REASONS), outcome)


def direction_label(direction: Column, upstream: Column) -> Column:
    arrow = F.when(direction == "right", "→").otherwise("←")
    river = F.when(upstream.isNull(), direction).when(direction == upstream, "upstream").otherwise("downstream")
    return F.when(direction.isNull(), "no passage").otherwise(F.concat(arrow, F.lit(" "), river))


def format_time(seconds: Column) -> Column:
    """m:ss.s"""
    minutes = F.floor(seconds / 60)
    return F.format_string("%d:%04.1f", minutes, seconds - minutes * 60)


def iso(moment: Column) -> Column:
    """ISO-8601 UTC text with microseconds; sorts in time order."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
