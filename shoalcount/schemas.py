"""Fixed schemas of the tables at rest."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "array<string>": T.ArrayType(T.StringType()),
}


def _s(text: str) -> T.StructType:
    """A schema from 'name type' pairs; needs no running session, unlike the DDL parser."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BOXES = _s("clip_id bigint, track_id bigint, frame_index bigint, x_min double, y_min double, x_max double, y_max double, score double")
OBSERVATIONS = _s("track_id bigint, frame_index bigint, x_min double, y_min double, x_max double, y_max double, score double")
TRACKS = _s(
    "track_id bigint, start_frame bigint, end_frame bigint, start_time_s double, end_time_s double, observations bigint,"
    " start_u double, end_u double, displacement double, outcome string, direction string, mean_score double,"
    " min_score double, review_score double, triage string, review_reasons array<string>"
)
MANIFEST = _s(
    "location string, clip_name string, recording_id string, recording_date date, recording_frame_start bigint,"
    " recording_frame_stop bigint, official_split string, partition string, tuning_allowed boolean, status string,"
    " usable boolean, quarantine_reasons array<string>, warning_codes array<string>, frames_validated boolean,"
    " num_frames bigint, frame_start bigint, frame_stop bigint, width bigint, height bigint, framerate double,"
    " boxes bigint, tracks bigint, gt_sha256 string"
)
AUDIT_WINDOWS = _s("window_index int, start_frame bigint, stop_frame bigint, start_time_s double, stop_time_s double")
REVIEW_ACTIONS = _s(
    "participant string, clip string, practice boolean, job_id string, event_id bigint, action string, track_id bigint,"
    " direction string, frame_index bigint, automatic_outcome string, automatic_direction string, automatic_triage string"
)
CLIPS = _s(
    "clip_id string, created_at string, source string, sha256 string, media_kind string, media_path string, num_frames bigint,"
    " width bigint, height bigint, framerate double, x_meter_start double, x_meter_stop double, y_meter_start double,"
    " y_meter_stop double, expires_at string, deleted_at string"
)
PIPELINE_VERSIONS = _s("pipeline_version string, created_at string, config_sha256 string, config_json string")
JOBS = _s(
    "job_id string, clip_id string, pipeline_version string, counting_json string, cache_key string, idempotency_key string,"
    " request_sha256 string, status string, attempts bigint, max_attempts bigint, deadline_seconds bigint, lease_owner string,"
    " lease_expires_at string, heartbeat_at string, progress double, error string, cached_from string, created_at string,"
    " started_at string, finished_at string"
)
RESULT_REVISIONS = _s(
    "job_id string, revision bigint, kind string, created_at string, counts_json string, tracks_artifact string,"
    " review_event_id bigint, decisions_json string"
)
REVIEW_EVENTS = _s("event_id bigint, job_id string, base_revision bigint, resulting_revision bigint, created_at string, payload_json string")
WORKERS = _s("worker_id string, pipeline_version string, ready_at string, heartbeat_at string, current_job string")
#: What may be null, which values a column takes, what must be positive or not negative, and keys.
NULLABLE = {
    "clips": ("expires_at", "deleted_at"), "workers": ("current_job",), "result_revisions": ("review_event_id",),
    "jobs": ("idempotency_key", "lease_owner", "lease_expires_at", "heartbeat_at", "error", "cached_from", "started_at", "finished_at"),
}
VALUES = {
    "clips": {"source": ("upload", "example"), "media_kind": ("video", "frames")},
    "jobs": {"status": ("queued", "running", "succeeded", "failed")}, "result_revisions": {"kind": ("automatic", "reviewed")},
}
POSITIVE = {"clips": ("num_frames", "width", "height", "framerate"), "jobs": ("max_attempts", "deadline_seconds")}
NOT_NEGATIVE = {"result_revisions": ("revision",)}
KEYS = {
    "clips": ("clip_id",), "pipeline_versions": ("pipeline_version",), "jobs": ("job_id",), "result_revisions": ("job_id", "revision"),
    "review_events": ("event_id",), "workers": ("worker_id",),
}
UNIQUE = {"jobs": ("idempotency_key",)}
SERVICE = {
    "clips": CLIPS, "pipeline_versions": PIPELINE_VERSIONS, "jobs": JOBS, "result_revisions": RESULT_REVISIONS,
    "review_events": REVIEW_EVENTS, "workers": WORKERS,
}
ISSUES = _s("location string, clip_name string, code string, severity string, count bigint, examples array<string>")
