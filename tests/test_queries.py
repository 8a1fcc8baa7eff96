"""Driver contract, and a sample of queries beside DuckDB on the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from verify import TABLES, rows  # noqa: E402

SAMPLE = (
    "count_trajectories", "location_nmae", "passage_outcome_totals", "greedy_detection_matches", "review_queue", "unflagged_runs", "question_rate",
    "paired_bootstrap", "reviewer_kappa", "group_results", "stratified_sample", "review_acceptance", "replayed_count_decisions", "metadata_entries",
    "missing_frames", "manifest_content_hash", "gauge_range_delta", "temporal_channels", "stream_completed_tracks", "sql_functions",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["right_passages", "left_passages", "tracks", "stationary", "region"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())
