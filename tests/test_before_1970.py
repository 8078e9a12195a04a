"""Times before 1970 against the SQL twins: integer division cuts towards 0 there."""

import duckdb
import pytest

import oracle
from tidewright.plans.registry import QUERIES, SQL

NAMES = ["replay_gates", "resample_time_bars", "resample_twice", "tick_minutes", "upsert_partition", "versioned_upsert", "join_pairs", "calendar", "clean_gap_fill", "funding_crossings", "day_returns", "continuity"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """events of a month, repeated around the epoch, a month and more apart; replays also have the month itself."""
    at, out = "/root/testdata/sf0.001/events.parquet", {}
    for late in (False, True):
        d = out[late] = str(tmp_path_factory.mktemp("old"))
        days = [19680, 19738, 19800] + [0] * late
        duckdb.sql(f"COPY (SELECT event_id + k * 100000 AS event_id, ts - to_days(k) AS ts, user_id, event_type, value, props FROM '{at}', (SELECT unnest({days}) AS k)) TO '{d}/events.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folders, name):
    d = folders[name == "replay_gates"]
    assert oracle.differences(QUERIES[name](spark, d).toPandas(), oracle.duck(d).sql(SQL[name]).df()) == []
