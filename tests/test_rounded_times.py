"""Times within half a millisecond of a slot's end against the SQL twins: SQL's epoch_ms rounds to the nearest millisecond."""

import duckdb
import pytest

import oracle
from tidewright.plans.registry import QUERIES, SQL

NAMES = ["resample_time_bars", "resample_twice", "tick_minutes", "calendar", "spread_summary", "join_symbols", "day_returns", "keep_first_dedupe", "stable_order"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """events put to the last microseconds of their minute, a third of them to half a millisecond before its end, around now and the epoch."""
    at, d = "/root/testdata/sf0.001/events.parquet", str(tmp_path_factory.mktemp("late"))
    ts = "date_trunc('minute', ts) + to_microseconds(60000000 - [500, 499, 501][1 + event_id % 3]) - to_days(k)"
    duckdb.sql(f"COPY (SELECT event_id + k * 100000 AS event_id, {ts} - to_microseconds(event_id // 3 % 2 * 250) AS ts, user_id, event_type, value, props FROM '{at}', (SELECT unnest([0, 19738]) AS k)) TO '{d}/events.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    assert oracle.differences(QUERIES[name](spark, folder).toPandas(), oracle.duck(folder).sql(SQL[name]).df()) == []
