"""Streams with timers and ring buffers: equal to the batch operators, however the input is cut into batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_studies import stream

from tidewright.operators import clean, windows as W
from tidewright.streaming import keyed

START = datetime(2021, 1, 1, tzinfo=timezone.utc)
BARS = "symbol string, time timestamp, open double, high double, low double, close double, volume double"


def bar(symbol, minute, price):
    return (symbol, START + timedelta(minutes=minute), price, price + 1, price - 1, price, 2.0)


def ms(minute):
    return int(START.timestamp() * 1000) + minute * 60_000


def facts(rows):
    return sorted((r["symbol"], r["ts"], r["open"], r["close"], r["volume"], r["trading_disabled"]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_filled_by_timers_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    minutes = {"A": [0, 1, 2, 4, 9, 30, 31, 60], "B": [0, 3, 5, 6], "C": [50, 52, 60]}  # B falls silent at 6
    rows = sorted((bar(s, m, 10.0 + m) for s, ms_ in minutes.items() for m in ms_), key=lambda r: (r[1], r[0]))
    for i in range(0, len(rows) - 1, 2):  # neighbours come in the other order, within the watermark
        if rows[i + 1][1] - rows[i][1] < timedelta(minutes=3):
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
    batches, left = [], rows
    while left:
        k = rng.randint(1, 4)
        batches.append(left[:k])
        left = left[k:]
    batches += [[bar("Z", 71, 1.0)], [bar("Z", 72, 1.0)]]  # moves the watermark on to 66
    got = stream(spark, tmp_path, f"gaps{seed}", batches, BARS, lambda s: keyed.fill_gaps_timed(s, 60_000, 300_000, "5 minutes"))
    assert not any(r["late"] for r in got)
    batch = spark.createDataFrame(rows, BARS).withColumn("ts", F.unix_millis("time"))
    now = ms(72 - 5)
    want = clean.gap_fill(batch, 60_000, 300_000, now).filter(F.col("ts") <= now).collect()
    assert facts(r for r in got if r["symbol"] != "Z") == facts(want)
    silent = [r for r in got if r["symbol"] == "B" and r["ts"] > ms(6)]
    assert [r["ts"] for r in sorted(silent, key=lambda r: r["ts"])] == [ms(m) for m in range(7, 67)] and all(r["trading_disabled"] for r in silent)


def test_late_bars_come_out_aside_and_silent_symbols_are_forgotten(spark, tmp_path):
    batches = [[bar("A", 0, 1.0), bar("B", 0, 2.0)], [bar("A", 40, 1.5)], [bar("A", 41, 1.5)], [bar("B", 3, 9.0), bar("A", 42, 1.5)], [bar("A", 55, 1.5), bar("B", 56, 3.0)], [bar("A", 80, 1.5)], [bar("A", 81, 1.5)]]
    got = stream(spark, tmp_path, "late", batches, BARS, lambda s: keyed.fill_gaps_timed(s, 60_000, 300_000, "5 minutes", forget_ms=10 * 60_000))
    assert [(r["symbol"], r["ts"]) for r in got if r["late"]] == [("B", ms(3))]
    flat = sorted(r["ts"] for r in got if r["symbol"] == "B" and not r["late"] and r["volume"] == 0)
    assert flat == [*(ms(m) for m in range(1, 10)), *(ms(m) for m in range(57, 66))]  # ten minutes after each bar it is gone


@pytest.mark.parametrize("seed", [3, 4])
def test_rolling_features_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for s in "AB":
        price = 100.0
        for i in range(160):
            price *= 1 + rng.gauss(0, 0.01)
            rows.append((s, i, i * 60_000, price, price + rng.random(), price - rng.random(), price, float(rng.randint(0, 3))))
    schema = "symbol string, idx long, ts long, open double, high double, low double, close double, volume double"
    by_time = sorted(rows, key=lambda r: (r[1], r[0]))
    batches, left = [], by_time
    while left:
        k = rng.randint(20, 120)
        batches.append(left[:k])
        left = left[k:]
    got = {(r["symbol"], r["idx"]): r for r in stream(spark, tmp_path, f"rolling{seed}", batches, schema, lambda s: keyed.rolling_features(s, 12, 15, 7, 30))}
    up, low = W.donchian(7)
    b = W.realized_vol(spark.createDataFrame(rows, schema), 12)
    b = W.rolling_quantile(b, "rv", 30, {"q75": 0.75, "q95": 0.95})
    want = b.select("symbol", "idx", "rv", W.vwap(15).alias("vwap"), up.alias("upper"), low.alias("lower"), "q75", "q95").collect()
    assert len(got) == len(want) == 320
    for r in want:
        for c in ("rv", "vwap", "upper", "lower", "q75", "q95"):
            a, e = got[r["symbol"], r["idx"]][c], r[c]
            assert (a is None or a != a) == (e is None or e != e) and (e is None or e != e or abs(a - e) < 1e-9), (r["symbol"], r["idx"], c, a, e)
