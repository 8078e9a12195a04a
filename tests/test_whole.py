"""Queries over the whole of their input, against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators.measures import CRITICAL
from tidewright.operators.strategy import run_account
from tidewright.operators.variance_ratio import kernel
from tidewright.plans.registry import QUERIES

SYMBOLS, BARS = 30, 260


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """lineitem of 30 suppliers with 260 lines each."""
    d, rng = str(tmp_path_factory.mktemp("lines")), np.random.default_rng(11)
    rows = [(s, i, 1, i % 7, float(q * p), float(q)) for s in range(1, SYMBOLS + 1) for i, (q, p) in enumerate(zip(rng.integers(1, 51, BARS), 1000 + 5 * np.cumsum(rng.normal(0, 1, BARS))))]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double")
    df.withColumn("l_shipdate", F.lit("1996-01-01").cast("date")).write.parquet(f"{d}/lineitem.parquet")
    close = {s: np.array([r[4] / r[5] for r in rows if r[0] == s]) for s in range(1, SYMBOLS + 1)}
    volume = {s: np.array([r[5] for r in rows if r[0] == s]) for s in range(1, SYMBOLS + 1)}
    return d, close, volume


def test_every_rolling_window(spark, lines):
    d, close, _ = lines
    got = {(r["symbol"], r["q"], r["end_idx"]): (r["vr_dev"], r["z"]) for r in QUERIES["vr_rolling"](spark, d).collect()}
    assert len(got) == SYMBOLS * 2 * (BARS - 59)
    for s in (1, 21, 30):
        for e in range(59, BARS):
            for q in (2, 5):
                v, z = kernel(close[s][e - 59 : e + 1][None], q)
                assert got[s, q, e] == pytest.approx((v[0], z[0]), abs=2e-6)


def test_volume_bars_of_every_symbol(spark, lines):
    d, _, volume = lines
    want = []
    for s, v in volume.items():
        amount, bar = 0.0, 0
        for i, x in enumerate(v):
            amount += x
            if amount >= 500:
                want.append((s, bar, 1_609_459_200_000 + i * 60_000, amount))
                amount, bar = 0.0, bar + 1
    assert sorted(map(tuple, QUERIES["volume_bars"](spark, d).collect())) == want


def test_scan_of_every_symbol(spark, lines):
    got = {r["symbol"]: r["n"] for r in QUERIES["scan_years"](spark, lines[0]).collect()}
    assert got == {s: BARS for s in range(1, SYMBOLS + 1)}


def test_backtest_of_whole_series(spark, lines):
    d, close, _ = lines
    got = {r["symbol"]: r for r in QUERIES["backtest_trades"](spark, d).collect()}
    for s, c in close.items():
        o, c = 100 + np.array([c[0], *c[:-1]]) / 100, 100 + c / 100
        signal = [0.1 * np.sign(c[i] - c[i - 19 : i + 1].mean()) if i >= 19 else 0.0 for i in range(BARS)]
        trades, _ = run_account(1_609_459_200_000 + np.arange(BARS) * 60_000, o, c, signal, [False] * BARS)
        assert got[s]["n"] == len(trades) and got[s]["pnl"] == pytest.approx(sum(t[-1] for t in trades), abs=1e-3)
    assert len(got) == SYMBOLS


def test_bootstrap_replicates(spark, lines):
    d, close, _ = lines
    got = {r["symbol"]: r for r in QUERIES["block_bootstrap"](spark, d).collect()}
    assert len(got) == SYMBOLS and {r["reps"] for r in got.values()} == {200}
    for s in (1, 30):
        r, means = np.diff(np.log(close[s]), prepend=np.log(close[s][0])), []  # the first is 0
        for rep in range(200):
            starts = [int(hashlib.sha256(f"{s}|{rep}|{b}".encode()).hexdigest()[:15], 16) % len(r) for b in range(math.ceil(len(r) / 20))]
            means.append(np.mean([r[(a + k) % len(r)] for a in starts for k in range(20)][: len(r)]))
        assert (got[s]["lo"], got[s]["hi"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)


def test_power_draws_and_lengths(spark):
    from tidewright.operators.resample import power_grid

    got = {r["phi"]: r for r in power_grid(spark, (0.0, 0.3, 0.6)).collect()}
    assert {r["n"] for r in got.values()} == {200} and len(got) == 3
    fires = 0
    for draw in range(200):
        close = np.exp(np.cumsum(np.random.default_rng([43, draw, 0]).normal(0, 1e-3, 50_000)))[: 50_000 // 120 * 120].reshape(-1, 120)
        z = sorted((float(np.nanmedian(kernel(close, q)[1])) for q in (2, 5, 15, 60)), key=lambda v: -abs(v))
        n = next((k for k, v in enumerate(z) if abs(v) <= CRITICAL[k]), 4)
        fires += any(v > 0 for v in z[:n])
    assert got[0.0]["fires"] == fires
