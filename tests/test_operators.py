"""Known answers and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.functions import numerics as N
from tidewright.operators import clean, measures, rebar, windows
from tidewright.operators.strategy import Admission, run_account
from tidewright.operators.variance_ratio import kernel, rolling, strided
from tidewright.sources.bars import scan_bars, upsert_bars, write_bars


START = 1_654_041_600_000  # the first of June 2022


def bars(spark, n=50, volume=100.0, step=60_000, close=None):
    """A series of n bars; without prices it rises by a cent a bar, with a wave on top."""
    price = [float(x) for x in close] if close is not None else [80 + 0.01 * i + math.sin(i / 5) for i in range(n)]
    rows = [Row(symbol="X", idx=i, ts=START + i * step, open=p, high=p + 0.25, low=p - 0.25, close=p, volume=volume) for i, p in enumerate(price[:n])]
    return spark.createDataFrame(rows)


def test_holm_and_p_values():
    assert N.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert N.holm([0.04, 0.01, 0.08], 3) == pytest.approx([0.08, 0.03, 0.08])
    assert N.empirical_p(2.0, [-1, 0, 1]) == 0.25
    assert N.beta_interval(0, 200)[1] == pytest.approx(1 - 0.025 ** (1 / 201), rel=1e-9)
    assert N.mde(20_000) == pytest.approx((1.959964 + 0.841621) / math.sqrt(20_000), rel=1e-5)
    assert N.chi2_sf(3.8414588, 1) == pytest.approx(0.05, rel=1e-6)
    assert N.deflated_sharpe(0.1, 500, 100, 0.01) < N.deflated_sharpe(0.1, 500, 10, 0.01)


def test_pchip_is_monotone_and_exact():
    f = N.pchip([0, 1, 2, 4], [0.0, 0.2, 0.9, 1.0])
    ys = [f(x / 10) for x in range(41)]
    assert all(b >= a - 1e-12 for a, b in zip(ys, ys[1:])) and f(2) == pytest.approx(0.9)


def test_volume_bars(spark):
    out = rebar.volume_bars(bars(spark), 500).orderBy("idx").collect()
    assert len(out) == 10 and out[0]["ts"] == START + 4 * 60_000
    assert rebar.volume_bars(bars(spark, 13), 500).count() == 2
    assert rebar.volume_bars(bars(spark), 1000).count() == 5


def test_gap_fill(spark):
    b = bars(spark, 3).withColumn("ts", F.col("ts") + F.when(F.col("idx") == 2, 180_000).otherwise(0))
    out = clean.gap_fill(b, max_gap=120_000).orderBy("ts").collect()
    assert len(out) == 6 and [r["volume"] for r in out] == [100, 100, 0, 0, 0, 100]
    assert [r["trading_disabled"] for r in out] == [False, False, True, True, True, False]


def test_vr_kernel_by_definition():
    y = np.exp(np.cumsum(np.random.default_rng(2024).standard_t(6, 180) * 0.004))
    for q in (2, 5, 15):
        n, mu = 179, (y[-1] - y[0]) / 179
        d = np.diff(y) - mu
        s1 = (d**2).sum() / (n - 1)
        sq = sum((y[i + q] - y[i] - q * mu) ** 2 for i in range(n - q + 1)) / (q * (n - q + 1) * (1 - q / n))
        phi = sum(4 * (1 - k / q) ** 2 * n * sum(d[i] ** 2 * d[i - k] ** 2 for i in range(k, n)) for k in range(1, q)) / (d**2).sum() ** 2
        v, z = kernel(y[None], q)
        assert v[0] == pytest.approx(sq / s1 - 1, abs=1e-9) and z[0] == pytest.approx(math.sqrt(n) * (sq / s1 - 1) / math.sqrt(phi), abs=1e-7)
    with pytest.raises(ValueError):
        kernel(y[None], 1)
    assert np.isnan(kernel(np.ones((1, 60)), 5)).all()


def test_vr_sign_and_rolling_agrees(spark):
    e = np.random.default_rng(7).normal(0, 0.001, 3000)
    r = np.zeros(3000)
    for i in range(1, 3000):
        r[i] = -0.3 * r[i - 1] + e[i]
    b = bars(spark, 3000, close=np.exp(np.cumsum(r)))
    s = strided(b, 120, (2, 5)).collect()
    assert np.median([x["vr_dev"] for x in s]) < 0
    full = {(x["end_idx"], x["q"]): x["z"] for x in rolling(b, 120, (2, 5), 500).collect()}
    assert len(full) == 2 * (3000 - 119)
    assert all(abs(full[x["end_idx"], x["q"]] - x["z"]) < 1e-9 for x in s)


def test_causality(spark):
    c = list(np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 200))))
    a = windows.realized_vol(bars(spark, 200, close=c), 20).orderBy("idx").select("rv").collect()
    b = windows.realized_vol(bars(spark, 201, close=[*c, c[-1] * 10]), 20).orderBy("idx").select("rv").collect()
    assert a == b[:200]


def test_ema_and_quantile_chunks(spark):
    x = np.random.default_rng(3).normal(0, 1, 300)
    b = bars(spark, 300, close=x + 10)
    got = [r["ema"] for r in windows.ema(b, "close", 30, 37).orderBy("idx").collect()]
    y, want = None, []
    for v in x + 10:
        y = v if y is None else y + 2 / 31 * (v - y)
        want.append(y)
    assert got == pytest.approx(want)
    import pandas as pd

    q = [r["q"] for r in windows.rolling_quantile(b, "close", 40, {"q": 0.75}, 64).orderBy("idx").collect()]
    w = pd.Series(x + 10).rolling(40).quantile(0.75).tolist()
    assert all((u is None or math.isnan(u)) and math.isnan(v) or abs(u - v) < 1e-12 for u, v in zip(q, w))


def test_admission_states():
    a = Admission()
    assert [a.step(x) for x in (True, True, True, False, False, True)] == ["warmup", "non_admitted", "admissible", "admissible", "revoked", "revoked"]


def test_account_adds_up():
    rng = np.random.default_rng(5)
    c = 100 + np.cumsum(rng.normal(0, 1, 300))
    trades, equity = run_account(np.arange(300) * 60_000, c, c, np.sign(rng.normal(0, 1, 300)) * 0.2, [False] * 300)
    assert equity[-1] == pytest.approx(10_000 + sum(t[-1] for t in trades))
    assert run_account([0, 1], [1.0, 1.0], [1.0, 1.0], [0, 0], [False, False]) == ([], [10_000.0, 10_000.0])


def test_agreement_of_permuted_labels(spark):
    x = [0, 0, 1, 1, 2, 2] * 20
    df = spark.createDataFrame([Row(x=a, y=b, z=2 - a) for a, b in zip(x, x)])
    same, swapped = measures.agreement(df, "x", "y").first(), measures.agreement(df, "x", "z").first()
    assert [round(same[c], 9) for c in ("kappa", "nmi", "ari")] == [1, 1, 1] and abs(same["vi"]) < 1e-9
    assert round(swapped["nmi"], 9) == round(swapped["ari"], 9) == 1 and swapped["kappa"] < 1


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "bars")
    write_bars(bars(spark), path)
    lo = START
    got = scan_bars(spark, path, "X", lo + 60_000, lo + 120_000)
    assert got.count() == 2 and "PartitionFilters: [isnotnull(symbol" in got._jdf.queryExecution().executedPlan().toString()
    assert upsert_bars(bars(spark, 3), bars(spark, 5).withColumn("close", F.lit(0.0))).filter("close = 0").count() == 2


def test_hac_ols_against_numpy(spark):
    from tidewright.operators.regress import hac_ols

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 400)
    y = 1 + 0.5 * x + rng.normal(0, 1, 400)
    d = spark.createDataFrame([("s", i, float(b), 1.0, float(a)) for i, (a, b) in enumerate(zip(x, y))], "symbol string, idx long, y double, x0 double, x1 double")
    got = hac_ols(d, ["x0", "x1"], 3)
    m = np.column_stack([np.ones(400), x])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    g = m * (y - m @ b)[:, None]
    meat = g.T @ g + sum((1 - k / 4) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:]) for k in (1, 2, 3))
    inv = np.linalg.inv(m.T @ m)
    assert got["beta"] == pytest.approx(b) and got["cov"] == pytest.approx(inv @ meat @ inv * 400 / 398)
    assert hac_ols(d.withColumn("x2", F.col("x1")), ["x0", "x1", "x2"])["beta"] is None


def test_admission_stream_equals_batch(spark, tmp_path):
    from tidewright.streaming.online import admission

    ok = [True, True, True, False, False, True]
    for part in (0, 3):
        spark.createDataFrame([("s", i, ok[i]) for i in range(part, part + 3)], "symbol string, idx long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("symbol string, idx long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = admission(src).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["state"] for r in spark.sql("SELECT * FROM states ORDER BY idx").collect()]
    assert got == ["warmup", "non_admitted", "admissible", "admissible", "revoked", "revoked"]
