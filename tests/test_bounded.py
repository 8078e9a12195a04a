"""Operators that cut series and groups into bounded parts: against plain loops, with parts of a few rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import measures, order_statistics, rebar

BARS = "symbol string, idx long, ts long, open double, high double, low double, close double, volume double"


def series(seed, n=300, symbols="ABC"):
    rng = random.Random(seed)
    out = []
    for s in symbols:
        price, i = 100.0, 0
        for _ in range(n if s != "C" else 7):
            price = round(price + rng.choice([-1, 0, 0, 1, 2.5]), 2)
            out.append((s, i, i * 60_000, price, price + 1, price - 1, price, float(rng.choice([0, 1, 2, 3, 10, 40]))))
            i += 1 if rng.random() < 0.95 else 60
    return out


def looped(rows, step):
    made = {}
    for s, idx, ts, o, h, low, c, v in sorted(rows):
        bars = made.setdefault(s, [[]])
        if v > 0:
            bars[-1].append((ts, o, h, low, c, v))
            if sum(r[5] for r in bars[-1]) >= step:
                bars.append([])
    return sorted((s, k, b[-1][0], b[0][1], max(r[2] for r in b), min(r[3] for r in b), b[-1][4], sum(r[5] for r in b)) for s, bars in made.items() for k, b in enumerate(bars[:-1]))


@pytest.mark.parametrize("size,step", [(10, 25), (10, 900), (64, 1), (1000, 25)])
def test_volume_bars_equal_the_loop(spark, size, step):
    rows = series(size + step)
    got = rebar.accumulated(spark.createDataFrame(rows, BARS), "volume", step, size).collect()
    assert sorted((r["symbol"], r["idx"], r["ts"], r["open"], r["high"], r["low"], r["close"], r["amount"]) for r in got) == looped(rows, step)


@pytest.mark.parametrize("size,w", [(8, 3), (8, 30), (50, 7)])
def test_thinned_events_equal_the_loop(spark, size, w):
    rows = series(w)
    want = []
    for s in "ABC":
        last = None
        for r in sorted(r for r in rows if r[0] == s and r[7] >= 3):
            if last is None or r[1] - last >= w:
                want.append((s, r[1]))
                last = r[1]
    got = rebar.thinned(spark.createDataFrame(rows, BARS).withColumn("big", F.col("volume") >= 3), w, "big", size)
    assert sorted((r["symbol"], r["idx"]) for r in got.collect()) == want


def test_a_chunk_is_a_task_s_largest_group(spark):
    rows = [("A", i, i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(200)]
    sizes = spark.createDataFrame(rows, BARS).groupBy("symbol", F.floor(F.col("idx") / 16)).count().agg(F.max("count")).first()[0]
    plan = rebar.accumulated(spark.createDataFrame(rows, BARS), "volume", 5, 16)._jdf.queryExecution().executedPlan().toString()
    assert sizes == 16 and plan.count("FlatMapGroupsInPandas") == 2 and "__k" in plan


@pytest.mark.parametrize("size", [9, 40, 1000])
def test_expanding_quantile_equals_the_whole_series(spark, size):
    rows = series(size)
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in BARS.split(", ")])
    pdf["x"] = [None if i % 11 == 3 else x for i, x in enumerate(pdf["close"])]
    df = spark.createDataFrame([(*r, x) for r, x in zip(rows, [None if x != x else float(x) for x in pdf["x"]])], BARS + ", x double")
    qs = {"q0": 0.0, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = order_statistics.expanding_quantile(df, "x", 5, qs, size).toPandas().sort_values(["symbol", "idx"]).reset_index(drop=True)
    pdf = pdf.sort_values(["symbol", "idx"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    for name, p in qs.items():
        want = pdf.groupby("symbol")["x"].transform(lambda s, p=p: s.expanding(min_periods=5).quantile(p))
        assert ((got[name] - want).abs().fillna(0) < 1e-9).all() and (got[name].isna() == want.isna()).all(), name


@pytest.mark.parametrize("size", [5, 60, 10_000])
def test_ranks_of_large_groups(spark, size):
    rows = [(r[0], r[6], r[7]) for r in series(5)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"], r["x"]): (r["rank"], r["n"], r["c"]) for r in order_statistics.ranks(df, "x", "g", size=size).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    pdf["rank"] = pdf.groupby("g")["x"].rank()
    assert {k: v[0] for k, v in got.items()} == {(g, x): r for g, x, r in pdf[["g", "x", "rank"]].itertuples(index=False)}
    assert all(v[1] == (pdf["g"] == k[0]).sum() and v[2] == ((pdf["g"] == k[0]) & (pdf["x"] == k[1])).sum() for k, v in got.items())
    whole = {r["x"]: r["rank"] for r in order_statistics.ranks(df, "x", size=size).collect()}
    assert whole == dict(zip(pdf["x"], pdf["x"].rank()))


def test_spearman_of_few_groups_equals_windows(spark):
    df = spark.createDataFrame([(r[0], r[6], r[7]) for r in series(6)] + [("D", 1.0, 2.0), ("D", None, 2.0)], "g string, x double, y double")
    a = {r["g"]: (r["n"], r["ic"]) for r in measures.spearman(df, "x", "y", "g").collect()}
    b = {r["g"]: (r["n"], r["ic"]) for r in measures.spearman(df, "x", "y", "g", few=True).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and (a[k][1] == b[k][1] or abs(a[k][1] - b[k][1]) < 1e-12) for k in a)
