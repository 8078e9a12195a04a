"""Detectors, nulls, information, injection, strategy, files and streams: against plain loops and closed forms."""

import json
import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.functions import columns, neighbours, numerics
from tidewright.operators import benchmark, detectors, information, injection, markov, nulls, rebar, resample, signals, strategy, studies, windows
from tidewright.sources import files
from tidewright.streaming import online

T0 = 1_654_041_600_000


def series(spark, close, symbol="S", volume=None, step=60_000):
    c = [float(x) for x in close]
    v = volume if volume is not None else [1.0] * len(c)
    return spark.createDataFrame([Row(symbol=symbol, idx=i, ts=T0 + i * step, open=x, high=x + 1, low=x - 1, close=x, volume=float(y)) for i, (x, y) in enumerate(zip(c, v))])


@pytest.fixture(scope="module")
def walk():
    return np.exp(np.cumsum(np.random.default_rng(8).standard_t(5, 400) * 0.01)) * 50


# closed forms


def test_two_sided_p(spark):
    z = [0.0, 0.3, -1.96, 4.5, -7.9, 9.0]
    d = spark.createDataFrame([(x,) for x in z], "z double").select("z", columns.two_sided_p(F.col("z")).alias("p"), columns.normal_cdf(F.col("z")).alias("c")).collect()
    for r in d:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12)
        assert r["c"] == pytest.approx(numerics.normal_cdf(r["z"]), abs=1e-12)


def test_sharpe_against_the_published_formulas():
    sr, n, g3, g4 = 0.12, 400, -0.4, 5.0
    z = (sr - 0.05) * math.sqrt(n - 1) / math.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr**2)
    assert numerics.probabilistic_sharpe(sr, n, g3, g4, 0.05) == pytest.approx(numerics.normal_cdf(z), rel=1e-12)
    best = (1 - 0.5772156649) * numerics.normal_ppf(1 - 1 / 50) + 0.5772156649 * numerics.normal_ppf(1 - 1 / (50 * math.e))
    assert numerics.deflated_sharpe(sr, n, 50, 0.01, g3, g4) == pytest.approx(numerics.probabilistic_sharpe(sr, n, g3, g4, 0.1 * best), rel=1e-9)
    assert numerics.probabilistic_sharpe(1, 1) == numerics.deflated_sharpe(1, 9, 0, 1.0) == numerics.deflated_sharpe(1, 9, 3, 0.0) == 0


def test_mde_of_a_wald_test():
    n = 2_000
    r2 = numerics.mde_partial_r2(n)
    shift = n * r2 / (1 - r2)
    draws = np.random.default_rng(0).normal(math.sqrt(shift), 1, 200_000) ** 2
    assert np.mean(draws > 3.841459) == pytest.approx(0.8, abs=0.005)


# detectors


def test_bad_prices_fail(spark):
    for bad in (float("nan"), 0.0, -1.0, float("inf")):
        with pytest.raises(Exception, match="finite and positive"):
            detectors.detect("static", series(spark, [1, 2, bad]), fast=1, slow=2).collect()
    with pytest.raises(ValueError, match="unknown detector"):
        detectors.detect("oracle", None)


def test_soft_labels(spark):
    p = spark.createDataFrame([([0.2, 0.5, 0.5],), ([float("nan"), 1.0],), ([0.9, 0.1],), ([None, 1.0],)], "p array<double>")
    assert [r[0] for r in p.select(detectors.most_likely(F.col("p"))).collect()] == [1, -1, 0, -1]


def test_dynamic_quantiles_are_in_the_sample(spark, walk):
    b = series(spark, walk[:120]).withColumn("x", F.when(F.col("idx") >= 5, F.col("close")))
    got = detectors.nearest_quantile(b, "x", 30, {"q": 0.75}).orderBy("idx").collect()
    assert all(r["q"] is None for r in got[:5])
    for i in range(5, 120):
        w = sorted(walk[max(5, i - 29) : i + 1])
        assert min(abs(got[i]["q"] - x) for x in w) < 1e-12 and abs(w.index(min(w, key=lambda x: abs(x - got[i]["q"]))) - 0.75 * (len(w) - 1)) <= 0.5 + 1e-9


def test_filter_and_smoother_by_walking():
    rng = np.random.default_rng(9)
    x, mean, var = rng.normal(size=37), np.array([-1.0, 0.2, 2.0]), np.array([0.1, 1.0, 4.0])
    move, start = rng.dirichlet([1, 2, 3], 3), np.array([0.2, 0.3, 0.5])
    d = np.exp(markov.emissions(x, mean, var))
    alpha, beta = [start * d[0]], [np.ones(3)]
    for t in range(1, 37):
        alpha.append((alpha[-1] @ move) * d[t])
        beta.append(move @ (d[37 - t] * beta[-1]))
    alpha, beta = np.array(alpha), np.array(beta[::-1])
    filtered, both, moves, llf = markov.smoothed(markov.emissions(x, mean, var), start, move)
    assert np.allclose(filtered, alpha / alpha.sum(1, keepdims=True)) and llf == pytest.approx(math.log(alpha[-1].sum()))
    assert np.allclose(both, alpha * beta / (alpha * beta).sum(1, keepdims=True))
    joint = sum(alpha[t][:, None] * move * (d[t + 1] * beta[t + 1]) / alpha[-1].sum() for t in range(36))
    assert np.allclose(moves, joint) and moves.sum() == pytest.approx(36)


def test_markov_finds_two_variances(spark):
    rng = np.random.default_rng(4)
    calm = np.repeat([0, 1, 0, 1], 150)
    x = rng.normal(np.where(calm, -2.0, 0.0), np.where(calm, 0.3, 1.0))
    d = spark.createDataFrame([Row(symbol="S", idx=i, x=float(v)) for i, v in enumerate(x)])
    m = markov.best(markov.restarts(d, "x", 2, starts=3, steps=60)).first()
    assert m["convergence_ok"] and m["var"][0] == pytest.approx(0.09, rel=0.35) and m["var"][1] == pytest.approx(1.0, rel=0.35) and m["separation"][0] > 4
    f = markov.forward(markov.emissions(x, np.array(m["mean"]), np.array(m["var"])), np.array(m["first"]), np.array(m["move"]).reshape(2, 2))[0]
    assert np.mean(f.argmax(1) == (1 - calm)) > 0.9
    again = markov.forward(markov.emissions(x[:100], np.array(m["mean"]), np.array(m["var"])), np.array(m["first"]), np.array(m["move"]).reshape(2, 2))[0]
    assert np.allclose(again, f[:100])  # filtered: later values change nothing


# gates and agreement


def test_validity_names_all_failing_gates(spark):
    d = spark.createDataFrame([Row(symbol="S", idx=i, label=(-1 if i < 7 else i % 2)) for i in range(60)])
    c = benchmark.state_counts(d, 3, 10, "symbol")
    r = benchmark.validity(c, 3, 2, converged=F.lit(False), separation=F.lit(0.01)).first()
    assert (r["n_valid"], r["n_0"], r["n_1"], r["n_2"]) == (53, 0, 6, 0)  # rows 7, 17, ... are odd
    assert r["status"] == "instrument_failure" and r["reasons"] == ["convergence_failed", "state_0_nonoverlap_below_2", "state_2_nonoverlap_below_2", "variance_separation_below_0.05"]
    assert benchmark.validity(c, 3, 2, eligible=F.lit(False)).first()["status"] == "excluded"


def test_classification(spark):
    ok = spark.createDataFrame([("valid",)], "status string")
    pairs = lambda *v: spark.createDataFrame([(x,) for x in v], "nmi double")
    verdict = lambda s, p: benchmark.classification(s, p).first()["classification"]
    assert verdict(spark.createDataFrame([("valid",), ("instrument_failure",)], "status string"), pairs(0.9)) == "instrument_failure"
    assert [verdict(ok, pairs(*v)) for v in ((0.6, 0.9), (0.1, 0.2), (0.1, 0.9), ())] == ["harmonized_convergence", "persistent_disagreement", "mixed_family_structure", "mixed_family_structure"]


# windows and clocks


def test_table_ranks(spark):
    x = np.round(np.random.default_rng(1).normal(0, 1, 500), 1)
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["x"]: r["rank"] for r in windows.table_ranks(d, "x", bins=7).collect()}
    for v in set(x.tolist()):
        assert got[v] == (x < v).sum() + ((x == v).sum() + 1) / 2
    assert windows.table_ranks(d.filter("x > 99"), "x").count() == 0 and windows.table_ranks(d.withColumn("x", F.lit(1.0)), "x").first()["rank"] == 250.5


def test_intrinsic_bars_add_the_rolling_sum(spark, walk):
    r = np.diff(np.log(walk), prepend=np.log(walk[0])) ** 2
    want, total, count = [], 0.0, 0
    for i in range(len(r)):
        part = r[max(0, i - 9) : i + 1].sum()
        if part <= 0:
            continue
        total += part
        if total >= 0.02:
            want.append((count, T0 + i * 60_000))
            total, count = 0.0, count + 1
    got = rebar.intrinsic_bars(series(spark, walk), 0.02, 10).orderBy("idx").collect()
    assert [(r["idx"], r["ts"]) for r in got] == want and len(want) > 5
    assert rebar.gauge("clock", got) is got
    with pytest.raises(ValueError):
        rebar.gauge("lunar", got)


def test_first_passages_share_edges(spark, walk):
    c, w, want = walk[:61], 20, []
    for i in range(3):
        seg = np.log(c[i * w + 1 : i * w + w + 1] / c[i * w])
        hit = [k for k, v in enumerate(seg, 1) if v == 0 or np.sign(v) != np.sign(seg[0])]
        want.append(min(hit, default=w + 1))
    got = studies.first_passages(series(spark, c), w).orderBy("seg").collect()
    assert [r["passage"] for r in got] == want
    curve = studies.survival(spark.createDataFrame([(t,) for t in (1, 3, 3, 21)], "passage long"), 20).orderBy("t").collect()
    assert [curve[k]["s"] for k in (0, 1, 2, 19)] == [0.75, 0.75, 0.25, 0.25] and curve[0]["s0"] == 1


def test_break_even_and_higher_quantile(spark):
    d = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 1.0), ("a", 2.0, -1.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0)], "k string, cost double, total_return double")
    assert {r["k"]: r["break_even"] for r in studies.break_even(d, "k").collect()} == {"a": 1.5, "b": None}
    paths = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])] + [("g", 0, -5.0), ("g", 1, float("nan"))], "gate string, rep int, value double")
    assert studies.max_thresholds(paths, 0.2).first()["threshold"] == np.quantile(range(1, 9), 0.8, method="higher")


def test_seeds(spark):
    import hashlib

    got = spark.range(3).select(resample.seed_of(F.lit(43), "id", F.lit(5)).cast("string")).collect()
    assert [r[0] for r in got] == [str(int(hashlib.sha256(f"43{k}5".encode()).hexdigest()[:16], 16)) for k in range(3)]


# nulls


def test_block_places():
    rng = np.random.default_rng(0)
    for method in ("circular-block", "moving-block", "stationary-block"):
        at = nulls.places(method, 50, 7, rng)
        assert len(at) == 50 and at.min() >= 0 and at.max() < 50
        steps = np.diff(at) % 50 == 1
        assert steps.mean() > 0.7
    assert all((np.diff(nulls.places("moving-block", 50, 10, rng).reshape(5, 10)) == 1).all() for _ in range(20))
    assert nulls.methods(["wild", "circular-block", "wild"]) == ("wild", "circular-block")
    with pytest.raises(ValueError):
        nulls.places("moving-block", 0, 5, rng)
    assert nulls.degrees_of_freedom(np.arange(5.0)) == 30 and 4.5 <= nulls.degrees_of_freedom(rng.standard_t(5, 5_000)) < 20


def test_null_programme_is_the_same_however_dealt(spark, walk):
    d = series(spark, walk).withColumn("r", windows.log_return())
    get = lambda chunk: {(r["method"], r["rep"], r["q"]): r["z"] for r in nulls.programme(d, "r", [(40, 2), (40, 5)], [("circular-block", 10), ("wild", None), ("student-t", None), ("rank-sign", None)], 12, chunk=chunk).collect()}
    a, b = get(5), get(12)
    assert a == b and len(a) == 4 * 13 * 2
    r = np.diff(np.log(walk), prepend=np.log(walk[0]))
    assert a["wild", -1, 2] == pytest.approx(nulls.median_z(r, 40, 2))


def test_placed_and_bootstrap(spark, walk):
    seen = spark.createDataFrame([("k", 2.0)], "k string, z double")
    null = spark.createDataFrame([("k", v) for v in (-1.0, 0.0, 1.0)], "k string, z double")
    r = nulls.placed(seen, null, "z", "k").first()
    assert (r["p_two"], r["p_greater"], r["p_less"]) == (0.25, 0.25, 1.0)
    d = series(spark, walk)
    r = nulls.bootstrap(d, ["close"], lambda close: close.mean(), block=20, reps=60).first()
    assert r["lo"] < r["point"] < r["hi"] and r["point"] == pytest.approx(walk.mean())
    assert nulls.bootstrap(d.filter("idx < 39"), ["close"], lambda close: close.mean(), block=20, reps=5).first()["lo"] is None


# information


def test_nearest_neighbours_against_all_distances():
    rng = np.random.default_rng(2)
    for x, y in ((rng.normal(size=300), rng.normal(size=300)), (np.round(rng.normal(size=200), 1), np.repeat(1.0, 200)), (np.repeat(0.0, 60), rng.normal(size=60))):
        d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(d, np.inf)
        assert np.allclose(neighbours.kth_distances(x, y, 5), np.sort(d, axis=1)[:, 4])
        r = rng.uniform(0, 1, len(x))
        assert (neighbours.within(x, r) == (np.abs(x[:, None] - x) <= r[:, None]).sum(1) - 1).all()
    assert neighbours.digamma([1.0, 0.5, 10.0]) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525891], abs=1e-9)


def test_information_of_gaussian_pairs(spark):
    for nats in (0.0, 0.2, 0.6):
        assert neighbours.ksg(*neighbours.gaussian_pairs(4_000, nats, 1)) == pytest.approx(nats, abs=0.05)
    x, y = neighbours.gaussian_pairs(500, 0.5, 3)
    d = spark.createDataFrame([Row(symbol="S", idx=i, x=float(a), y=float(b)) for i, (a, b) in enumerate(zip(x, y))])
    r = information.information(d, reps=10).first()
    assert r["n"] == 500 and r["mi"] == pytest.approx(neighbours.ksg(x, y)) and r["se"] > 0
    s = information.information(d.withColumns({"x": F.signum("x"), "y": F.signum("x")}), "signs", reps=5).first()
    assert s["mi"] == pytest.approx(math.log(2), abs=0.01)


# injection


def test_recurrence_and_volatility_path():
    x = np.random.default_rng(3).normal(size=1_000)
    for a in (0.0, 0.05, 0.94, -0.6):
        y, last = [0.7], 0.7
        for v in x[1:]:
            last = a * last + v
            y.append(last)
        assert np.allclose(injection.linear_recurrence(x, a, 0.7), y)
    s2 = [x.var()]
    for v in x[:-1]:
        s2.append(0.06 * v * v + 0.94 * s2[-1])
    assert np.allclose(injection.ewma_sigma(x), np.sqrt(s2))
    path = injection.inject(np.zeros(50_000), 0.6, 5, np.ones(50_000))
    assert path.std() == pytest.approx(1, abs=0.03) and np.corrcoef(path[1:], path[:-1])[0, 1] == pytest.approx(0.6, abs=0.02)
    with pytest.raises(ValueError):
        injection.inject(np.zeros(5), -0.1, 0)


def test_inversion():
    points = [(0.0, 0.3), (0.1, 0.10), (0.2, 0.15), (0.3, 0.14), (0.5, 0.40)]
    assert [injection.invert(d, points) for d in (0.0, 0.05, 0.10, 0.15, 0.40)] == pytest.approx([0, 0.05, 0.1, 0.2, 0.5])
    assert injection.invert(9.0, points) == 0.99 and injection.invert(0.2, [(0.4, 0.1)]) == 0.4 and 0.2 < injection.invert(0.3, points) < 0.5


# strategy


def bar(label=0, close=100.0, z=0.0, dev=0.0, upper=110.0, lower=90.0):
    return {"label": label, "close": close, "z": z, "deviation": dev, "upper": upper, "lower": lower}


def test_reversion_rules():
    w = signals.Walk(signals.Rules(warm_reversion=0))
    take = lambda b, allowed=True: w.take(s := w.wanted(5, b, allowed), b["close"]) or s
    assert w.wanted(5, bar(z=-2.5)) == 1 and w.wanted(5, bar(z=2.5)) == -1 and w.wanted(5, bar(z=-2.5), False) == 0 and w.wanted(5, bar(z=math.nan)) == 0
    assert take(bar(z=-2.5, dev=-0.01)) == 1
    assert w.wanted(6, bar(z=-1, dev=-0.01)) == 1  # holds while it is below
    assert w.wanted(6, bar(z=0, dev=-0.001)) == 0  # back at the price
    assert w.wanted(6, bar(close=98, z=-3, dev=-0.03)) == 0 and w.wanted(6, bar(close=104, dev=-0.01)) == 0  # stop, profit
    assert w.wanted(6, bar(z=2.5, dev=0.01)) == -1 and w.wanted(6, bar(z=2.5, dev=0.01), False) == 0
    assert signals.Walk(signals.Rules()).wanted(5, bar(z=-2.5)) == 0  # warm-up


def test_breakout_rules_and_states():
    w = signals.Walk(signals.Rules(warm_breakout=0))
    assert w.wanted(5, bar(1, 111)) == 1 and w.wanted(5, bar(1, 89)) == -1 and w.wanted(5, bar(1, 111), False) == 0 and w.wanted(5, bar(1, 111, upper=math.nan)) == 0
    w.take(1.0, 111.0)
    assert w.wanted(6, bar(1, 100)) == 1 and w.wanted(6, bar(1, 89)) == -1 and w.wanted(6, bar(1, 89), False) == 0
    assert w.wanted(6, bar(2, 100)) == 0 and w.wanted(6, bar(-1, 100)) == 0
    assert w.take(0.0, 122.1) == pytest.approx(0.1) and w.take(0.0, 1.0) is None


def test_drawdown_lock():
    lock = signals.Lock(cooldown=3)
    assert [lock.step(e, 0.10) for e in (0.91, 0.89, 0.95, 0.95, 0.94)] == ["open", "shut", "shut", "opened", "open"]
    assert lock.peak == 0.95  # equity when it opened
    assert signals.Lock(cooldown=1).step(0.5, 0.10) == "opened"


def test_book_marks_and_locks():
    b = signals.Book(signals.Limits(streak=2, pause=3))
    b.held = [1.0, -1.0]
    b.mark(100, 110, 99)
    assert b.equity == pytest.approx(1 + 0.1 + 0.1)
    b = signals.Book(signals.Limits())
    b.equity = 0.88
    barred, share = b.check(0)
    assert not barred and share == pytest.approx(math.exp(-10 * 0.04))
    barred, share = b.check(2)
    assert barred and share == 0 and b.lock.opens - b.lock.bar == 499
    b = signals.Book(signals.Limits(streak=2, pause=3))
    for gain in (-0.1, -0.2):
        b.settle(gain, False, 0.0)
    assert b.check(0)[0] and b.pause == 2 and b.losses == 0


def test_managed_signals_respect_the_session(spark, walk):
    noon = 12 * 3_600_000
    b = series(spark, np.tile(walk, 4)).withColumn("ts", F.col("ts") + noon - 300 * 60_000)
    f = signals.features(b, 20, 60, vwap=60, low=0.95, high=1.1)
    s = signals.managed_signals(f, "blueprint", signals.Rules(warm_reversion=60, warm_breakout=60)).orderBy("idx").collect()
    side = [math.copysign(1, r["signal"]) if r["signal"] else 0 for r in s]
    hour = [(r["ts"] // 3_600_000) % 24 for r in s]
    assert all(x == 0 or y != 0 or 12 <= h < 20 for x, y, h in zip(side[1:], side, hour[1:])) and any(side)
    assert max(abs(r["signal"]) for r in s) <= 1.11
    with pytest.raises(ValueError):
        signals.managed_signals(f, "other")


def test_limit_orders(spark):
    n = 60
    ts, o = list(range(0, n * 60_000, 60_000)), [100.0 + (k % 7) for k in range(n)]
    sig = [(-1) ** (k // 5) * 1.0 for k in range(n)]
    run = lambda **k: strategy.run_account(ts, o, o, sig, [False] * n, leverage=False, **k)
    taker, _ = run()
    assert run(limit=[True] * n, fill_chance=0.0)[0] == [] and len(taker) == 12
    maker, _ = run(limit=[True] * n, maker_fee=-1e-4, fill_chance=1.0)
    assert len(maker) == 12 and maker[0][6] == pytest.approx(-1e-4 * maker[0][4]) and maker[0][4] == o[1]
    some, _ = run(limit=[True] * n, fill_chance=0.5)
    assert 0 < len(some) <= 12
    u = [strategy.uniform(t, i) for i, t in enumerate(ts)]
    assert 0.3 < np.mean(u) < 0.7 and u == [strategy.uniform(t, i) for i, t in enumerate(ts)]
    assert strategy.Terms(maker_rebate_bps=-0.5).settings()["maker_fee"] == -5e-5 and strategy.Terms(maker_fee=1.0, maker_rebate_bps=3).settings()["maker_fee"] == 1.0


def test_report(spark, walk):
    b = series(spark, walk).withColumn("signal", F.when(F.col("idx") % 40 < 20, 1.0).otherwise(-1.0))
    points = [("cheap", strategy.Terms(slippage=0.0, fee=0.0)), ("dear", strategy.Terms(slippage=0.0, fee=1e-3))]
    r = {x["point"]: x for x in strategy.report(strategy.run_all(b, points=points), points).collect()}
    trades, equity = strategy.run_account([T0 + i * 60_000 for i in range(400)], walk, walk, [1.0 if i % 40 < 20 else -1.0 for i in range(400)], [False] * 400, slippage=0.0, fee=0.0)
    assert r["cheap"]["n_trades"] == len(trades) and r["cheap"]["final_equity"] == pytest.approx(equity[-1]) and r["dear"]["total_return"] < r["cheap"]["total_return"]
    assert r["cheap"]["max_drawdown"] == pytest.approx(max(1 - e / max(equity[: k + 1]) for k, e in enumerate(equity))) and (r["cheap"]["cost"], r["dear"]["cost"]) == (0, 20)


# files


def test_text_files(spark, tmp_path):
    d = str(tmp_path / "rows")
    files.write_rows(spark.range(10).select((F.col("id") * 100).alias("ts"), F.col("id").cast("double").alias("bid")), d)
    got = files.scan_rows(spark, [d, d], "ts long, bid double", 200, 500)
    assert sorted(r["ts"] for r in got.collect()) == [200, 300, 400, 500] and got.select("source_file").first()[0].endswith(".csv")


def test_json_grid_and_latest(spark, tmp_path):
    for k, body in enumerate([{"delta": 0.1, "q": 2, "W": 60}, {"delta_target": 0.2, "q": 5, "W": 120}]):
        (tmp_path / f"inj_{k}.json").write_text(json.dumps(body, indent=1))
    assert {(r["delta"], r["q"]) for r in files.read_grid(spark, f"{tmp_path}/inj_*.json").collect()} == {(0.1, 2), (0.2, 5)}
    assert files.latest(spark, str(tmp_path)).endswith("inj_1.json")
    (tmp_path / "inj_2.json").write_text("{}")
    with pytest.raises(Exception, match="lacks delta"):
        files.read_grid(spark, f"{tmp_path}/inj_*.json").collect()
    r = files.json_safe(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")).first()
    assert r["a"] is None and r["b"] == 1.0


def test_planned_cells_are_computed_once(spark, tmp_path):
    planned, seen = spark.range(6).select(F.col("id").alias("k")), []

    def compute(d):
        seen.append(sorted(r["k"] for r in d.collect()))
        return d.withColumn("v", F.col("k") * 2)

    files.write_missing(planned.filter("k < 4"), f"{tmp_path}/g", ["k"], compute)
    assert files.write_missing(planned, f"{tmp_path}/g", ["k"], compute).count() == 6 and seen == [[0, 1, 2, 3], [4, 5]]


def test_times(spark):
    now = datetime(2022, 6, 1, tzinfo=timezone.utc)
    assert files.lookback("2d", now) == (T0 - 2 * 86_400_000, T0) and files.lookback("1m", now)[0] == T0 - 30 * 86_400_000 and files.lookback("1y", now)[0] == T0 - 365 * 86_400_000
    assert files.lookback("2022-06-01/2022-06-01") == (T0, T0 + 86_400_000 - 1)
    with pytest.raises(ValueError):
        files.lookback("soon")
    r = spark.range(1).select(files.parse_ms("2022-06-01").alias("a"), files.parse_ms("2022-06-01", True).alias("b"), files.parse_ms("2022-06-01T00:01:00Z", True).alias("c")).first()
    assert tuple(r) == (T0, T0 + 86_400_000 - 1, T0 + 60_000)
    b = series(spark, [1, 2, 3])
    assert files.window_of(b, "2022-06-01", "2022-06-01").count() == 3
    for broken, year in ((b.withColumn("ts", F.lit(T0)), None), (b, 2022)):
        with pytest.raises(Exception, match="must rise|held-out"):
            files.window_of(broken, "2022-06-01", "2022-06-01", year).collect()


def test_load_plan(spark):
    day = 86_400_000
    rows = [("all", T0), ("all", T0 + 40 * day), ("late", T0 + 5 * day), ("late", T0 + 40 * day), ("short", T0), ("short", T0 + 9 * day)]
    got = files.load_plan(spark.createDataFrame(rows, "symbol string, ts long"), T0, T0 + 40 * day).orderBy("symbol", "slice_start").collect()
    assert [(r["symbol"], r["backfill"]) for r in got] == [("late", True), ("late", True), ("short", False), ("short", False)]
    assert got[0]["slice_start"] == T0 and got[1]["slice_end"] == T0 + 40 * day and got[2]["slice_start"] == T0 + 9 * day + 60_000


# streams


def stream(spark, tmp_path, name, batches, schema, build):
    """What build(stream) has put out after the batches, one file each."""
    src = tmp_path / name
    src.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    q = build(spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_time_bars_of_a_stream(spark, tmp_path):
    at = lambda m: datetime.fromtimestamp(T0 / 1000 + 60 * m, timezone.utc)
    first = [("S", at(0), 1, 10.0, 1.0), ("S", at(1), 2, 12.0, 1.0), ("S", at(1), 2, 12.0, 1.0), ("S", at(6), 3, 11.0, 2.0)]
    got = stream(spark, tmp_path, "time_bars", [first, [("S", at(40), 9, 1.0, 1.0)], [("S", at(41), 10, 1.0, 1.0)], [("S", at(2), 8, 99.0, 1.0), ("S", at(42), 11, 1.0, 1.0)]], "symbol string, time timestamp, seq long, price double, volume double", online.time_bars)
    assert sorted((r["ts"], r["high"], r["volume"]) for r in got) == [(T0, 12.0, 2.0), (T0 + 300_000, 11.0, 2.0)]
    assert [d.count() for d in online.split_late(spark.createDataFrame(first, "symbol string, time timestamp, seq long, price double, volume double"), T0 + 600_000, 300_000)] == [1, 3]


def test_state_over_batches(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=23)
    rows = [("S", i, float(v)) for i, v in enumerate(x)]
    got = stream(spark, tmp_path, "count_windows", [rows[:7], rows[7:]], "symbol string, idx long, x double", lambda s: online.count_windows(s, 5))
    assert [(r["win"], round(r["mean"], 9), round(r["sd"], 9)) for r in sorted(got, key=lambda r: r["win"])] == [(k, round(x[5 * k : 5 * k + 5].mean(), 9), round(x[5 * k : 5 * k + 5].std(), 9)) for k in range(4)]


def test_clock_bars_and_gaps_of_a_stream(spark, tmp_path, walk):
    volume = np.random.default_rng(6).integers(0, 9, 60)
    b = series(spark, walk[:60], volume=volume)
    rows = [tuple(r) for r in b.select("symbol", "idx", "ts", "open", "high", "low", "close", "volume").collect()]
    schema = "symbol string, idx long, ts long, open double, high double, low double, close double, volume double"
    got = stream(spark, tmp_path, "clock_bars", [rows[:13], rows[13:20], rows[20:]], schema, lambda s: online.clock_bars(s, 20))
    want = rebar.volume_bars(b, 20).select("symbol", "idx", "ts", "open", "high", "low", "close", "volume").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 5
    few = [r for r in rows if r[1] not in (4, 5, 6, 13, 14, 15, 16, 17, 18, 19)]
    got = {r["ts"]: r for r in stream(spark, tmp_path, "fill_gaps", [few[:8] + few[7:8], few[8:]], schema, lambda s: online.fill_gaps(s, 60_000, 300_000))}
    assert len(got) == 60 and got[T0 + 5 * 60_000]["close"] == walk[3] and not got[T0 + 5 * 60_000]["trading_disabled"] and got[T0 + 15 * 60_000]["trading_disabled"]


# chunks


@pytest.mark.parametrize("size", [7, 25, 1_000])
def test_chunks_change_nothing(spark, walk, size):
    b = series(spark, walk[:120]).withColumn("label", (F.col("idx") / 9).cast("int") % 3)
    b = b.unionByName(b.withColumns({"symbol": F.lit("T"), "close": F.lit(200.0) - F.col("close"), "label": F.when(F.col("idx") % 50 < 30, F.lit(1))})).filter("symbol = 'S' OR idx % 11 <> 3")
    key = lambda d: sorted(map(str, d.collect()))
    got = {(r["symbol"], r["idx"]): r for r in windows.islands(windows.drawdowns(b, "close", size), "label", size).collect()}
    for symbol in "ST":
        rows = sorted((r for r in b.collect() if r["symbol"] == symbol), key=lambda r: r["idx"])
        peak, run = -1.0, 0
        for k, r in enumerate(rows):
            peak = max(peak, r["close"])
            run += k == 0 or r["label"] != rows[k - 1]["label"]
            x = got[symbol, r["idx"]]
            assert x["drawdown"] == pytest.approx(1 - r["close"] / peak) and x["run"] == run
    whole = b.filter("symbol = 'S'")
    make = lambda d: d.select("symbol", "idx", windows.full(F.sum, F.col("volume"), 9).alias("v"), F.round(windows.zscore(F.col("close"), 9), 9).alias("z"))
    assert key(windows.over_chunks(whole, 9, make, size)) == key(make(whole))


def test_next_bars_over_chunks(spark):
    from tidewright.operators import clean

    ts = [0, 1, 5, 20, 21, 90]
    b = spark.createDataFrame([("S", t) for t in ts] + [("T", 3)], "symbol string, ts long")
    got = {(r["symbol"], r["ts"]): r["next_ts"] for r in clean.with_next(b, 10).collect()}
    assert got == {**{("S", a): c for a, c in zip(ts, [*ts[1:], None])}, ("T", 3): None}


def test_exact_quantiles(spark):
    from tidewright.operators.measures import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.standard_cauchy(3_001), 3), "b": np.repeat([1.0, 2.0], [700, 701]), "c": np.array([5.0]), "d": rng.integers(0, 3, 10).astype(float)}
    d = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", float("nan")), ("b", None)], "g string, x double")
    ps = {"lo": 0.0, "q": 0.27, "m": 0.5, "hi": 1.0}
    for accuracy in (20, 10_000):
        for r in exact_quantiles(d, F.col("x"), ps, "g", accuracy=accuracy).collect():
            v = groups[r["g"]]
            assert r["n"] == len(v) and [r[k] for k in ps] == pytest.approx(np.quantile(v, list(ps.values())).tolist())
    r = exact_quantiles(d, F.col("x"), {"m": 0.5}).first()
    assert r["m"] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_delta_star(spark):
    d = spark.createDataFrame([("a", 0.01, 0.0), ("a", 0.1, 0.5), ("a", 1.0, 1.0), ("b", 0.01, 0.0), ("b", 1.0, 0.8), ("c", 0.5, 1.0)], "cell string, delta double, p_det double")
    got = {r["cell"]: r["delta"] for r in studies.delta_star(d).collect()}
    assert 0.1 < got["a"] < 1.0 and got["b"] is None and got["c"] == pytest.approx(0.5)
    f = numerics.pchip([0.01, 0.1, 1.0], [0.0, 0.5, 1.0])
    assert f(got["a"]) >= 0.9 > f(got["a"] * 0.99)


def test_strides_agree(spark, walk):
    from tidewright.operators.variance_ratio import by_stride

    b = series(spark, walk)
    key = lambda d: sorted((r["end_idx"], r["q"], round(r["z"], 9)) for r in d.collect())
    every = key(by_stride(b, 40, (2, 5)))
    assert len(every) == 361 * 2
    for stride in (40, 10):
        assert key(by_stride(b, 40, (2, 5), stride)) == [x for x in every if (x[0] - 39) % stride == 0]


# causality and stores


def test_a_later_bar_changes_nothing_before(spark, walk):
    """Every operator of the past on a series, and on the series with a spike after its end."""
    spiked = np.append(walk[:150], 1e4)

    def made(c):
        b = series(spark, c)
        d = windows.islands(windows.drawdowns(b.withColumn("label", (F.col("close") > 50).cast("int")), "close", 40), "label", 40)
        d = detectors.volatility_ratio(windows.realized_vol(d, 20), 10, 30)
        up, low = windows.donchian(10)
        d = d.withColumns({"vwap": windows.vwap(15), "up": up, "low": low, "z": windows.zscore(F.col("close"), 12)})
        d = windows.rolling_quantile(windows.ema(d, "rv", 10, 50), "rv", 40, {"q": 0.9}, chunk=60)
        return {r["idx"]: r.asDict() for r in d.collect()}

    a, b = made(walk[:150]), made(spiked)
    assert len(b) == 151 and all(str(a[i]) == str(b[i]) for i in range(150))


def test_store(spark, tmp_path):
    from tidewright.sources.bars import load_bars, upsert_store, write_bars
    from tidewright.operators.clean import assert_ordered

    year = 365 * 86_400_000
    b = series(spark, [10, 11, 12]).unionByName(series(spark, [5]).withColumn("ts", F.lit(T0 + year)))
    write_bars(b, str(tmp_path / "s"))
    before = {f.name for f in (tmp_path / "s").rglob("*.parquet") if "2023" in str(f)}
    new = series(spark, [99, 98, 97]).withColumn("ts", F.col("ts") + 120_000)
    upsert_store(spark, str(tmp_path / "s"), new)
    got = sorted((r["ts"] - T0, r["close"]) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [(0, 10), (60_000, 11), (120_000, 12), (180_000, 98), (240_000, 97), (year, 5)]
    assert before == {f.name for f in (tmp_path / "s").rglob("*.parquet") if "2023" in str(f)} and not (tmp_path / "s-staging").exists()
    assert [r["close"] for r in load_bars(spark, str(tmp_path / "s"), "S", T0, T0 + 180_000).orderBy("ts").collect()] == [10, 11, 12, 98]
    write_bars(series(spark, [1, -5]), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="bad bar at"):
        load_bars(spark, str(tmp_path / "bad"), "S", T0, T0 + year).collect()
    with pytest.raises(Exception, match="out of order"):
        assert_ordered(series(spark, [1, 2]).withColumn("ts", -F.col("ts"))).collect()


def test_slope_of_change_is_refitted(spark):
    from tidewright.operators import nulls
    from tidewright.plans.simulation import _slope

    rng = np.random.default_rng(3)
    rows = [("S", i, float(a == 1), float(a == 2), float(c), float(1 + 0.5 * (a == 1) - 0.25 * c + rng.normal(0, 0.1))) for i, (a, c) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 2, 200)))]
    d = spark.createDataFrame(rows, "symbol string, idx long, x1 double, x2 double, change double, y double")
    r = nulls.bootstrap(d, ["y", "x1", "x2", "change"], _slope, block=5, reps=200).first()
    x = np.array([[1.0, *t[2:5]] for t in rows])
    assert r["point"] == pytest.approx(np.linalg.lstsq(x, np.array([t[5] for t in rows]), rcond=None)[0][3], abs=1e-9)
    assert r["lo"] < r["point"] < r["hi"] and abs(r["point"] + 0.25) < 0.05 and 0.02 < r["hi"] - r["lo"] < 0.1


def test_five_detectors_by_name(spark, walk):
    from tidewright.operators import detectors

    assert sorted(detectors.DETECTORS) == ["dynamic", "markov", "rolling_quantile", "static", "variance_ratio"]
    d = detectors.detect("markov", series(spark, walk), vol=10, states=2, starts=2, steps=20)
    assert {r["label"] for r in d.select("label").distinct().collect()} <= {-1, 0, 1}
