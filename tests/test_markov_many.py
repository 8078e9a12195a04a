"""Markov fits of many series together are those of one after the other."""

import numpy as np
import pytest

from tidewright.operators import markov


def series_of(k: int, n: int):
    rng = np.random.default_rng(k)
    calm = np.repeat(rng.random(n // 20 + 1) < 0.6, 20)[:n]
    return np.where(calm, rng.normal(-2, 0.3, n), rng.normal(0, 0.8, n))


@pytest.mark.parametrize("switching", [True, False])
def test_many_paths_are_fitted_as_one_by_one(switching):
    paths, seeds = [series_of(k, 80 + 13 * k) for k in range(6)], [42, 43, 44, 42, 43, 44]
    many = markov.fit_many(paths, seeds, 2, 40, switching)
    for x, seed, m in zip(paths, seeds, many):
        one = markov.fit(x, 2, 40, seed, switching)
        assert m["converged"] == one["converged"] and m["llf"] == pytest.approx(one["llf"], abs=1e-6)
        for c in ("mean", "var", "move", "start"):
            assert m[c] == pytest.approx(one[c], abs=1e-5)


def test_filters_of_many_paths(spark):
    paths = [series_of(k, 60 + 7 * k) for k in range(4)]
    mean, var, move, first = np.array([-2.0, 0.0]), np.array([0.1, 0.6]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.5, 0.5])
    n = np.array([len(x) for x in paths])
    v = np.zeros((n.max(), 4))
    for k, x in enumerate(paths):
        v[: n[k], k] = x
    each = lambda a: np.repeat(a[..., None], 4, -1)
    f = markov._walked(v, n, each(mean), each(var), each(first), each(move), False)
    for k, x in enumerate(paths):
        assert f[: n[k], :, k] == pytest.approx(markov.forward(markov.emissions(x, mean, var), first, move)[0], abs=1e-9)


def test_few_rows_and_many_series(spark, monkeypatch):
    import pandas as pd

    d = pd.concat([pd.DataFrame({"symbol": f"s{k}", "idx": range(60 + k), "x": series_of(k, 60 + k)}) for k in range(12)] + [pd.DataFrame({"symbol": "short", "idx": range(5), "x": 1.0})])
    got = markov.restarts(spark.createDataFrame(d), "x", 2, starts=3, steps=10, retry=20).toPandas()
    assert len(got) == 36 and "short" not in set(got["symbol"])
    for r in got.sample(6, random_state=1).itertuples():
        x = series_of(int(r.symbol[1:]), 60 + int(r.symbol[1:]))
        one = markov.fit(x, 2, 10, 42 + r.start)
        one = one if one["converged"] else markov.fit(x, 2, 20, 42 + r.start)
        assert r.llf == pytest.approx(one["llf"], abs=1e-6) and r.converged == one["converged"]
