"""Injected draws of a cell, made together, are those of one after the other."""

import numpy as np
import pytest

from tidewright.functions.numerics import recurrence
from tidewright.operators import injection
from tidewright.operators.nulls import median_z


def test_injected_draws(spark):
    import zlib

    x = np.random.default_rng(3).normal(0, 1e-3, 360)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, idx long, r double")
    got = {r["phi"]: r for r in injection.cell_power(d, "r", (0.0, 0.5), n_mc=25).collect()}
    sigma, solve = injection.ewma_sigma(x), recurrence(0.5)
    assert (injection.inject(x, 0.5, 1, sigma) == injection.inject(x, 0.5, 1, sigma, solve=solve)).all()
    for phi, r in got.items():
        z = [median_z(injection.inject(x, phi, [43, zlib.crc32(b"a"), int(phi * 1e6), k], sigma), 120, 5) for k in range(25)]
        assert r["n"] == 25 and r["median_z"] == pytest.approx(np.median(z), abs=1e-12)
