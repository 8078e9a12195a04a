"""Resamples that are measured together give what they give one by one."""

import numpy as np
import pytest

from tidewright.functions import neighbours as N


@pytest.mark.parametrize("n", [7, 40, 300, 700])
def test_nearest_neighbours_of_rows(n):
    rng = np.random.default_rng(n)
    x, y = rng.standard_t(2, n), rng.standard_t(2, n)
    at = rng.integers(0, n, (5, n))
    a, b = (np.stack(v) for v in zip(*(N._apart(x[p], y[p]) for p in at)))
    got = N.kth_distances_rows(a, b, 5)
    assert all((got[k] == N.kth_distances(a[k], b[k], 5)).all() for k in range(5))
    assert N.ksg_rows(x[at], y[at]) == pytest.approx([N.ksg(x[p], y[p]) for p in at], abs=1e-12)
