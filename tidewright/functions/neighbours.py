"""Mutual information of pairs of numbers from nearest neighbours (the first estimator of Kraskov, Stoegbauer and Grassberger)."""

from __future__ import annotations

import math

JITTER = 1e-10
FLOOR = 1e-10


def digamma(x):
    """Of positive numbers: recurrence up to 6, then the asymptotic series."""
    import numpy as np

    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def kth_distances(x, y, k: int, block: int = 1 << 22):
    """Largest-coordinate distance of each point to its k-th neighbour: points in order of x look at a window of neighbours
    in that order, which widens for those whose window doesn't prove the distance."""
    import numpy as np

    n = len(x)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    out, todo, half = np.empty(n), np.arange(n), max(2 * k, 16)
    while len(todo):
        half = min(half, n)
        rest, step = [], max(1, block // (2 * half + 1))
        for a in range(0, len(todo), step):
            at = todo[a : a + step]
            near = np.clip(at[:, None] + np.arange(-half, half + 1), -1, n)
            outside = (near < 0) | (near >= n) | (near == at[:, None])
            near = np.clip(near, 0, n - 1)
            d = np.maximum(np.abs(xs[near] - xs[at, None]), np.abs(ys[near] - ys[at, None]))
            d[outside] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            left = np.where(at - half - 1 >= 0, xs[at] - xs[np.maximum(at - half - 1, 0)], np.inf)
            right = np.where(at + half + 1 < n, xs[np.minimum(at + half + 1, n - 1)] - xs[at], np.inf)
            proved = kth <= np.minimum(left, right)
            out[order[at[proved]]] = kth[proved]
            rest.append(at[~proved])
        todo, half = np.concatenate(rest), half * 4
    return out


def within(values, radii):
    """How many other values lie within each value's radius."""
    import numpy as np

    s = np.sort(values)
    return np.searchsorted(s, values + radii, "right") - np.searchsorted(s, values - radii, "left") - 1


def _apart(x, y):
    """x and y without ties: these are broken by a jitter that the data seed."""
    import numpy as np

    n = len(x)
    if len(np.unique(x)) < n or len(np.unique(y)) < n:
        rng = np.random.default_rng(int(x.view(np.uint64).sum() ^ y.view(np.uint64).sum()) % (1 << 32))
        x, y = x + JITTER * rng.standard_normal(n), y + JITTER * rng.standard_normal(n)
    return x, y


def ksg(x, y, k: int = 5) -> float:
    """Nats, at least 0. Ties are broken by a jitter that the data seed."""
    import numpy as np

    x, y = np.array(x, float), np.array(y, float)
    n = len(x)
    if n != len(y) or n <= k:
        raise ValueError("x and y must be of one length above k")
    x, y = _apart(x, y)
    r = np.maximum(kth_distances(x, y, k) - 1e-15, FLOOR)
    return max(0.0, float(digamma(k) + digamma(n) - np.mean(digamma(within(x, r) + 1) + digamma(within(y, r) + 1))))


def kth_distances_rows(x, y, k: int, block: int = 1 << 20):
    """kth_distances() of each row of two matrices. Points in order of x meet those 1, 2, 3, ... places on, all rows at once, and keep
    their k least distances; the few that this doesn't prove look at all points of their row."""
    import numpy as np

    order = np.argsort(x, axis=1, kind="stable")
    xs, ys = (np.ascontiguousarray(np.take_along_axis(v, order, 1).T) for v in (x, y))
    n = len(xs)
    least, s = [np.full(xs.shape, np.inf) for _ in range(k)], 0
    while True:
        for s in range(s + 1, min(s + 17, n)):
            d = np.maximum(xs[s:] - xs[:-s], np.abs(ys[s:] - ys[:-s]))
            for part in (slice(None, n - s), slice(s, None)):
                v = d
                for j in range(k):
                    kept = least[j][part]
                    more = np.maximum(kept, v) if j < k - 1 else None
                    np.minimum(kept, v, out=kept)
                    v = more
        edge = np.full(xs.shape, np.inf)  # how far the nearest point in x is that wasn't met
        if s + 1 < n:
            gap = xs[s + 1 :] - xs[: -s - 1]
            edge[: n - s - 1] = gap
            edge[s + 1 :] = np.minimum(edge[s + 1 :], gap)
        i, row = np.nonzero(least[-1] > edge)
        if len(i) * 50 <= xs.size or s >= n - 1:
            break
    for a in range(0, len(i), step := max(1, block // n)):
        at, of = i[a : a + step], row[a : a + step]
        d = np.maximum(np.abs(xs[:, of] - xs[at, of]), np.abs(ys[:, of] - ys[at, of]))
        d[at, np.arange(len(at))] = np.inf
        least[-1][at, of] = np.partition(d, k - 1, axis=0)[k - 1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, least[-1].T, 1)
    return out


def ksg_rows(x, y, k: int = 5, most: int = 4_096) -> list[float]:
    """ksg() of each row of two matrices; rows longer than most go one by one."""
    import numpy as np

    n = x.shape[1]
    if n <= k or n > most:
        return [ksg(a, b, k) for a, b in zip(x, y)]
    x, y = (np.stack(v) for v in zip(*(_apart(a, b) for a, b in zip(x, y))))
    r, psi = np.maximum(kth_distances_rows(x, y, k) - 1e-15, FLOOR), digamma(np.arange(1, n + 1))
    return [max(0.0, float(digamma(k) + digamma(n) - np.mean(psi[within(a, d)] + psi[within(b, d)]))) for a, b, d in zip(x, y, r)]


def gaussian_pairs(n: int, nats: float, seed: int):
    """Pairs of a Gaussian law with that information."""
    import numpy as np

    rho = math.sqrt(1 - math.exp(-2 * nats))
    a, b = np.random.default_rng(seed).normal(size=(2, n))
    return a, rho * a + math.sqrt(1 - rho * rho) * b
