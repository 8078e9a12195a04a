"""Closed forms and small solvers, plain Python."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of normal_cdf, by bisection."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: int) -> float:
    if df == 1:
        return math.erfc(math.sqrt(max(x, 0) / 2))
    if df % 2 == 0:
        half = max(x, 0) / 2
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(df // 2))
    raise ValueError("df must be 1 or even")


def noncentral_chi2_sf(x: float, shift: float) -> float:
    """Tail of the square of a normal variable with mean sqrt(shift)."""
    a, b = math.sqrt(x), math.sqrt(shift)
    return normal_cdf(b - a) + normal_cdf(-b - a)


def mde_partial_r2(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """Smallest partial R squared that a Wald test of one restriction detects with that power."""
    crit, lo, hi = normal_ppf(1 - alpha / 2) ** 2, 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if noncentral_chi2_sf(crit, mid) < power else (lo, mid)
    return lo / (n + lo)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def beta_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Quantiles of Beta(k + 1, n - k + 1); one-sided at 0 and n."""
    lo = 0.0 if k == 0 else beta_ppf(alpha / 2, k + 1, n - k + 1)
    hi = 1.0 if k == n else beta_ppf(1 - alpha / 2, k + 1, n - k + 1)
    return lo, hi


def holm(p: list[float], family: int | None = None) -> list[float]:
    m, out, top = family or len(p), [0.0] * len(p), 0.0
    for k, i in enumerate(sorted(range(len(p)), key=lambda i: (1.0 if math.isnan(p[i]) else p[i]))):
        top = max(top, min(1.0, (1.0 if math.isnan(p[i]) else p[i]) * (m - k)))
        out[i] = top
    return out


def empirical_p(value: float, null: list[float], side: str = "two") -> float:
    """(1 + hits) / (1 + n)."""
    hit = {"two": lambda v: abs(v) >= abs(value), "greater": lambda v: v >= value, "less": lambda v: v <= value}[side]
    return (1 + sum(map(hit, null))) / (1 + len(null))


def sharpe_deviation(ratio: float, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """Standard deviation of an estimated Sharpe ratio of n returns with that skewness and kurtosis (Mertens): the
    variance is the Gaussian (1 + ratio ** 2 / 2), corrected for both moments, over n - 1."""
    variance = 1 + ratio * ratio / 2 - skew * ratio + (kurt - 3) * ratio * ratio / 4
    return math.sqrt(max(variance, 1e-12) / (n - 1))


def expected_maximum(trials: int) -> float:
    """Of the largest of independent standard normal variables, by the extreme-value approximation: the mean of a Gumbel law
    set by the quantiles at 1 / trials and 1 / (e * trials)."""
    tail = [normal_ppf(1 - math.exp(-k) / trials) for k in (0, 1)]
    return tail[0] + 0.5772156649 * (tail[1] - tail[0])


def probabilistic_sharpe(ratio: float, n: int, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0) -> float:
    """Probability that the true ratio is above the benchmark (Bailey and Lopez de Prado); 0 for fewer than two returns."""
    return normal_cdf((ratio - benchmark) / sharpe_deviation(ratio, n, skew, kurt)) if n > 1 else 0.0


def deflated_sharpe(ratio: float, n: int, trials: int, variance: float, skew: float = 0.0, kurt: float = 3.0) -> float:
    """The same against the best ratio that trials without skill would show, their ratios having that variance; 0 where
    there is nothing to deflate by."""
    usable = trials > 0 and variance > 0
    return probabilistic_sharpe(ratio, n, skew, kurt, expected_maximum(trials) * variance**0.5) if usable else 0.0


def mde(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    return (normal_ppf(1 - alpha / 2) + normal_ppf(power)) / math.sqrt(n)


def pchip(xs: list[float], ys: list[float]):
    """Monotone cubic interpolation (Fritsch and Carlson)."""
    n = len(xs)
    h = [b - a for a, b in zip(xs, xs[1:])]
    s = [(b - a) / d for a, b, d in zip(ys, ys[1:], h)]

    def end(h0, h1, s0, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return 0.0 if d * s0 <= 0 else 3 * s0 if s0 * s1 <= 0 and abs(d) > abs(3 * s0) else d

    d = [s[0]] * n
    if n > 2:
        d[0], d[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
        for k in range(1, n - 1):
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            d[k] = 0.0 if s[k - 1] * s[k] <= 0 else (a + b) / (a / s[k - 1] + b / s[k])

    def at(x: float) -> float:
        k = min(max(sum(v <= x for v in xs) - 1, 0), n - 2)
        t = (x - xs[k]) / h[k]
        return ys[k] * (1 + 2 * t) * (1 - t) ** 2 + d[k] * h[k] * t * (1 - t) ** 2 + ys[k + 1] * t * t * (3 - 2 * t) + d[k + 1] * h[k] * t * t * (t - 1)

    return at


def recurrence(a: float):
    """A function of x and first: y_0 = first, y_t = a * y_{t-1} + x_t, by blocks of powers small enough not to vanish."""
    import numpy as np

    size = 256 if a == 0 or abs(a) > 0.2 else 64
    p = a ** np.arange(size + 1)
    lower = np.tril(p[np.subtract.outer(np.arange(size), np.arange(size)).clip(0)])

    def solve(x, first: float):
        y, last = np.empty(len(x)), first
        y[0] = first
        for s in range(1, len(x), size):
            b = x[s : s + size]
            m = len(b)
            y[s : s + m] = lower[:m, :m] @ b + p[1 : m + 1] * last
            last = y[s + m - 1]
        return y

    return solve
