"""Nested regressions by sufficient statistics, equivalence tests, detection limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf as phi
from ..functions.numerics import chi2_sf, normal_cdf
from ..sources.bars import by_symbol


def design(df: DataFrame, label: str, value: str, w: int) -> DataFrame:
    """Rows at ends of windows of w bars with indicators of the present and of the previous bar's regime and of a change.
    The previous label is taken by bar, before rows are sampled."""
    d = df.withColumn("prev", F.lag(label).over(by_symbol()))
    d = d.filter(((F.col("idx") + 1) % w == 0) & (F.col(label) >= 0) & (F.col("prev") >= 0) & F.col(value).isNotNull())
    flag = lambda c, v: (F.col(c) == v).cast("double")
    return d.select("symbol", "idx", F.col(value).alias("y"), F.lit(1.0).alias("x0"), flag(label, 1).alias("x1"), flag(label, 2).alias("x2"), flag("prev", 1).alias("x3"), flag("prev", 2).alias("x4"), (F.col(label) != F.col("prev")).cast("double").alias("x5"))


def normal_equations(d: DataFrame, xs: list[str], lags: int, beta: list[float] | None = None) -> dict:
    """X'X, X'y, y'y and n in one aggregate; with beta also the lagged products of scores that Newey-West weighs."""
    if beta is None:
        aggs = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in xs for b in xs] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in xs]
        return d.agg(*aggs, F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n")).first().asDict()
    u = F.col("y")
    for x, b in zip(xs, beta):
        u = u - F.col(x) * b
    e = d.withColumn("u", u)
    for x in xs:
        e = e.withColumn("g_" + x, F.col(x) * F.col("u"))
    aggs = [F.sum(F.col("u") * F.col("u")).alias("rss")]
    for k in range(lags + 1):
        for b in xs:
            e = e.withColumn(f"g{k}_{b}", F.lag("g_" + b, k).over(by_symbol()))
        aggs += [F.sum(F.col("g_" + a) * F.col(f"g{k}_{b}")).alias(f"{k}_{a}_{b}") for a in xs for b in xs]
    return e.agg(*aggs).first().asDict()


def hac_ols(d: DataFrame, xs: list[str], lags: int = 5) -> dict:
    """OLS with Bartlett-weighted robust covariance and small-sample factor: beta, cov, r2, n. A design without full rank
    gives None for beta."""
    import numpy as np

    s = normal_equations(d, xs, lags)
    n, k = s["n"], len(xs)
    a = np.array([[s[f"{i}_{j}"] or 0.0 for j in xs] for i in xs])
    if n <= k or np.linalg.cond(a) > 1e12:
        return {"beta": None, "n": n}
    b = np.linalg.solve(a, np.array([s[f"{i}_y"] for i in xs]))
    m = normal_equations(d, xs, lags, b.tolist())
    meat = np.zeros((k, k))
    for lag in range(lags + 1):
        g = np.array([[m[f"{lag}_{i}_{j}"] or 0.0 for j in xs] for i in xs])
        meat += g if lag == 0 else (1 - lag / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(a)
    tss = s["yy"] - s["s"] ** 2 / n
    return {"beta": b, "cov": inv @ meat @ inv * n / (n - k), "r2": 1 - m["rss"] / tss if tss > 0 else 0.0, "n": n}


def nested_test(d: DataFrame, full: list[str], added: list[str], lags: int = 5) -> dict:
    """Wald statistic and p of the added columns, and the gain in R squared over the model without them."""
    import numpy as np

    big, small = hac_ols(d, full, lags), hac_ols(d, [x for x in full if x not in added], lags)
    if big["beta"] is None or small["beta"] is None:
        return {"wald": None, "p": None, "gain": None, "n": big["n"]}
    at = [full.index(x) for x in added]
    b, c = big["beta"][at], big["cov"][np.ix_(at, at)]
    wald = float(b @ np.linalg.solve(c, b))
    return {"wald": wald, "p": chi2_sf(wald, len(added)), "gain": big["r2"] - small["r2"], "n": big["n"]}


def tost(pairs: DataFrame, margin: float = 0.02) -> DataFrame:
    """Equivalence of two medians with 95 % intervals (m_1, lo_1, hi_1, m_2, ...): the larger one-sided z is small enough
    and the 90 % interval lies within the margin. z_tost is the smaller of the two test statistics."""
    se = F.sqrt(F.pow((F.col("hi_1") - F.col("lo_1")) / (2 * 1.959963984540054), 2) + F.pow((F.col("hi_2") - F.col("lo_2")) / (2 * 1.959963984540054), 2))
    d = pairs.withColumn("diff", F.col("m_1") - F.col("m_2")).withColumn("se", se)
    inside = (F.abs("diff") + 1.6448536269514722 * F.col("se")) < margin
    return d.withColumn("z_tost", F.try_divide(margin - F.abs("diff"), F.col("se"))).withColumn("equivalent", F.coalesce(inside, F.lit(False)))


def equivalent_medians(pairs: DataFrame, *by: str, margin: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """tost() with p (the larger one-sided p), p_holm over all rows of by, and equivalent: p_holm below alpha, too."""
    from .measures import holm

    d = tost(pairs, margin)
    d = d.withColumns({"__inside": F.col("equivalent"), "p": 1 - phi(F.coalesce("z_tost", F.lit(0.0)))}).drop("equivalent")
    return holm(d, "p", *by).withColumn("equivalent", F.col("__inside") & (F.col("p_holm") < alpha)).drop("__inside")


def tost_p(z: float) -> float:
    return 1 - normal_cdf(z)


def first_reaching(df: DataFrame, x: str, y: str, level: float, *by: str) -> DataFrame:
    """The x at which y, interpolated between neighbours, first reaches level; null if it never does."""
    w = Window.partitionBy(*by).orderBy(x)
    d = df.withColumn("px", F.lag(x).over(w)).withColumn("py", F.lag(y).over(w))
    cross: Column = F.when(F.col(y) >= level, F.when(F.col("py").isNull() | (F.col("py") >= level), F.col(x)).otherwise(F.col("px") + (F.col(x) - F.col("px")) * (level - F.col("py")) / (F.col(y) - F.col("py"))))
    return d.groupBy(*by).agg(F.min(cross).alias("at"))


def disposition(tests: list[tuple[str, float, bool]], alpha: float = 0.05, primary: str = "primary") -> str:
    """Verdict on specifications (name, p after Holm, degenerate): supported if the primary one passes and two in all do."""
    ok = {name: p < alpha and not degenerate for name, p, degenerate in tests}
    if all(degenerate for _, _, degenerate in tests):
        return "inconclusive"
    return "supported" if ok.get(primary) and sum(ok.values()) >= 2 else "not_supported"
