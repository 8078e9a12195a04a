"""Detectors of volatility states, each a function of bars to labels: -1 before there is one, then 0, 1, 2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markov, windows as W
from .measures import exact_quantiles
from .variance_ratio import rolling


def require_clean(bars: DataFrame, price: str = "close") -> DataFrame:
    """bars; a price that is null, not finite or not positive fails the job when it is read."""
    p = F.col(price)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")) | (p <= 0)
    return bars.withColumn(price, F.when(bad, F.raise_error(F.lit(f"{price} must be finite and positive")).cast("double")).otherwise(p))


def volatility_ratio(bars: DataFrame, fast: int = 20, slow: int = 100) -> DataFrame:
    """bars with ratio: realised volatility over fast bars to that over slow ones, null where the latter is 0."""
    if not 1 <= fast < slow:
        raise ValueError("1 <= fast < slow")

    def make(b):
        b = b.withColumn("__r", W.log_return())
        b = b.withColumns({"__f": W.rms(F.col("__r"), fast), "__s": W.rms(F.col("__r"), slow)})
        return b.withColumn("ratio", F.when(F.col("__s") > 0, F.col("__f") / F.col("__s"))).drop("__r", "__f", "__s")

    return W.over_chunks(bars, slow + 1, make)


def by_threshold(value: Column, low: Column | float, high: Column | float) -> Column:
    """0 up to low, 1 up to high, 2 above; -1 for null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNull() | low.isNull() | high.isNull(), -1).when(value <= low, 0).when(value <= high, 1).otherwise(2)


def static(bars: DataFrame, fast: int = 20, slow: int = 100, low: float = 1.2, high: float = 2.5) -> DataFrame:
    return volatility_ratio(bars, fast, slow).withColumn("label", by_threshold(F.col("ratio"), low, high))


def dynamic(bars: DataFrame, fast: int = 20, slow: int = 100, smooth: int = 20, w: int = 43_200, low: float = 0.75, high: float = 0.95) -> DataFrame:
    """Thresholds from trailing quantiles, nearest rank, of the smoothed ratio; they start with the first value."""
    b = W.ema(volatility_ratio(bars, fast, slow), "ratio", smooth)
    b = nearest_quantile(b, "ema", w, {"__lo": low, "__hi": high})
    return b.withColumn("label", by_threshold(F.col("ema"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def nearest_quantile(bars: DataFrame, column: str, w: int, qs: dict[str, float]) -> DataFrame:
    """Trailing quantiles over w rows by nearest rank, from the first value on."""
    return W.rolling_quantile(bars, column, w, qs, min_rows=1, interpolation="nearest")


def rolling_states(bars: DataFrame, vol: int = 60, w: int = 43_200, low: float = 0.75, high: float = 0.95, edges: tuple[str, str] | None = None) -> DataFrame:
    """The primary detector: realised volatility against its trailing quantiles over a full window; edges names columns for
    those."""
    lo, hi = edges or ("__lo", "__hi")
    b = W.rolling_quantile(W.over_chunks(bars, vol + 1, lambda b: W.realized_vol(b, vol)), "rv", w, {lo: low, hi: high})
    b = b.withColumn("label", by_threshold(F.col("rv"), F.col(lo), F.col(hi)))
    return b if edges else b.drop(lo, hi)


def global_states(df: DataFrame, value: str, low: float = 0.75, high: float = 0.95) -> DataFrame:
    """df with label by the value's quantiles over the whole table: below low, between, above high."""
    q = exact_quantiles(df, F.col(value), {"__lo": low, "__hi": high}).drop("n")
    return df.join(F.broadcast(q), F.lit(True), "left").withColumn("label", by_threshold(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row


def variance_ratio_states(bars: DataFrame, w: int = 120, q: int = 5) -> DataFrame:
    """|VR - 1| of the window that ends at each bar, as three states; no common market state, so not to be compared."""
    v = rolling(bars, w, (q,)).select("symbol", F.col("end_idx").alias("idx"), F.abs("vr_dev").alias("score"))
    return global_states(bars.join(v, ["symbol", "idx"], "left"), "score")


def two_states(label: Column) -> Column:
    """Low against the rest; -1 stays."""
    return F.when(label == 0, 0).when(label.isin(1, 2), 1).otherwise(-1)


def most_likely(probabilities: Column) -> Column:
    """Place of the largest probability, the first of equals; -1 if one isn't finite."""
    finite = ~F.exists(probabilities, lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(finite, F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1).otherwise(-1)


#: Detectors by name; DETECTORS[name](bars, **settings) has symbol, idx and label.
DETECTORS: dict[str, Callable[..., DataFrame]] = {"rolling_quantile": rolling_states, "static": static, "dynamic": dynamic, "variance_ratio": variance_ratio_states, "markov": markov.states}


def detect(name: str, bars: DataFrame, **settings) -> DataFrame:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; there are {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name](require_clean(bars), **settings)
