"""Other clocks: time, volume and intrinsic-time bars, and samplers of bar-indexed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import OHLCV, by_symbol, slot
from .greedy import greedy_events


def resample(bars: DataFrame, freq_ms: int) -> DataFrame:
    """Bars of freq_ms: first, max, min, last, sum; ts is the bucket's start; partial edges stay."""
    b = bars.withColumn("b", slot("ts", freq_ms) * freq_ms)
    return b.groupBy("symbol", "b").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("b", "ts")


def accumulated(bars: DataFrame, contribution: str, threshold: float, size: int | None = None) -> DataFrame:
    """Bars that close as soon as the sum of contribution since the last close reaches the threshold. Rows without a
    contribution are skipped, overshoot stays in the bar, an open tail goes. ts is the closing row's."""
    columns = list(dict.fromkeys(["symbol", "idx", "ts", *OHLCV, contribution]))
    e = greedy_events(bars.select(columns).filter(F.col(contribution) > 0), threshold, contribution, size)
    bar = e.groupBy("symbol", F.col("before").alias("bar")).agg(
        F.max(F.when(F.col("event"), F.col("ts"))).alias("ts"), F.min_by("open", "idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "idx").alias("close"), F.sum("volume").alias("volume"), F.sum(F.col(contribution).cast("double")).alias("amount"),
    )
    return bar.filter("ts IS NOT NULL").withColumnRenamed("bar", "idx").select("symbol", "idx", "ts", *OHLCV, "amount")


def volume_bars(bars: DataFrame, threshold: float) -> DataFrame:
    return accumulated(bars, "volume", threshold)


def intrinsic_bars(bars: DataFrame, threshold: float, window: int = 60) -> DataFrame:
    """Bars of equal realised variance: what a bar adds is the sum of squared returns over the last window bars, as many
    as there are."""
    from .windows import frame, log_return

    b = bars.withColumn("__sq", log_return() * log_return())
    return accumulated(b.withColumn("rv_part", F.sum("__sq").over(frame(window))), "rv_part", threshold)


def gauge(name: str, bars: DataFrame, volume: float | None = None, variance: float | None = None) -> DataFrame:
    """Bars by a clock: 'clock' as they are, 'volume' or 'intrinsic' by their threshold."""
    if name == "clock":
        return bars
    if name == "volume":
        return volume_bars(bars, volume)
    if name == "intrinsic":
        return intrinsic_bars(bars, variance)
    raise ValueError(f"unknown clock {name!r}")


def threshold_sweep(bars: DataFrame, thresholds: list[float]) -> DataFrame:
    """symbol, threshold, n, median_min: how many volume bars each threshold makes, and how long they are."""
    from functools import reduce

    one = lambda t: durations(volume_bars(bars, t)).select("symbol", F.lit(t).alias("threshold"), F.col("n") + 1, "median_min").toDF("symbol", "threshold", "n", "median_min")
    return reduce(DataFrame.unionByName, map(one, thresholds))


def overshoot(bars: DataFrame, threshold: float) -> DataFrame:
    """By symbol: bars, median and largest overshoot in percent, share of bars that overshoot."""
    x = F.when(F.col("amount") > threshold, (F.col("amount") - threshold) / threshold * 100)
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(x, F.lit(0.5)).alias("median_pct"), F.max(x).alias("max_pct"), F.avg(F.when(F.col("amount") > threshold, 1.0).otherwise(0.0)).alias("share"))


def durations(bars: DataFrame) -> DataFrame:
    from .clean import with_next

    d = with_next(bars).withColumn("d", (F.col("next_ts") - F.col("ts")) / 60000)
    return d.groupBy("symbol").agg(F.count("d").alias("n"), F.percentile("d", F.lit(0.5)).alias("median_min"), F.max("d").alias("max_min"))


def non_overlapping(df: DataFrame, w: int, value: str, label: str | None = None) -> DataFrame:
    """Rows whose idx ends a window of w, with a finite value and, if asked for, a valid label."""
    df = df.filter((F.col("idx") >= w - 1) & ((F.col("idx") - (w - 1)) % w == 0) & F.col(value).isNotNull() & ~F.isnan(value))
    return df.filter(F.col(label) >= 0) if label else df


def compacted(df: DataFrame, w: int, value: str) -> DataFrame:
    """Every w-th of the rows that have a value, whatever their idx: the older sampler."""
    d = df.filter(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(by_symbol()))
    return d.filter(F.col("__n") % w == 0).drop("__n")


def impulses(df: DataFrame, value: str, share: float = 0.9) -> DataFrame:
    """df with impulse: whether |value| is in the top of its size, over the table."""
    from .measures import exact_quantiles

    q = exact_quantiles(df, F.abs(value), {"__q": share}).drop("n")
    return df.join(F.broadcast(q), F.lit(True), "left").withColumn("impulse", F.abs(value) >= F.col("__q")).drop("__q")  # one row


def enough_events(kept: DataFrame, up: str, down: str, least: int = 50) -> DataFrame:
    """By symbol: thinned events of either kind, and whether one kind is too rare for a test."""
    g = kept.groupBy("symbol").agg(F.sum(F.col(up).cast("long")).alias("n_up"), F.sum(F.col(down).cast("long")).alias("n_down"))
    return g.withColumn("under_powered", F.least("n_up", "n_down") < least)


def thinned(df: DataFrame, w: int, flag: str, size: int | None = None) -> DataFrame:
    """Flagged rows at least w bars apart, taken greedily in order."""
    return greedy_events(df.filter(flag), w, size=size).filter("event").drop("event", "before")
