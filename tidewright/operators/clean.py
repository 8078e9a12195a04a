"""Checks and repairs of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bars import MINUTE, OHLCV, by_symbol


def bar_ok() -> Column:
    """Positive time and prices, no negative volume, high and low around open and close; null or NaN fails."""
    finite = F.lit(True)
    for c in OHLCV:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    shape = (F.col("high") >= F.greatest("low", "open", "close")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(finite & (F.col("ts") > 0) & (F.least("open", "high", "low", "close") > 0) & (F.col("volume") >= 0) & shape, F.lit(False))


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that pass, and the quarantined rest."""
    marked = bars.withColumn("bar_ok", bar_ok())
    return marked.filter("bar_ok").drop("bar_ok"), marked.filter(~F.col("bar_ok"))


def keep_first(bars: DataFrame, order: str = "ts") -> DataFrame:
    """One bar for each symbol and ts: the first in order."""
    from pyspark.sql import Window

    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))).filter("__n = 1").drop("__n")


def assert_ordered(bars: DataFrame) -> DataFrame:
    """bars, with an error where ts falls in order of idx."""
    before = F.lag("ts").over(by_symbol())
    bad = F.col("ts") < before
    return bars.withColumn("ts", F.when(bad, F.raise_error(F.lit("bars out of order")).cast("long")).otherwise(F.col("ts")))


def with_next(bars: DataFrame, chunk_ms: int = 30 * 86_400_000) -> DataFrame:
    """bars with next_ts, the time of the symbol's next bar. Bars meet by chunk of time; the last of a chunk looks at where the
    next chunk that has bars begins."""
    from pyspark.sql import Window

    b = bars.withColumn("__k", F.floor(F.col("ts") / chunk_ms))
    starts = b.groupBy("symbol", "__k").agg(F.min("ts").alias("__s"))
    starts = starts.withColumn("__s", F.lead("__s").over(by_symbol("__k")))  # a row a chunk
    inside = F.lead("ts").over(Window.partitionBy("symbol", "__k").orderBy("ts"))
    return b.withColumn("__in", inside).join(starts, ["symbol", "__k"]).withColumn("next_ts", F.coalesce("__in", "__s")).drop("__k", "__in", "__s")


def gap_fill(bars: DataFrame, step: int = MINUTE, max_gap: int = 10 * MINUTE, until: int | None = None) -> DataFrame:
    """bars with flat ones (last close, no volume) in every gap; trading_disabled where the gap is over max_gap. Each
    bar makes its own fillers from the distance to the next, so no state runs through the series. With until, a symbol
    whose last bar is more than max_gap before that time has flat bars up to it."""
    silent = F.lit(step) if until is None else F.when(until - F.col("ts") > max_gap, until - F.col("ts")).otherwise(step)
    b = with_next(bars).withColumn("gap", F.coalesce(F.col("next_ts") - F.col("ts"), silent))
    gap = F.col("gap")
    n = F.when(gap > step, F.floor(gap / step) - 1).otherwise(F.lit(0)).cast("long")
    b = b.select("symbol", "ts", *OHLCV, "gap", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
    own = F.col("k") == 0
    flat = lambda c: F.when(own, F.col(c)).otherwise(F.col("close")).alias(c)
    return b.select("symbol", (F.col("ts") + F.col("k") * step).alias("ts"), *[flat(c) for c in OHLCV[:4]], F.when(own, F.col("volume")).otherwise(0.0).alias("volume"), (~own & (F.col("gap") > max_gap)).alias("trading_disabled"))


def clamp(bars: DataFrame, least: float = 1e-12) -> DataFrame:
    return bars.withColumns({c: F.greatest(F.col(c), F.lit(least)) for c in OHLCV[:4]} | {"volume": F.greatest("volume", F.lit(0.0))})


def continuity(bars: DataFrame, step: int = MINUTE) -> DataFrame:
    """Bars, span and missing bars of each symbol."""
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).withColumn("missing", F.floor((F.col("last_ts") - F.col("first_ts")) / step) + 1 - F.col("n"))


def covers(bars: DataFrame, start: int, end: int, step: int = MINUTE, head: int = MINUTE, tail: int = 120 * MINUTE, share: float = 0.99) -> DataFrame:
    """Whether each symbol's bars cover the range: first and last bar near its ends, and enough bars between."""
    c = bars.filter((F.col("ts") >= start) & (F.col("ts") <= end)).groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    need = share * ((end - start) // step + 1)
    return c.select("symbol", "n", ((F.col("lo") <= start + head) & (F.col("hi") >= end - tail) & (F.col("n") >= need)).alias("covered"))


def in_session(ts: str = "ts", first: int = 12, end: int = 20) -> Column:
    """UTC hour in [first, end) on Monday to Friday."""
    t = F.timestamp_millis(ts)
    return (F.hour(t) >= first) & (F.hour(t) < end) & (F.weekday(t) < 5)


def holdout(bars: DataFrame, year: int) -> DataFrame:
    """By symbol: bars before the held-out year and from it on; clean if none is held out, partial if both kinds are there."""
    held = F.year(F.timestamp_millis("ts")) if "year" not in bars.columns else F.col("year")
    g = bars.groupBy("symbol").agg(F.sum((held < year).cast("long")).alias("n_in"), F.sum((held >= year).cast("long")).alias("n_held"))
    return g.withColumns({"clean": F.col("n_held") == 0, "partial": (F.col("n_held") > 0) & (F.col("n_in") > 0)})


def open_holdout(bars: DataFrame, year: int, permitted: bool, marker: str) -> DataFrame:
    """bars of the held-out years, if the caller says that they are permitted and the marker file, which says so for good, is
    there; else a PermissionError."""
    spark = bars.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(marker)
    if not permitted or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise PermissionError(f"the held-out years are closed: permitted is {permitted}, marker {marker}")
    return bars.filter(F.year(F.timestamp_millis("ts")) >= year)
