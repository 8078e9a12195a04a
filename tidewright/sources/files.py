"""Files about bars: text sinks and scans, grids of JSON results, latest artifacts, plans of what is left to load."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import MINUTE, OHLCV, parse_ticks

SLICE = 30 * 24 * 60 * MINUTE


def write_rows(df: DataFrame, path: str) -> None:
    """CSV with a header, part files under path."""
    df.write.mode("overwrite").option("header", True).csv(path)


def scan_rows(spark: SparkSession, paths: list[str] | str, schema: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows of CSV files, folders or patterns, each once, with source_file; both ends of the range of ts are in it."""
    paths = sorted(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    df = spark.read.schema(schema).option("header", True).csv(paths).withColumn("source_file", F.col("_metadata.file_path"))
    if start_ms is not None:
        df = df.filter(F.col("ts") >= start_ms)
    return df if end_ms is None else df.filter(F.col("ts") <= end_ms)


def read_ticks(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Parsed lines of tick files; most, if given, is how many lines are read."""
    lines = spark.read.text(path)
    return parse_ticks(lines if most is None else lines.limit(most))


def first_of_year(spark: SparkSession, path: str, symbol: str, year: int) -> DataFrame:
    """Bars of the first file of a symbol's year, in order of time."""
    df = spark.read.parquet(path).filter((F.col("symbol") == symbol) & (F.col("year") == year)).withColumn("__f", F.col("_metadata.file_path"))
    first = df.agg(F.min("__f").alias("__m"))
    return df.join(F.broadcast(first), F.col("__f") == F.col("__m")).select("symbol", "ts", *OHLCV).orderBy("ts")  # one row


def read_grid(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON results, one a file, with delta, q and W; an older name of delta is delta_target. One without either fails."""
    r = spark.read.option("multiLine", True)
    df = (r.schema(schema) if schema else r).json(path)
    names = [F.col(c).cast("double") for c in ("delta", "delta_target") if c in df.columns]
    delta = F.coalesce(*names, F.raise_error(F.lit("a result lacks delta")).cast("double")) if names else F.raise_error(F.lit("a result lacks delta")).cast("double")
    return df.withColumn("delta", delta)


def latest(spark: SparkSession, path: str, by: str = "name") -> str | None:
    """The last of the files under path, by name or by time of change; only their names are listed."""
    order = {"name": F.col("path"), "time": F.struct("modificationTime", "path")}[by]
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    row = f.agg(F.max_by("path", order).alias("p")).first()
    return row["p"]


def json_safe(df: DataFrame) -> DataFrame:
    """df with numbers that JSON hasn't as nulls."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c)) for c in df.columns if kinds[c] in ("double", "float")})


def write_missing(planned: DataFrame, path: str, keys: list[str], compute) -> DataFrame:
    """Computes the planned cells that path doesn't hold yet, and appends them; a rerun goes on where it stopped. What Spark
    appends is committed as a whole."""
    from ..operators.joins import missing

    spark = planned.sparkSession
    try:
        done = spark.read.parquet(path)
        planned = missing(planned, done.select(keys), keys)
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    compute(planned).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def finite_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    return df


def parse_ms(value: str | Column, end_of_day: bool = False) -> Column:
    """Epoch milliseconds of a date or timestamp in UTC; a date alone is its first or its last millisecond."""
    v = F.trim(F.lit(value) if isinstance(value, str) else value)
    day = F.unix_millis(F.to_timestamp(F.substring(v, 1, 10), "yyyy-MM-dd")) + (86_400_000 - 1 if end_of_day else 0)
    return F.when(F.contains(v, F.lit("T")), F.unix_millis(F.to_timestamp(v))).otherwise(day)


def window_of(bars: DataFrame, start: str, end: str, holdout_year: int | None = None) -> DataFrame:
    """bars from start to end, both in; fails at a bar of the held-out year, and where time stands still or goes back."""
    b = bars.filter(F.col("ts").between(parse_ms(start), parse_ms(end, True)))
    bad = F.col("ts") <= F.lag("ts").over(Window.partitionBy("symbol").orderBy("idx"))
    ts = F.when(bad, F.raise_error(F.lit("timestamps must rise")).cast("long")).otherwise(F.col("ts"))
    if holdout_year is not None:
        ts = F.when(F.year(F.timestamp_millis("ts")) >= holdout_year, F.raise_error(F.lit("the window holds held-out bars")).cast("long")).otherwise(ts)
    return b.withColumn("ts", ts)


def lookback(text: str, now: datetime | None = None) -> tuple[int, int]:
    """Milliseconds from and to: 3y, 6m (of 30 days), 90d back from now, or two dates with a slash, the latter to its end."""
    now, text = now or datetime.now(timezone.utc), text.strip()
    ms = lambda t: int(t.timestamp() * 1000)
    if m := re.fullmatch(r"(\d+)([ymd])", text):
        return ms(now - timedelta(days=int(m[1]) * {"y": 365, "m": 30, "d": 1}[m[2]])), ms(now)
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\d)\s*/\s*(\d{4}-\d\d-\d\d)", text):
        a, b = (datetime.fromisoformat(x).replace(tzinfo=timezone.utc) for x in m.groups())
        return ms(a), ms(b) + 86_400_000 - 1
    raise ValueError(f"{text!r} is no lookback: write 3y, 6m, 90d or YYYY-MM-DD/YYYY-MM-DD")


def load_plan(bars: DataFrame, start: int, end: int) -> DataFrame:
    """symbol, backfill, slice_start, slice_end: what a loader has still to fetch. Symbols that cover the range have no row."""
    g = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    early = F.col("lo") > start + MINUTE
    g = g.filter(~((F.col("hi") >= end - MINUTE) & ~early))
    g = g.select("symbol", early.alias("backfill"), F.when(early, F.lit(start)).otherwise(F.greatest(F.lit(start), F.col("hi") + MINUTE)).alias("s")).filter(F.col("s") < end)
    at = F.explode(F.sequence(F.col("s"), F.lit(end - 1), F.lit(SLICE + MINUTE)))
    return g.withColumn("slice_start", at).select("symbol", "backfill", "slice_start", F.least(F.col("slice_start") + SLICE, F.lit(end)).alias("slice_end"))


def forms(html: Column, name: str) -> Column:
    """The value of a form's hidden field."""
    return F.regexp_extract(html, rf'name="{name}"[^>]*value="([^"]*)"', 1)


def precompute(bars: DataFrame, path: str, span: int = 60) -> DataFrame:
    """Returns, their volatility path and times as a table at path, rows with undefined numbers left out: what injection
    runs start from."""
    from ..operators.windows import log_return, realized_vol

    b = realized_vol(bars, span, "sigma", ewma=True).withColumn("r", log_return(zero_first=False))
    finite_pairs(b, "r", "sigma").select("symbol", "idx", "ts", "r", "sigma").write.mode("overwrite").parquet(path)
    return bars.sparkSession.read.parquet(path)
