"""Queries through the library's other doors: SQL table functions, versioned tables, fingerprints, and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import fingerprint as P
from ..sources import versioned
from ..sources.bars import MINUTE, OHLCV, PANEL_SQL, TICKS_SQL, event_bars, event_bars_sql, panel, year_of
from ..sources.shared import scratch
from ..streaming import keyed
from .common import SQL, query, rounded
from .features import volume_bars as _  # noqa: F401  (its twin is used below)

HOUR, DAY = 60 * MINUTE, 86_400_000
FIRST, SECOND = 1_704_844_800_000, 1_705_708_800_000  # two days within the events


@query(SQL["volume_bars"])
def volume_bars_by_sql(spark, sf):
    """volume_bars through the table function."""
    catalog.register(spark)
    panel(spark, sf).select(F.col("symbol").cast("string").alias("symbol"), "idx", "ts", *OHLCV).createOrReplaceTempView("tidewright_bars")
    d = spark.sql("SELECT symbol, idx, ts, amount FROM bars_by_volume(TABLE(tidewright_bars) PARTITION BY symbol ORDER BY (idx), 500)")
    return rounded(d.withColumn("symbol", F.col("symbol").cast(panel(spark, sf).schema["symbol"].dataType)), "amount")


@query(f"""WITH {event_bars_sql(HOUR, 'event_type')} SELECT symbol, ts, round(close + CASE WHEN ts >= {SECOND} THEN 1 ELSE 0 END, 6) AS close, round(volume, 6) AS volume FROM bars""")
def versioned_upsert(spark, sf):
    """A store of the bars up to a day, to which bars from an earlier day on are added twice under one key."""
    path = scratch(spark, "store")
    b = event_bars(spark, sf, HOUR, F.col("event_type")).withColumn("year", year_of("ts"))
    later = b.filter(F.col("ts") >= FIRST).withColumn("close", F.col("close") + 1)
    versioned.commit(spark, path, lambda old: b.filter(F.col("ts") < SECOND), ["symbol", "year"])
    for _ in range(2):
        versioned.upsert(spark, path, later, ["symbol", "year"], key="later")
    return rounded(versioned.read(spark, path).select("symbol", "ts", "close", "volume"), "close", "volume")


_H = "sha256(concat_ws(chr(31), o_custkey, o_orderkey, o_orderpriority))"


@query(f"SELECT o_orderstatus, count(*) AS n, sum(('0x' || substr({_H}, 1, 15))::BIGINT)::VARCHAR AS a, sum(('0x' || substr({_H}, 16, 15))::BIGINT)::VARCHAR AS b FROM orders GROUP BY o_orderstatus")
def table_fingerprint(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d = P.fingerprint(o.select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority"), None, "o_orderstatus")
    return d.select("o_orderstatus", "n", F.col("a").cast("decimal(38,0)").cast("string").alias("a"), F.col("b").cast("decimal(38,0)").cast("string").alias("b"))


CHANGED = "o_totalprice > 300000 AND o_orderpriority <> '1-URGENT'"


@query(f"SELECT o_orderkey, 'o_orderpriority' AS field, o_orderpriority AS a, '1-URGENT' AS b FROM orders WHERE {CHANGED}")
def table_differences(spark, sf):
    """Fields in which orders differ from a copy where dear ones are urgent."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    other = o.withColumn("o_orderpriority", F.when(F.expr(CHANGED), F.lit("1-URGENT")).otherwise(F.col("o_orderpriority")))
    return P.differing_fields(o, other, "o_orderkey", ["o_custkey", "o_orderpriority"])


@contextmanager
def _states(spark):
    """A state store that keeps several states a key, and few partitions of it, while a stream runs."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _streamed(spark, sf, build):
    """What a stream over all events puts out."""
    path, source = scratch(spark, "stream"), f"{sf}/events.parquet"
    files = f"{sf}/events.parque[t]"  # a pattern: a stream's source may be one file then
    with _states(spark):
        s = spark.readStream.schema(spark.read.parquet(source).schema).parquet(files)
        out = build(s.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("time"), (100 + F.col("value")).alias("price"), F.col("value").alias("volume")))
        schema = out.schema
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


@query(f"""WITH {TICKS_SQL}, e AS (SELECT event_type AS symbol, idx, price, volume, row_number() OVER (PARTITION BY event_type ORDER BY idx) AS k FROM (SELECT event_type, seq AS idx, price, volume FROM ticks)),
r AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE ln(price) - ln(lag(price) OVER w) END AS r FROM e WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
v AS (SELECT *, CASE WHEN k >= 60 THEN sqrt(avg(r * r) OVER f) END AS rv, CASE WHEN k >= 60 THEN sum(price * volume) OVER f / nullif(sum(volume) OVER f, 0) END AS vwap, CASE WHEN k >= 20 THEN max(price) OVER g END AS upper, CASE WHEN k >= 20 THEN min(price) OVER g END AS lower
 FROM r WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING), g AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING))
SELECT symbol, idx, round(rv, 6) AS rv, round(vwap, 6) AS vwap, round(upper, 6) AS upper, round(lower, 6) AS lower, CASE WHEN count(rv) OVER h = 120 THEN round(quantile_cont(rv, 0.75) OVER h, 6) END AS q75 FROM v WINDOW h AS (PARTITION BY symbol ORDER BY idx ROWS 119 PRECEDING)""")
def stream_features(spark, sf):
    """Rolling features of each kind of event, as a stream."""
    bars = lambda s: s.select("symbol", "idx", F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), "volume")
    d = _streamed(spark, sf, lambda s: keyed.rolling_features(bars(s), ps={"q75": 0.75}))
    return rounded(d, "rv", "vwap", "upper", "lower", "q75")


@query(f"""WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS t FROM events), e AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts, arg_min(100 + value, event_id) AS price, arg_min(value, event_id) AS volume FROM events GROUP BY ALL),
g AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM e), h AS (SELECT g.*, CASE WHEN nx <= t THEN nx - ts WHEN t - ts > {6 * HOUR} THEN t - ts ELSE {HOUR} END AS gap, t FROM g, w WHERE ts <= t),
k AS (SELECT *, unnest(range(0, greatest(gap // {HOUR}, 1))) AS k FROM h)
SELECT symbol, ts + k * {HOUR} AS ts, round(price, 6) AS close, round(CASE WHEN k = 0 THEN volume ELSE 0 END, 6) AS volume, k > 0 AND gap > {6 * HOUR} AS trading_disabled FROM k""")
def stream_gap_fill(spark, sf):
    """Events of each kind as bars of a stream, with flat bars in gaps of more than an hour; a kind that falls silent has them
    from a timer. The watermark is a day behind."""
    bars = lambda s: s.select("symbol", "time", *[F.col("price").alias(c) for c in OHLCV[:4]], "volume")
    d = _streamed(spark, sf, lambda s: keyed.fill_gaps_timed(bars(s), HOUR, 6 * HOUR, "1 day"))
    return rounded(d.select("symbol", "ts", "close", "volume", "trading_disabled"), "close", "volume")
