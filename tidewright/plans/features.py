"""Queries over scans, cleaning, scalar projections, windows and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean, rebar, windows as W
from ..sources.bars import EPOCH, MINUTE, PANEL_SQL, TICKS_SQL, by_symbol, event_bars, event_bars_sql, panel, parse_ticks, slot, ticks, upsert_bars
from .common import query, rounded

FIVE, HOUR = 5 * MINUTE, 60 * MINUTE
BARS = event_bars_sql(FIVE)
HOURS = event_bars_sql(HOUR)


@query(f"WITH {PANEL_SQL} SELECT symbol, year, count(*) AS n, round(sum(volume), 6) AS volume FROM panel WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL")
def scan_years(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf).filter(F.col("year").between(1996, 1998)).groupBy("symbol", "year").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")), "volume")


@query(f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def resample_time_bars(spark, sf):
    return rounded(event_bars(spark, sf, FIVE), "open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, h AS (SELECT symbol, ts // {HOUR} * {HOUR} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, ts // {HOUR})
SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM h""")
def resample_twice(spark, sf):
    return rounded(rebar.resample(event_bars(spark, sf, FIVE), HOUR), "open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, g AS (SELECT *, coalesce(lead(ts) OVER (ORDER BY ts) - ts, {FIVE}) AS gap FROM bars),
k AS (SELECT *, unnest(range(0, greatest(gap // {FIVE}, 1))) AS k FROM g)
SELECT symbol, ts + k * {FIVE} AS ts, round(CASE WHEN k = 0 THEN open ELSE close END, 6) AS open, round(CASE WHEN k = 0 THEN high ELSE close END, 6) AS high, round(CASE WHEN k = 0 THEN low ELSE close END, 6) AS low,
 round(close, 6) AS close, round(CASE WHEN k = 0 THEN volume ELSE 0 END, 6) AS volume, k > 0 AND gap > {2 * FIVE} AS trading_disabled FROM k""")
def clean_gap_fill(spark, sf):
    return rounded(clean.gap_fill(event_bars(spark, sf, FIVE), FIVE, 2 * FIVE), "open", "high", "low", "close", "volume")


@query(f"WITH {PANEL_SQL} SELECT symbol, count(*) AS n, sum((volume > 10 AND idx > 0)::INT)::BIGINT AS ok FROM panel GROUP BY ALL")
def clean_invariants(spark, sf):
    bars = panel(spark, sf).withColumn("high", F.when(F.col("volume") > 10, F.col("high")).otherwise(F.col("low") - 1)).withColumn("ts", F.when(F.col("idx") > 0, F.col("ts")).otherwise(0))
    return bars.withColumn("ok", clean.bar_ok()).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("ok"))


@query(f"WITH {PANEL_SQL} SELECT symbol, idx, round(greatest(close - 1000, 1e-12), 6) AS close, round(greatest(volume - 10, 0), 6) AS volume FROM panel")
def clean_clamp(spark, sf):
    b = panel(spark, sf).withColumns({"close": F.col("close") - 1000, "volume": F.col("volume") - 10})
    return rounded(clean.clamp(b).select("symbol", "idx", "close", "volume"), "close", "volume")


@query(f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, (max(ts) - min(ts)) // {FIVE} + 1 - count(*) AS missing FROM bars GROUP BY symbol")
def continuity(spark, sf):
    return clean.continuity(event_bars(spark, sf, FIVE), FIVE)


@query(f"""WITH {event_bars_sql(HOUR, 'event_type')}, r AS (SELECT min(ts) AS a, max(ts) AS b FROM bars), c AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM bars GROUP BY symbol)
SELECT symbol, n, lo <= 1704067200000 + {HOUR} AND hi >= 1706655600000 - {2 * HOUR} AND n >= 0.9 * 720 AS covered FROM c""")
def coverage(spark, sf):
    return clean.covers(event_bars(spark, sf, HOUR, F.col("event_type")), 1704067200000, 1706655600000, HOUR, HOUR, 2 * HOUR, 0.9)


@query(f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars WHERE hour(make_timestamp(ts * 1000)) BETWEEN 12 AND 19 AND isodow(make_timestamp(ts * 1000)) <= 5 GROUP BY symbol")
def session_filter(spark, sf):
    return event_bars(spark, sf, FIVE).filter(clean.in_session()).groupBy("symbol").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, ts, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts) AS n, event_type FROM events)
SELECT event_type AS symbol, epoch_ms(date_trunc('hour', ts)) AS ts, round(value, 6) AS value FROM a WHERE n = 1""")
def keep_first_dedupe(spark, sf):
    at = F.col("ts").cast("timestamp")
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.unix_micros(at).alias("at"), F.unix_millis(F.date_trunc("hour", at)).alias("ts"), "value")
    return rounded(clean.keep_first(t, "at").select("symbol", "ts", "value"), "value")


@query(f"""WITH {BARS}, u AS (
 SELECT symbol, ts, close, 0 AS src FROM bars WHERE ts < 1705708800000 UNION ALL SELECT symbol, ts, close + 1, 1 FROM bars WHERE ts >= 1704844800000), d AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY src) AS n FROM u)
SELECT symbol, ts, round(close, 6) AS close FROM d WHERE n = 1""")
def upsert_partition(spark, sf):
    b = event_bars(spark, sf, FIVE)  # two loads that overlap by ten days
    old, new = b.filter("ts < 1705708800000").select("symbol", "ts", "close"), b.filter("ts >= 1704844800000").select("symbol", "ts", (F.col("close") + 1).alias("close"))
    return rounded(upsert_bars(old, new), "close")


TICK_SQL = f"WITH {TICKS_SQL}, q AS (SELECT seq, ts, price AS bid, price + 0.01 * (1 + seq % 5) AS ask FROM ticks), m AS (SELECT ts // 60000 * 60000 AS ts, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask, count(*) AS n_ticks FROM q GROUP BY ts // 60000)"


def _quotes(spark, sf):
    t = ticks(spark, sf)
    q = t.select("seq", "ts", F.col("price").alias("bid"), (F.col("price") + 0.01 * (1 + F.col("seq") % 5)).alias("ask"))
    return q.groupBy((slot("ts", MINUTE) * MINUTE).alias("minute")).agg(F.max_by("bid", "seq").alias("bid"), F.max_by("ask", "seq").alias("ask"), F.count("*").alias("n_ticks")).withColumnRenamed("minute", "ts")


@query(TICK_SQL + " SELECT ts, round(bid, 6) AS bid, round(ask, 6) AS ask, round(ask - bid, 6) AS spread, round((ask + bid) / 2, 6) AS mid, n_ticks FROM m")
def tick_minutes(spark, sf):
    q = _quotes(spark, sf)
    return rounded(q.select("ts", "bid", "ask", (F.col("ask") - F.col("bid")).alias("spread"), ((F.col("ask") + F.col("bid")) / 2).alias("mid"), "n_ticks"), "bid", "ask", "spread", "mid")


@query(TICK_SQL + " , s AS (SELECT *, (ask - bid) / ((ask + bid) / 2) * 1e4 AS bps FROM m) SELECT count(*) AS n, sum(n_ticks)::BIGINT AS ticks, min(ts) AS first_ts, max(ts) AS last_ts, round(median(bps), 6) AS median_bps, round(avg(bps), 6) AS mean_bps, round(max(bps), 6) AS max_bps FROM s")
def spread_summary(spark, sf):
    q = _quotes(spark, sf).withColumn("bps", (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4)
    return rounded(q.agg(F.count("*").alias("n"), F.sum("n_ticks").alias("ticks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.percentile("bps", F.lit(0.5)).alias("median_bps"), F.avg("bps").alias("mean_bps"), F.max("bps").alias("max_bps")), "median_bps", "mean_bps", "max_bps")


@query("""SELECT event_id AS seq, epoch_ms(date_trunc('second', ts)) AS ts, round(100 + value, 6) AS bid, round(100.01 + value, 6) AS ask, round((200.01 + 2 * value) / 2, 6) AS mid FROM events""")
def tick_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("t"), "value")
    fmt = F.when(F.col("event_id") % 3 == 0, F.date_format("t", "yyyyMMdd HHmmss000")).when(F.col("event_id") % 3 == 1, F.date_format("t", "yyyyMMdd HHmmss")).otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    lines = e.select(F.concat_ws(",", fmt, (100 + F.col("value")).cast("string"), (100.01 + F.col("value")).cast("string"), F.lit("0"), F.col("event_id").cast("string")).alias("value"))
    out = parse_ticks(lines.select(F.regexp_replace("value", ",[^,]*,([^,]*)$", ",$1").alias("value")))  # the id in the volume's place
    return rounded(out.select(F.col("volume").cast("long").alias("seq"), "ts", "bid", "ask", "mid"), "bid", "ask", "mid")


RET = f"WITH {PANEL_SQL}, r AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN 0 ELSE ln(close) - ln(lag(close) OVER w) END AS r FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx))"


@query(RET + """ SELECT symbol, idx, round(r, 6) AS r, round(lead(close) OVER w / close - 1, 6) AS f1, round(lead(close, 5) OVER w / close - 1, 6) AS f5, round(ln(lead(close, 5) OVER w / close), 6) AS lf5, round(close / lag(close) OVER w - 1, 6) AS b1
FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")
def returns(spark, sf):
    b = panel(spark, sf).select("symbol", "idx", "close")
    return rounded(b.select("symbol", "idx", W.log_return().alias("r"), W.forward_return().alias("f1"), W.forward_return(5).alias("f5"), W.forward_return(5, True).alias("lf5"), (F.col("close") / F.lag("close").over(by_symbol()) - 1).alias("b1")), "r", "f1", "f5", "lf5", "b1")


@query(f"WITH {TICKS_SQL} SELECT hour(make_timestamp(ts * 1000)) AS hour, isodow(make_timestamp(ts * 1000)) - 1 AS dow, ts // 28800000 AS funding_slot, count(*) AS n FROM ticks GROUP BY ALL")
def calendar(spark, sf):
    t = F.timestamp_millis("ts")
    return ticks(spark, sf).groupBy(F.hour(t).cast("long").alias("hour"), F.weekday(t).cast("long").alias("dow"), slot("ts", 28800000).alias("funding_slot")).agg(F.count("*").alias("n"))


def _win(name, body):
    return RET + f" SELECT symbol, idx, {body} FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), g AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(_win("", "round(CASE WHEN count(*) OVER f = 60 THEN sqrt(avg(r * r) OVER f) END, 6) AS rv, round(CASE WHEN count(*) OVER g = 20 THEN sqrt(avg(r * r) OVER g) END, 6) AS fast, round(CASE WHEN count(*) OVER f = 60 THEN avg(close) OVER f END, 6) AS mean, round(CASE WHEN count(*) OVER f = 60 THEN sum(volume) OVER f END, 6) AS total, round(sum(r * r) OVER f, 6) AS rv_sum"))
def rolling_basics(spark, sf):
    def make(b):
        b = b.withColumn("r", W.log_return())
        return b.select("symbol", "idx", W.rms(F.col("r"), 60).alias("rv"), W.rms(F.col("r"), 20).alias("fast"), W.full(F.avg, F.col("close"), 60).alias("mean"), W.full(F.sum, F.col("volume"), 60).alias("total"), F.sum(F.col("r") * F.col("r")).over(W.frame(60)).alias("rv_sum"))

    return rounded(W.over_chunks(panel(spark, sf), 61, make), "rv", "fast", "mean", "total", "rv_sum")


@query(_win("", "round(CASE WHEN count(*) OVER f = 60 THEN sum((high + low + close) / 3 * volume) OVER f / nullif(sum(volume) OVER f, 0) END, 6) AS vwap, round(CASE WHEN count(*) OVER g = 20 THEN max(high) OVER g END, 6) AS upper, round(CASE WHEN count(*) OVER g = 20 THEN min(low) OVER g END, 6) AS lower"))
def vwap_donchian(spark, sf):
    up, low = W.donchian(20)
    d = W.over_chunks(panel(spark, sf), 60, lambda b: b.select("symbol", "idx", W.vwap(60).alias("vwap"), up.alias("upper"), low.alias("lower")))
    return rounded(d, "vwap", "upper", "lower")


@query(_win("", "round(CASE WHEN count(*) OVER f = 60 THEN (close - avg(close) OVER f) / nullif(stddev_pop(close) OVER f, 0) END, 5) AS z, round(CASE WHEN count(*) OVER f = 60 THEN (avg(close * volume) OVER f - avg(close) OVER f * avg(volume) OVER f) / nullif(avg(volume * volume) OVER f - avg(volume) OVER f * avg(volume) OVER f, 0) END, 5) AS beta"))
def zscore_ols(spark, sf):
    d = W.rolling_moments(panel(spark, sf), 60, "close", ("close", "volume"), ("z", "beta"))
    return rounded(d, "z", "beta", digits=5)


QUANT = RET + """, v AS (SELECT symbol, idx, CASE WHEN count(*) OVER f = 20 THEN sqrt(avg(r * r) OVER f) END AS rv FROM r WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN count(rv) OVER g = 120 THEN quantile_cont(rv, 0.75) OVER g END AS q75, CASE WHEN count(rv) OVER g = 120 THEN quantile_cont(rv, 0.95) OVER g END AS q95 FROM v WINDOW g AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN q75 IS NULL THEN -1 WHEN rv > q95 THEN 2 WHEN rv > q75 THEN 1 ELSE 0 END AS label FROM b)"""


def labels(spark, sf):
    """The rolling-quantile detector: labels -1, 0, 1, 2 from trailing 75 % and 95 % quantiles of realised volatility."""
    from ..operators.detectors import rolling_states

    return rolling_states(panel(spark, sf).select("symbol", "idx", "ts", "close"), 20, 120, edges=("q75", "q95"))


@query(QUANT + " SELECT symbol, idx, round(q75, 6) AS q75, round(q95, 6) AS q95, label FROM l")
def quantile_detector(spark, sf):
    return rounded(labels(spark, sf).select("symbol", "idx", "q75", "q95", "label"), "q75", "q95")


@query(QUANT + ", c AS (SELECT state, count(label) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS state) LEFT JOIN l ON label = state GROUP BY state) SELECT state, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () < 0.01 AS sparse FROM c")
def occupancy(spark, sf):
    """Share of each state, also of those without a bar, and whether it is too small to rely on."""
    from ..operators.measures import zero_filled

    d = labels(spark, sf).filter("label >= 0").groupBy(F.col("label").alias("state")).agg(F.count("*").alias("n"))
    d = zero_filled(d, {"state": 4})
    d = d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # four rows
    return rounded(d.withColumn("sparse", F.col("share") < 0.01), "share")


@query(QUANT + ", t AS (SELECT label, lag(label) OVER (PARTITION BY symbol ORDER BY idx) AS prev FROM l WHERE label >= 0) SELECT prev, label AS curr, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL")
def transitions(spark, sf):
    d = labels(spark, sf).filter("label >= 0").withColumn("prev", F.lag("label").over(by_symbol())).filter("prev IS NOT NULL")
    return d.groupBy("prev", F.col("label").alias("curr")).agg(F.count("*").alias("n"))


@query(QUANT + """, c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY symbol ORDER BY idx) THEN 1 ELSE 0 END AS ch FROM l), g AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM c), q AS (SELECT symbol, run, label, count(*) AS len FROM g GROUP BY ALL)
SELECT label, count(*) AS runs, round(avg(len), 6) AS mean_len, round(median(len), 6) AS median_len, max(len) AS max_len FROM q GROUP BY label""")
def run_lengths(spark, sf):
    q = W.islands(labels(spark, sf), "label").groupBy("symbol", "run", "label").agg(F.count("*").alias("len"))
    return rounded(q.groupBy("label").agg(F.count("*").alias("runs"), F.avg("len").alias("mean_len"), F.percentile("len", F.lit(0.5)).alias("median_len"), F.max("len").alias("max_len")), "mean_len", "median_len")


@query(QUANT + " SELECT symbol, idx, round(rv, 6) AS rv, label FROM l WHERE idx >= 59 AND (idx - 59) % 60 = 0 AND label >= 0 AND rv IS NOT NULL")
def sample_non_overlapping(spark, sf):
    return rounded(rebar.non_overlapping(labels(spark, sf), 60, "rv", "label").select("symbol", "idx", "rv", "label"), "rv")


@query(QUANT + ", k AS (SELECT symbol, idx, rv, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS n FROM l WHERE rv IS NOT NULL) SELECT symbol, idx, round(rv, 6) AS rv FROM k WHERE n % 60 = 0")
def sample_compacted(spark, sf):
    return rounded(rebar.compacted(labels(spark, sf), 60, "rv").select("symbol", "idx", "rv"), "rv")


@query(f"WITH {PANEL_SQL}, d AS (SELECT symbol, (max(close) OVER w - close) / max(close) OVER w AS dd FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx)) SELECT symbol, round(max(dd), 6) AS max_drawdown FROM d GROUP BY symbol")
def max_drawdown(spark, sf):
    return rounded(W.drawdowns(panel(spark, sf), "close").groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown")), "max_drawdown")


@query(f"""WITH RECURSIVE {PANEL_SQL}, s(symbol, idx, ts, amount, bar, closed) AS (
 SELECT symbol, idx, ts, volume, 0, volume >= 500 FROM panel WHERE idx = 0
 UNION ALL SELECT p.symbol, p.idx, p.ts, CASE WHEN s.closed THEN p.volume ELSE s.amount + p.volume END, s.bar + s.closed::INT, CASE WHEN s.closed THEN p.volume ELSE s.amount + p.volume END >= 500 FROM s JOIN panel p ON p.symbol = s.symbol AND p.idx = s.idx + 1)
SELECT symbol, bar::BIGINT AS idx, ts, round(amount, 6) AS amount FROM s WHERE closed""")
def volume_bars(spark, sf):
    return rounded(rebar.volume_bars(panel(spark, sf), 500).select("symbol", "idx", "ts", "amount"), "amount")


EMA = "e AS (SELECT symbol, idx, x AS y FROM xs WHERE idx = 0 UNION ALL SELECT xs.symbol, xs.idx, CASE WHEN xs.x IS NULL THEN e.y WHEN e.y IS NULL THEN xs.x ELSE e.y + 2 / 31 * (xs.x - e.y) END FROM e JOIN xs ON xs.symbol = e.symbol AND xs.idx = e.idx + 1)"
RECURSIVE = RET.replace("WITH", "WITH RECURSIVE", 1)


@query(RECURSIVE + f", xs AS MATERIALIZED (SELECT symbol, idx, CASE WHEN count(*) OVER f = 20 THEN sqrt(avg(r * r) OVER f) END AS x FROM r WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)), {EMA} SELECT symbol, idx, round(y, 6) AS ema FROM e")
def ema_features(spark, sf):
    return rounded(W.ema(W.realized_vol(panel(spark, sf), 20).select("symbol", "idx", "rv"), "rv", 30, 200).select("symbol", "idx", "ema"), "ema")


@query(f"""WITH {HOURS} SELECT symbol, count(d) AS n, round(median(d), 6) AS median_min, round(max(d), 6) AS max_min FROM (SELECT symbol, (ts - lag(ts) OVER (ORDER BY ts)) / 60000 AS d FROM bars) GROUP BY symbol""")
def bar_durations(spark, sf):
    return rounded(rebar.durations(event_bars(spark, sf, HOUR)), "median_min", "max_min")


PLAN = (1704067200000, 1709251200000)


@query(f"""WITH {event_bars_sql(HOUR, 'event_type')}, g AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars WHERE symbol <> 'error' OR ts >= 1704499200000 GROUP BY symbol),
s AS (SELECT symbol, CASE WHEN lo > {PLAN[0]} + 60000 THEN {PLAN[0]} ELSE greatest({PLAN[0]}, hi + 60000) END AS start, lo > {PLAN[0]} + 60000 AS backfill FROM g WHERE NOT (hi >= {PLAN[1]} - 60000 AND lo <= {PLAN[0]} + 60000)),
c AS (SELECT symbol, backfill, unnest(range(start, {PLAN[1]}, 2592060000)) AS a FROM s) SELECT symbol, backfill, a AS slice_start, least(a + 2592000000, {PLAN[1]}) AS slice_end FROM c""")
def resume_plan(spark, sf):
    """What is left to load of each symbol: all if its early history is missing, the tail else, in slices of 30 days."""
    from ..sources.files import load_plan

    b = event_bars(spark, sf, HOUR, F.col("event_type")).filter("symbol <> 'error' OR ts >= 1704499200000")
    return load_plan(b, *PLAN)


@query("SELECT event_id, (('0x' || substr(sha256('43' || event_id || user_id), 1, 16))::UBIGINT)::VARCHAR AS seed FROM events")
def seed_combiner(spark, sf):
    from ..operators.resample import seed_of

    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", seed_of(F.lit(43), "event_id", "user_id").cast("string").alias("seed"))


@query(f"WITH {PANEL_SQL} SELECT symbol, idx, round(-0.5 * ln(1 - least(abs(close / 1000 - 1) / (2 * (1 - 1.0 / 5)), 1 - 1e-12) ** 2), 6) AS nats, round(2 * 1e4 * (abs(volume / 1e5) + 4e-4), 6) AS round_trip_bps, round(0.5 * (volume / 100) ** -0.5, 6) AS e_value, round(2 / pi() * asin(sqrt(1 / (1 + volume))), 6) AS survival FROM panel")
def scalar_formulas(spark, sf):
    from ..operators.measures import e_value

    rho = F.least(F.abs(F.col("close") / 1000 - 1) / (2 * (1 - 1 / 5)), F.lit(1 - 1e-12))
    b = panel(spark, sf).select("symbol", "idx", (-0.5 * F.ln(1 - rho * rho)).alias("nats"), (2e4 * (F.abs(F.col("volume") / 1e5) + 4e-4)).alias("round_trip_bps"), e_value(F.col("volume") / 100).alias("e_value"), (2 / F.pi() * F.asin(F.sqrt(1 / (1 + F.col("volume"))))).alias("survival"))
    return rounded(b, "nats", "round_trip_bps", "e_value", "survival")


@query(RET + ", p AS (SELECT symbol, sign(r) AS a, sign(lead(r) OVER (PARTITION BY symbol ORDER BY idx)) AS b FROM r) SELECT a::BIGINT AS a, b::BIGINT AS b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL")
def sign_pairs(spark, sf):
    b = panel(spark, sf).withColumn("r", W.log_return()).withColumn("f", F.lead("r").over(by_symbol())).filter("f IS NOT NULL")
    return b.groupBy(F.signum("r").cast("long").alias("a"), F.signum("f").cast("long").alias("b")).agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL_SQL}, sg AS (SELECT symbol, idx // 60 AS seg, idx % 60 AS k, close FROM panel UNION ALL SELECT symbol, idx // 60 - 1, 60, close FROM panel WHERE idx % 60 = 0 AND idx > 0),
sr AS (SELECT symbol, seg, k, sign(ln(close / first_value(close) OVER (PARTITION BY symbol, seg ORDER BY k))) AS s FROM sg), sf AS (SELECT *, max(CASE WHEN k = 1 THEN s END) OVER (PARTITION BY symbol, seg) AS f FROM sr)
SELECT symbol, seg, coalesce(min(CASE WHEN s <> f OR s = 0 THEN k END), 61) AS passage FROM sf WHERE k > 0 GROUP BY ALL HAVING count(*) = 60""")
def first_passage(spark, sf):
    from ..operators.studies import first_passages

    return first_passages(panel(spark, sf), 60)
