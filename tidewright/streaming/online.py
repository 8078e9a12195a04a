"""The causal parts as streams: bars by time, count and volume with watermark or keyed state, gap fill, and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.strategy import Admission

BAR = "symbol {kind}, idx long, ts long, open double, high double, low double, close double, volume double"


def _ohlc(groups) -> DataFrame:
    key = F.struct("time", "seq")
    return groups.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"))


def once(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades (symbol, time timestamp, seq, price, volume) under a watermark, repeated ones once, the first that came."""
    return trades.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def time_bars(trades: DataFrame, freq: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of trades; trades later than the watermark are left out (late_trades() has them)."""
    b = _ohlc(once(trades, late).groupBy("symbol", F.window("time", freq)))
    return b.select("symbol", F.unix_millis("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def replay_windows(trades: DataFrame, length: str = "60 days", every: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """Sliding windows of a stream: number of trades, mean price and range."""
    g = once(trades, late).groupBy("symbol", F.window("time", length, every))
    return g.agg(F.count("*").alias("n"), F.avg("price").alias("mean"), (F.max("price") - F.min("price")).alias("range")).select("symbol", F.unix_millis("window.start").alias("start"), F.unix_millis("window.end").alias("end"), "n", "mean", "range")


def split_late(spark_batch: DataFrame, newest_ms: int, late_ms: int) -> tuple[DataFrame, DataFrame]:
    """For foreachBatch: the trades of a batch in time, and the side output of those more than late_ms behind the newest
    trade of earlier batches."""
    behind = F.unix_millis("time") < newest_ms - late_ms
    return spark_batch.filter(~behind), spark_batch.filter(behind)


def _stateful(stream: DataFrame, out: str, state: str, step) -> DataFrame:
    """step(rows in order, state or None) gives output rows and the next state, by symbol."""

    def run(key, batches, kept):
        import pandas as pd

        rows = pd.concat(list(batches))
        made, after = step(key[0], rows, kept.get if kept.exists else None)
        kept.update(after)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    kind = stream.schema["symbol"].dataType.simpleString()
    return stream.groupBy("symbol").applyInPandasWithState(run, out.format(kind=kind), state, "append", "NoTimeout")


def count_windows(values: DataFrame, w: int) -> DataFrame:
    """Windows of w rows of a stream (symbol, idx long, x double), without overlap: symbol, win, mean, sd. The state is the
    open window's count and sums."""

    def step(symbol, rows, state):
        win, n, total, squares = state or (0, 0, 0.0, 0.0)
        out = []
        for x in rows.sort_values("idx")["x"]:
            n, total, squares = n + 1, total + x, squares + x * x
            if n == w:
                mean = total / w
                out.append((symbol, win, mean, max(0.0, squares / w - mean * mean) ** 0.5))
                win, n, total, squares = win + 1, 0, 0.0, 0.0
        return out, (win, n, total, squares)

    return _stateful(values, "symbol {kind}, win long, mean double, sd double", "win long, n long, total double, squares double", step)


def clock_bars(bars: DataFrame, threshold: float, contribution: str = "volume") -> DataFrame:
    """Bars by another clock from a stream of bars (symbol, idx, ts, open, high, low, close, volume and contribution): one ends
    when the contributions reach the threshold. The state is the open bar."""
    fields = ("idx", "amount", "open", "high", "low", "volume")

    def step(symbol, rows, state):
        s = dict(zip(fields, state)) if state else dict(zip(fields, (0, 0.0, 0.0, float("-inf"), float("inf"), 0.0)))
        out = []
        for r in rows.sort_values("idx").to_dict("records"):
            if not r[contribution] > 0:
                continue
            s["open"] = s["open"] if s["amount"] else r["open"]
            s |= {"amount": s["amount"] + r[contribution], "high": max(s["high"], r["high"]), "low": min(s["low"], r["low"]), "volume": s["volume"] + r["volume"]}
            if s["amount"] >= threshold:
                out.append((symbol, s["idx"], r["ts"], s["open"], s["high"], s["low"], r["close"], s["volume"]))
                s = dict(zip(fields, (s["idx"] + 1, 0.0, 0.0, float("-inf"), float("inf"), 0.0)))
        return out, tuple(s[f] for f in fields)

    return _stateful(bars, BAR, "idx long, amount double, open double, high double, low double, volume double", step)


def fill_gaps(bars: DataFrame, step_ms: int = 60_000, most_ms: int = 300_000) -> DataFrame:
    """Bars of a stream with flat bars where minutes are missing: they come when the next bar does, and are disabled if the
    gap is longer than most_ms. Of bars with one time the first stays; one that is older than the last fails."""

    def step(symbol, rows, state):
        last, close = state or (None, None)
        out = []
        for r in rows.sort_values("idx").to_dict("records"):
            ts = int(r["ts"])
            if last is not None:
                if ts == last:
                    continue
                if ts < last:
                    raise ValueError(f"bar {ts} of {symbol} is older than {last}")
                for k in range(1, (ts - last) // step_ms):
                    out.append((symbol, last + k * step_ms, close, close, close, close, 0.0, ts - last > most_ms))
            out.append((symbol, ts, r["open"], r["high"], r["low"], r["close"], r["volume"], False))
            last, close = ts, r["close"]
        return out, (last, close)

    return _stateful(bars, "symbol {kind}, ts long, open double, high double, low double, close double, volume double, trading_disabled boolean", "last long, close double", step)


def admission(gates: DataFrame, **rules) -> DataFrame:
    """Admission states of a stream (symbol, idx long, ok boolean); state is the counters of strategy.Admission."""
    fields = ("seen", "streak", "missed", "state")

    def step(symbol, rows, state):
        a = Admission(**rules)
        for name, value in zip(fields, state or ()):
            setattr(a, name, value)
        rows = rows.sort_values("idx")
        out = [(symbol, i, a.step(bool(x))) for i, x in zip(rows["idx"], rows["ok"])]
        return out, tuple(getattr(a, f) for f in fields)

    return _stateful(gates, "symbol {kind}, idx long, state string", "seen long, streak long, missed long, state string", step)
