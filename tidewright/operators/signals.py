"""Signals by state of volatility: mean reversion about the rolling price in one, channel breakout in another, flat else.

What a bar is decided from (state, deviation, z, channel) are columns; the walk along a series keeps the position, its
entry, and, in the managed form, a proxy of equity with its locks. A series is one task, series run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detectors, windows as W
from .clean import in_session

#: Size of a position by state.
SIZES = {0: 1.11, 1: 1.05, 2: 0.71}
#: Which states the modules trade in.
MAPS = {"raw": (0, 1), "shipped": (2, 0), "blueprint": (1, 2)}


@dataclass(frozen=True)
class Rules:
    reversion: int = 0
    breakout: int = 1
    warm_reversion: int = 1440
    warm_breakout: int = 100
    entry_z: float = 2.0
    exit_deviation: float = 0.002
    stop: float = 0.015
    profit: float = 0.03


@dataclass(frozen=True)
class Limits:
    drawdown: float = 0.10
    slack: float = 0.05
    soft: float = 0.08
    cooldown: int = 500
    streak: int = 5
    pause: int = 100


def features(bars: DataFrame, fast: int = 20, slow: int = 100, smooth: int | None = None, vwap: int = 1440, channel: int = 20, low: float = 1.2, high: float = 2.5) -> DataFrame:
    """bars with label, deviation, z, upper and lower (of the bar before) and allowed. smooth: the state comes from the
    smoothed ratio."""
    b = detectors.volatility_ratio(bars, fast, slow)
    value = "ratio"
    if smooth:
        b, value = W.ema(b, "ratio", smooth), "ema"
    b = b.withColumns({"label": detectors.by_threshold(F.col(value), low, high), "__w": W.vwap(vwap)})
    b = b.withColumn("deviation", F.when(F.col("__w") > 0, F.col("close") / F.col("__w") - 1))
    sd = W.rms(F.coalesce("deviation", F.lit(0.0)), vwap)
    up, down = W.donchian(channel)
    b = b.withColumns({"z": F.col("deviation") / F.when(sd.isNotNull(), F.greatest(sd, F.lit(1e-12))), "__u": up, "__d": down})
    prev = lambda c: F.lag(c).over(W.by_symbol())
    return b.withColumns({"upper": prev("__u"), "lower": prev("__d"), "allowed": in_session()}).drop("__w", "__u", "__d", "ema")


@dataclass
class Walk:
    """A position along the bars of a series."""

    rules: Rules
    side: float = 0.0
    entry: float = 0.0

    def wanted(self, i: int, bar: dict, allowed: bool = True) -> float:
        """The side to be on after this bar."""
        if bar["label"] == self.rules.reversion:
            return self._reversion(i, bar, allowed)
        if bar["label"] == self.rules.breakout:
            return self._breakout(i, bar, allowed)
        return 0.0

    def _reversion(self, i: int, bar: dict, allowed: bool) -> float:
        r, z, dev = self.rules, bar["z"], bar["deviation"]
        if i < r.warm_reversion or z != z or dev != dev:
            return 0.0
        fresh = (float(z < -r.entry_z) - float(z > r.entry_z)) if allowed else 0.0
        if not self.side:
            return fresh
        gain = self.side * (bar["close"] / self.entry - 1)
        done = gain < -r.stop or gain > r.profit or self.side * dev > -r.exit_deviation
        if not done:
            return self.side
        return fresh if fresh == -self.side else 0.0

    def _breakout(self, i: int, bar: dict, allowed: bool) -> float:
        if i < self.rules.warm_breakout or bar["upper"] != bar["upper"] or bar["lower"] != bar["lower"]:
            return 0.0
        push = float(bar["close"] > bar["upper"]) - float(bar["close"] < bar["lower"])
        if not self.side:
            return push if allowed else 0.0
        return (push if allowed else 0.0) if push == -self.side else self.side

    def take(self, side: float, price: float) -> float | None:
        """Goes to side; the trade's return if one ends flat."""
        gain = self.side * (price / self.entry - 1) if self.side and not side and self.entry > 0 else None
        if side != self.side:
            self.entry = price if side else 0.0
        self.side = side
        return gain


@dataclass
class Lock:
    """Bars entries while equity is too far under its peak: shut for cooldown bars from the one on which the fall reaches the
    limit, then open, with equity as the new peak."""

    cooldown: int = 500
    peak: float = 1.0
    bar: int = -1
    opens: int | None = None  # the bar on which a shut lock opens

    def fall(self, equity: float) -> float:
        return 1 - equity / max(self.peak, 1e-12)

    def step(self, equity: float, limit: float) -> str:
        """Takes the next bar in; "shut", "opened" (on this bar) or "open"."""
        self.bar, self.peak = self.bar + 1, max(self.peak, equity)
        if self.opens is None:
            if self.fall(equity) < limit:
                return "open"
            self.opens = self.bar + self.cooldown - 1
        if self.bar < self.opens:
            return "shut"
        self.opens, self.peak = None, equity
        return "opened"


@dataclass
class Book:
    """A proxy of equity, marked bar by bar, with its lock and the pause after losses."""

    limits: Limits
    equity: float = 1.0
    losses: int = 0
    pause: int = 0
    held: list[float] = field(default_factory=lambda: [0.0, 0.0])  # signals of the last two bars

    def __post_init__(self):
        self.lock = Lock(self.limits.cooldown)

    def mark(self, prev_close: float, open_: float, close: float) -> None:
        """Adds what the legs of the bar earn: one from close to close, or two that part at the open where the signal changed."""
        before, now = self.held
        legs = [(now, prev_close, close)] if before == now else [(before, prev_close, open_), (now, open_, close)]
        self.equity *= 1 + sum(side * (to / max(since, 1e-12) - 1) for side, since, to in legs)

    def check(self, label: int) -> tuple[bool, float]:
        """Whether entries are barred, and the size that the drawdown leaves."""
        limit = self.limits.drawdown + (0.0 if label == 2 else self.limits.slack)
        state = self.lock.step(self.equity, limit)
        self.pause -= self.pause > 0
        return state == "shut" or self.pause > 0, self._share(self.lock.fall(self.equity), limit)

    def _share(self, loss: float, limit: float) -> float:
        if loss <= self.limits.soft:
            return 1.0
        return 0.0 if loss >= limit else exp(-10 * (loss - self.limits.soft))

    def settle(self, gain: float | None, forced: bool, signal: float) -> None:
        if gain is not None:
            if not forced:
                self.losses = self.losses + 1 if gain < 0 else 0
            if self.losses >= self.limits.streak:
                self.losses, self.pause = 0, self.limits.pause
        self.held = [self.held[1], signal]


COLUMNS = ["symbol", "idx", "ts", "open", "high", "low", "close", "volume", "label", "deviation", "z", "upper", "lower", "allowed"]


def _series(t, bounds):
    """The bars of each series of an Arrow table, as dicts."""
    names = ("open", "close", "label", "deviation", "z", "upper", "lower", "allowed")
    columns = [t[c].to_numpy().tolist() for c in names]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield (dict(zip(names, row)) for row in zip(*(c[a:z] for c in columns)))


def raw_signals(featured: DataFrame, rules: Rules | None = None) -> DataFrame:
    """symbol, idx, ts, open, close and signal: -1, 0 or 1 by the modules alone."""
    rules = rules or Rules()

    def run(t, bounds):
        out = []
        for bars in _series(t, bounds):
            walk = Walk(rules)
            for i, bar in enumerate(bars):
                side = walk.wanted(i, bar)
                walk.take(side, bar["close"])
                out.append(float(side))
        return {c: t[c] for c in ("symbol", "idx", "ts", "open", "close")} | {"signal": out}

    return W.over_groups(featured.select(*COLUMNS), ["symbol"], run, _schema(featured))


def managed_signals(featured: DataFrame, mapping: str = "shipped", rules: Rules | None = None, limits: Limits | None = None) -> DataFrame:
    """symbol, idx, ts, open, close, signal (sized by state and drawdown) and limit_order: modules under the session filter,
    the drawdown lock and the pause after losses in a row. A lock forces the position flat."""
    if mapping not in ("shipped", "blueprint"):
        raise ValueError(f"mapping is shipped or blueprint, not {mapping!r}")
    reversion, breakout = MAPS[mapping]
    rules, limits = replace(rules or Rules(), reversion=reversion, breakout=breakout), limits or Limits()

    def run(t, bounds):
        out = []
        for bars in _series(t, bounds):
            walk, book, last = Walk(rules), Book(limits), None
            for i, bar in enumerate(bars):
                if last is not None:
                    book.mark(last, bar["open"], bar["close"])
                barred, share = book.check(bar["label"])
                tradable = not barred and bar["label"] not in (-1, 1)
                side = walk.wanted(i, bar, bar["allowed"]) if tradable else 0.0
                signal = side * SIZES.get(bar["label"], 1.0) * share
                book.settle(walk.take(side, bar["close"]), barred, signal)
                out.append(float(signal))
                last = bar["close"]
        return {c: t[c] for c in ("symbol", "idx", "ts", "open", "close")} | {"signal": out, "limit_order": t["label"].to_numpy() == 0}

    return W.over_groups(featured.select(*COLUMNS), ["symbol"], run, _schema(featured).add("limit_order", T.BooleanType()))


def _schema(df: DataFrame) -> T.StructType:
    names = ("symbol", "idx", "ts", "open", "close")
    return T.StructType([*(df.schema[n] for n in names), T.StructField("signal", T.DoubleType())])
