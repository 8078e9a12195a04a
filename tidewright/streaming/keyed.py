"""Keyed state with event-time timers and ring buffers: gap filling that doesn't wait for the next bar, and rolling features.

Both need a state store that keeps several states a key: session() sets the RocksDB provider.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PRICES = ("open", "high", "low", "close", "volume")
FILLED = "symbol {kind}, ts long, open double, high double, low double, close double, volume double, trading_disabled boolean, late boolean"


class _GapTimers(StatefulProcessor):
    """Bars wait until the watermark has passed them, so that they are taken in order of time; a silent symbol's flat bars
    come from a timer. States: held (bars that wait, packed, by slot of time and number of arrival), parts (the next such number),
    last (time and close of the last bar, flat bars made) and timer (the earliest one set; one that is set anew leaves the later
    ones, which then find nothing to do). A worker holds a batch of input, or a slot's bars, at a time."""

    def __init__(self, step: int, most: int, forget: int | None, slot: int):
        self.step, self.most, self.forget, self.slot = step, most, forget, slot

    def init(self, handle):
        self.handle = handle
        self.held = handle.getMapState("held", "slot long, part long", "bars binary")
        self.parts = handle.getValueState("parts", "n long")
        self.last = handle.getValueState("last", "ts long, close double, made long")
        self.timer = handle.getValueState("timer", "ts long")

    def _set(self, ts: int) -> None:
        if not self.timer.exists() or ts < self.timer.get()[0]:
            self.handle.registerTimer(ts)
            self.timer.update((ts,))

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        now, least = timerValues.getCurrentWatermarkInMs(), None
        n = self.parts.get()[0] if self.parts.exists() else 0
        for batch in rows:
            ts = batch["ts"].to_numpy(np.int64)
            late = ts <= now
            if late.any():
                yield self._frame(pd, [(key[0], *r, False, True) for r in zip(*(batch[c][late].tolist() for c in ("ts", *PRICES)))])
            ts = ts[~late]
            if not len(ts):
                continue
            bars = np.stack([ts.view(float), *(batch[c].to_numpy(float)[~late] for c in PRICES)], 1)
            slot = ts // self.slot
            order = np.argsort(slot, kind="stable")
            bars, slot = bars[order], slot[order]
            cuts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)]):
                self.held.updateValue((int(slot[a]), n), (bars[a:z].tobytes(),))
            n, least = n + 1, int(ts.min()) if least is None else min(least, int(ts.min()))
        if least is not None:
            self.parts.update((n,))
            self._set(least)
        yield self._frame(pd, [])

    def _waiting(self, keys):
        """Times in order and prices of a slot's bars, the first to come of each time."""
        import numpy as np

        bars = np.concatenate([np.frombuffer(bytes(self.held.getValue(k)[0]), float).reshape(-1, 1 + len(PRICES)) for k in keys])
        ts, first = np.unique(np.ascontiguousarray(bars[:, 0]).view(np.int64), return_index=True)
        return ts, bars[first, 1:]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        last = tuple(self.last.get()) if self.last.exists() else None
        slots: dict[int, list] = {}
        for k in sorted(tuple(k) for k in self.held.keys()):
            slots.setdefault(k[0], []).append(k)
        later = None
        for slot, keys in slots.items():
            ts, prices = self._waiting(keys)
            due = int(np.searchsorted(ts, now, "right"))
            if due:
                yield self._filled(key[0], last, ts[:due], prices[:due])
                last = (int(ts[due - 1]), float(prices[due - 1, 3]), 0)
                for k in keys:
                    self.held.removeKey(k)
            if due < len(ts):
                later = int(ts[due])
                if due:
                    self.held.updateValue(keys[0], (np.concatenate([ts[due:].view(float)[:, None], prices[due:]], 1).tobytes(),))
                break
        self.timer.clear()
        if later is not None:
            self._set(later)
        out = []
        if last is not None:
            if now > last[0] + self.most:  # whatever comes next comes after a long gap
                upto = now if self.forget is None else min(now, last[0] + self.forget)
                out = self._flat(key[0], last, (upto - last[0]) // self.step - 1, True)
                last = (last[0], last[1], last[2] + len(out))
            if self.forget is not None and now > last[0] + self.forget:
                self.last.clear()
            else:
                self.last.update(last)
                self._set(max(last[0] + self.most + 1, last[0] + (last[2] + 2) * self.step, now + 1))
        yield self._frame(pd, out)

    def _filled(self, symbol, last, ts, prices):
        """A slot's bars, each after the flat bars between it and the one before; of those after last, the ones made before are
        left out."""
        import numpy as np
        import pandas as pd

        known = last is not None
        since = np.append(last[0] if known else ts[0], ts[:-1])
        close, made = np.append(last[1] if known else 0.0, prices[:-1, 3]), np.append(last[2] if known else 0, np.zeros(len(ts) - 1, int))
        flat = np.maximum((ts - since) // self.step - 1 - made, 0)
        at = np.repeat(np.arange(len(ts)), flat + 1)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(flat + 1) - flat - 1, flat + 1)
        own = nth == flat[at]
        columns = [np.where(own, prices[at, k], close[at]) for k in range(4)] + [np.where(own, prices[at, 4], 0.0)]
        time = np.where(own, ts[at], since[at] + (made[at] + nth + 1) * self.step)
        return pd.DataFrame({"symbol": symbol, "ts": time, **dict(zip(PRICES, columns)), "trading_disabled": ~own & (ts - since > self.most)[at], "late": False})

    @staticmethod
    def _flat_row(symbol, ts, close, disabled):
        return (symbol, ts, close, close, close, close, 0.0, disabled, False)

    def _flat(self, symbol, last, n: int, disabled: bool) -> list[tuple]:
        """Flat bars after a bar, up to the n-th; those made before are left out."""
        return [self._flat_row(symbol, last[0] + k * self.step, last[1], disabled) for k in range(last[2] + 1, n + 1)]

    @staticmethod
    def _frame(pd, rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FILLED.split(", ")])

    def close(self):
        pass


def fill_gaps_timed(bars: DataFrame, step_ms: int = 60_000, most_ms: int = 300_000, late: str = "10 minutes", forget_ms: int | None = None, slot_ms: int = 3_600_000) -> DataFrame:
    """Bars of a stream (symbol, time timestamp, open, high, low, close, volume) in order of time, with flat bars where they
    are missing, as clean.gap_fill makes them; of bars with one time the first stays. A gap's flat bars come with the next bar
    or, once the watermark shows that the gap is longer than most_ms, by themselves, step by step. Bars that the watermark
    has passed come out as they are with late set. A symbol that is silent for forget_ms is forgotten. Bars that wait lie
    in slots of slot_ms, of which a worker holds one at a time."""
    b = bars.withWatermark("time", late).select("symbol", F.unix_millis("time").alias("ts"), "open", "high", "low", "close", "volume")
    kind = b.schema["symbol"].dataType.simpleString()
    return b.groupBy("symbol").transformWithStateInPandas(_GapTimers(step_ms, most_ms, forget_ms, slot_ms), FILLED.format(kind=kind), "append", "eventTime")


class Extreme:
    """The largest of the last w values, by a queue of falling candidates."""

    def __init__(self, w: int):
        self.w, self.queue = w, deque()

    def push(self, n: int, x: float) -> float:
        while self.queue and self.queue[-1][1] <= x:
            self.queue.pop()
        self.queue.append((n, x))
        if self.queue[0][0] <= n - self.w:
            self.queue.popleft()
        return self.queue[0][1]


class Ordered:
    """Linear quantiles of the last w values, null ones left out, from a sorted list."""

    def __init__(self, w: int):
        self.w, self.recent, self.sorted = w, deque(), []

    def push(self, x: float | None) -> None:
        self.recent.append(x)
        if x is not None:
            insort(self.sorted, x)
        if len(self.recent) > self.w and (old := self.recent.popleft()) is not None:
            del self.sorted[bisect_left(self.sorted, old)]

    def quantile(self, p: float) -> float | None:
        if len(self.sorted) < self.w:
            return None
        at = p * (self.w - 1)
        k = int(at)
        x, y = self.sorted[k], self.sorted[min(k + 1, self.w - 1)]
        return x + (at - k) * (y - x)


class Ring:
    """Rolling features of one symbol, bar by bar; rows holds what a restart needs."""

    def __init__(self, vol: int, vwap: int, channel: int, quantile: int, ps: tuple[float, ...]):
        self.vol, self.vwap, self.channel, self.ps = vol, vwap, channel, ps
        self.rows: deque = deque(maxlen=max(vol, vwap, channel, quantile) + 1)
        self.high, self.low, self.order = Extreme(channel), Extreme(channel), Ordered(quantile)
        self.n, self.squares, self.money, self.traded = 0, 0.0, 0.0, 0.0

    def restore(self, row: tuple) -> None:
        """Takes a kept row (idx, r, rv, high, low, close, volume) in again."""
        _, r, rv, high, low, close, volume = row
        self.rows.append(row)
        self.n += 1
        self.squares += r * r - self._gone(self.vol, lambda x: x[1] * x[1])
        price = lambda x: (x[3] + x[4] + x[5]) / 3 * x[6]
        self.money += price(row) - self._gone(self.vwap, price)
        self.traded += volume - self._gone(self.vwap, lambda x: x[6])
        self.top, self.bottom = self.high.push(self.n, high), -self.low.push(self.n, -low)
        self.order.push(rv)

    def _gone(self, w: int, value) -> float:
        """value of the row that has just left a window of w rows."""
        return value(self.rows[-w - 1]) if len(self.rows) > w else 0.0

    def push(self, idx: int, high: float, low: float, close: float, volume: float) -> tuple:
        from math import log, sqrt

        r = log(close) - log(self.rows[-1][5]) if self.rows else 0.0
        n = self.n + 1
        squares = self.squares + r * r - (self.rows[-self.vol][1] ** 2 if len(self.rows) >= self.vol else 0.0)
        rv = sqrt(max(0.0, squares) / self.vol) if n >= self.vol else None
        self.restore((idx, r, rv, high, low, close, volume))
        vwap = self.money / self.traded if n >= self.vwap and self.traded > 0 else None
        full = n >= self.channel
        return (rv, vwap, self.top if full else None, self.bottom if full else None, *[self.order.quantile(p) for p in self.ps])


class _Rolling(StatefulProcessor):
    """State: the last rows of the symbol, as many as the longest window needs."""

    def __init__(self, settings: tuple, columns: list[str]):
        self.settings, self.columns = settings, columns

    def init(self, handle):
        self.kept = handle.getListState("rows", "idx long, r double, rv double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        ring = Ring(*self.settings)
        for row in self.kept.get() if self.kept.exists() else ():
            ring.restore(tuple(row))
        out = []
        for r in pd.concat(list(rows)).sort_values("idx").itertuples(index=False):
            if ring.rows and r.idx <= ring.rows[-1][0]:
                raise ValueError(f"bar {r.idx} of {key[0]} isn't newer than {ring.rows[-1][0]}")
            out.append((key[0], int(r.idx), *ring.push(int(r.idx), float(r.high), float(r.low), float(r.close), float(r.volume))))
        self.kept.put(list(ring.rows))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self):
        pass


def rolling_features(bars: DataFrame, vol: int = 60, vwap: int = 60, channel: int = 20, quantile: int = 120, ps: dict[str, float] | None = None) -> DataFrame:
    """symbol, idx, rv (realised volatility over vol bars), vwap, upper and lower (channel), and quantiles ps of rv over
    `quantile` bars, of a stream of bars (symbol, idx, high, low, close, volume) that come in order; null until a window is full."""
    ps = {"q75": 0.75, "q95": 0.95} if ps is None else ps
    columns = ["symbol", "idx", "rv", "vwap", "upper", "lower", *ps]
    kind = bars.schema["symbol"].dataType.simpleString()
    processor = _Rolling((vol, vwap, channel, quantile, tuple(ps.values())), columns)
    schema = f"symbol {kind}, idx long, " + ", ".join(f"{c} double" for c in columns[2:])
    return bars.select("symbol", "idx", "high", "low", "close", "volume").groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "none")
