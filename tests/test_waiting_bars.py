"""Bars that wait for the watermark are held by slots of time: no call has all of a symbol's bars at once."""

import numpy as np
import pandas as pd

from tidewright.streaming import keyed

MINUTE = 60_000


class State:
    def __init__(self):
        self.v = {}

    def exists(self):
        return bool(self.v)

    def get(self):
        return self.v[0]

    def update(self, value):
        self.v[0] = value

    def clear(self):
        self.v.clear()

    def put(self, rows):
        self.v[0] = rows

    def updateValue(self, k, value):
        self.v[k] = value

    def getValue(self, k):
        return self.v[k]

    def removeKey(self, k):
        del self.v[k]

    def keys(self):
        return iter(list(self.v))


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return State()

    getValueState = getListState = getMapState

    def registerTimer(self, ts):
        self.timers.append(ts)


class Now:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_no_frame_holds_more_than_a_slot():
    n, handle = 5_000, Handle()
    order = np.random.default_rng(1).permutation(n)
    ts = (order + 1) * MINUTE
    bars = pd.DataFrame({"ts": ts, **{c: order * 1.0 for c in ("open", "high", "low", "close")}, "volume": 1.0})
    again = bars.assign(close=-1.0)  # of bars with one time the first stays
    p = keyed._GapTimers(MINUTE, 5 * MINUTE, None, *[60 * MINUTE][: keyed._GapTimers.__init__.__code__.co_argcount - 4])
    p.init(handle)
    batches = [b.iloc[k : k + 500] for b in (bars, again) for k in range(0, n, 500)]
    assert not sum(len(f) for f in p.handleInputRows(("S",), iter(batches), Now(0))) and min(handle.timers) == MINUTE
    half = (n // 2 + 7) * MINUTE
    first = [f for f in p.handleExpiredTimer(("S",), Now(half), None) if len(f)]
    rest = [f for f in p.handleExpiredTimer(("S",), Now((n + 1) * MINUTE), None) if len(f)]
    assert max(len(f) for f in first + rest) <= 60
    assert sum(len(f) for f in first) == n // 2 + 7
    out = pd.concat(first + rest)
    assert out["ts"].tolist() == [(k + 1) * MINUTE for k in range(n)] and out["close"].tolist() == [float(k) for k in range(n)]
