"""Greedy chains along a series, side by side over chunks: each next event is the first row at least a step beyond the last.

A chunk sorts out, for every row that its first event may be, where the chain that starts there leaves the chunk and how many
events it has, by jumps of doubling length over searched prefix sums. That table is a step function of the one number that
the past decides (how far into the chunk the first event must lie), mostly of a few steps, as chains soon fall together. The
tables of a series, one row a chunk, are then composed in order, and each chunk marks its events. No task holds more
than a chunk of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import CHUNK, over_groups

#: A sum counts as having reached the step if only rounding is missing.
ROUNDING = 1e-12


def chain_table(place, step: float):
    """Steps (upto, last, n) of a chunk whose rows lie at the rising numbers place: a first event that must be at `goal` or
    beyond, goal <= step, belongs to the first entry with upto >= goal; the chain's last event lies at last and is its n-th."""
    import numpy as np

    m = len(place)
    after = np.searchsorted(place, place + step * (1 - ROUNDING))  # the row of the next event, m if there is none
    jump, last, n = np.append(after, m), np.append(np.arange(m), m), np.append(np.ones(m, np.int64), 0)
    while (jump < m).any():
        inside = jump < m
        n[inside] += n[jump[inside]]
        last[inside] = last[jump[inside]]
        jump[inside] = jump[jump[inside]]
    heads = min(m, int(np.searchsorted(place, step * (1 - ROUNDING))) + 1)
    end, n = place[last[:heads]], n[:heads]
    keep = np.ones(heads, bool)
    keep[:-1] = (end[1:] != end[:-1]) | (n[1:] != n[:-1])
    return place[:heads][keep], end[keep], n[keep]


def chain(place, goal: float, step: float) -> list[int]:
    """Rows of a chunk's events."""
    import numpy as np

    out, at, m = [], int(np.searchsorted(place, goal)), len(place)
    after = np.searchsorted(place, place + step * (1 - ROUNDING)).tolist()
    while at < m:
        out.append(at)
        at = after[at]
    return out


def greedy_events(rows: DataFrame, step: float, amount: str | None = None, size: int | None = None) -> DataFrame:
    """rows (symbol, idx and others) with event (whether a row is one) and before (events of the symbol before the row). A row
    lies at the sum of amount up to it, the first event at step or beyond; without amount, at idx, and the first row is one."""
    size = size or CHUNK
    b = rows.withColumn("__k", F.floor(F.col("idx") / size))
    value = F.col(amount).cast("double") if amount else (F.col("idx") - F.col("__k") * size).cast("double")
    kind = rows.schema["symbol"].dataType.simpleString()

    def places(v):
        return v.cumsum() if amount else v

    def table(t, bounds):
        import numpy as np

        v, rows = t["__v"].to_numpy(), []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            place = places(v[a:z])
            rows.append((float(place[-1]) if amount else float(size), *chain_table(place, step)))
        first = t.take(np.asarray(bounds[:-1]))
        return {"symbol": first["symbol"], "__k": first["__k"]} | {n: [r[j] for r in rows] for j, n in enumerate(("span", "upto", "end", "n"))}

    def compose(batches):
        """Chunks come in order of symbol and number; all that is carried is a goal and a count."""
        import numpy as np
        import pandas as pd

        symbol, k, goal, count = None, 0, 0.0, 0
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                number = int(r.chunk)
                if r.symbol != symbol:
                    symbol, k, goal, count = r.symbol, number, step * (1 - ROUNDING) if amount else 0.0, 0
                if not amount:  # chunks without rows move on, too
                    goal -= (number - k) * size
                out.append((symbol, number, goal, count))
                at = int(np.searchsorted(r.upto, goal))
                if at < len(r.upto):
                    goal, count = r.end[at] + step * (1 - ROUNDING), count + int(r.n[at])
                if amount:
                    goal -= r.span
                k = number
            yield pd.DataFrame(out, columns=["symbol", "__k", "__goal", "__count"])

    def mark(t, bounds):
        import numpy as np

        v, goal, count = t["__v"].to_numpy(), t["__goal"].to_numpy(), t["__count"].to_numpy()
        event, before = np.zeros(len(v), bool), np.empty(len(v), np.int64)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            event[a:z][chain(places(v[a:z]), float(goal[a]), step)] = True
            before[a:z] = count[a] + np.cumsum(event[a:z]) - event[a:z]
        return {c: t[c] for c in names} | {"event": event, "before": before}

    names = rows.columns
    b = b.withColumn("__v", value)
    tables = over_groups(b.select("symbol", "idx", "__k", "__v"), ["symbol", "__k"], table, f"symbol {kind}, __k long, span double, upto array<double>, end array<double>, n array<long>")
    ordered = tables.withColumnRenamed("__k", "chunk").repartition("symbol").sortWithinPartitions("symbol", "chunk")
    entry = ordered.mapInPandas(compose, f"symbol {kind}, __k long, __goal double, __count long")
    schema = T.StructType([*rows.schema.fields, T.StructField("event", T.BooleanType()), T.StructField("before", T.LongType())])
    return over_groups(b.join(entry, ["symbol", "__k"]), ["symbol", "__k"], mark, schema)
