"""Rolling features as columns over windows by symbol in bar order. 'Full' frames are null until they hold W rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numerics import recurrence
from ..sources.bars import by_symbol
from ..sources.shared import materialize


def frame(w: int):
    return by_symbol().rowsBetween(-(w - 1), 0)


def full(value: Callable, x: Column, w: int) -> Column:
    """value(x) over the last w rows, if all w are there."""
    return F.when(F.count(x).over(frame(w)) == w, value(x).over(frame(w)))


def rms(x: Column, w: int) -> Column:
    """Root mean square over w rows, without taking the mean off."""
    return F.sqrt(full(F.avg, x * x, w))


def log_return(c: Column | str = "close", zero_first: bool = True) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    r = F.ln(c) - F.ln(F.lag(c).over(by_symbol()))
    return F.when(F.lag(c).over(by_symbol()).isNull(), F.lit(0.0) if zero_first else F.lit(None).cast("double")).otherwise(r)


def forward_return(h: int = 1, log: bool = False) -> Column:
    r = F.lead("close", h).over(by_symbol()) / F.col("close")
    return F.ln(r) if log else r - 1


def realized_vol(bars: DataFrame, w: int = 60, name: str = "rv", ewma: bool = False) -> DataFrame:
    """Root mean square of log returns (the first is 0) over w bars; with ewma, of all so far with 2 / (w + 1) as weight of
    the newest."""
    b = bars.withColumn("__r", log_return())
    if not ewma:
        return b.withColumn(name, rms(F.col("__r"), w)).drop("__r")
    b = b.withColumn("__sq", F.col("__r") * F.col("__r"))
    return ema(b, "__sq", w).withColumn(name, F.sqrt("ema")).drop("__r", "__sq", "ema")


def vwap(w: int) -> Column:
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum("volume").over(frame(w))
    return F.when((F.count("volume").over(frame(w)) == w) & (v > 0), F.sum(price * F.col("volume")).over(frame(w)) / v)


def donchian(w: int = 20) -> tuple[Column, Column]:
    return full(F.max, F.col("high"), w), full(F.min, F.col("low"), w)


def zscore(x: Column, w: int) -> Column:
    sd = full(F.stddev_pop, x, w)
    return F.when(sd > 0, (x - full(F.avg, x, w)) / sd)


def rolling_ols(y: Column, x: Column, w: int) -> tuple[Column, Column]:
    """Intercept and slope over w rows; null without variance of x."""
    f = frame(w)
    n = F.count(x + y).over(f)
    mx, my = F.avg(x).over(f), F.avg(y).over(f)
    var = F.avg(x * x).over(f) - mx * mx
    slope = F.when((n == w) & (var > 1e-18), (F.avg(x * y).over(f) - mx * my) / var)
    return my - slope * mx, slope


def rank_average(x: Column, *by: str) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def table_ranks(df: DataFrame, value: str, bins: int = 4096) -> DataFrame:
    """value and rank of each distinct value over the table, ties at their mean rank. Values are counted first; bins between
    the least and the largest have their counts summed up, and only within a bin values are put in order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    ends = counts.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.coalesce(F.floor((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins), F.lit(0))
    c = counts.crossJoin(F.broadcast(ends)).withColumn("__b", place).drop("__lo", "__hi")  # one row
    below = c.groupBy("__b").agg(F.sum("__c").alias("n")).withColumn("__below", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a bin
    upto = F.sum("__c").over(Window.partitionBy("__b").orderBy(value))
    return c.join(F.broadcast(below.select("__b", "__below")), "__b").select(value, (F.col("__below") + upto - (F.col("__c") - 1) / 2).alias("rank"))


#: Rows of a series that one task takes, where a window can be cut.
CHUNK = 500_000


def over_groups(df: DataFrame, keys: list[str], make: Callable, schema, order: str = "idx") -> DataFrame:
    """make(columns, bounds) on the groups of keys, each in order: columns is an Arrow table of several whole groups, of which the
    g-th lies between bounds[g] and bounds[g + 1]; make returns arrays by the names of schema, all of one length. Many short
    groups cost one call together; a task holds its longest group and a batch."""
    names = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fieldNames()
    d = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def made(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            first = np.flatnonzero(t.column("__n").to_numpy() == 1)
            out = make(t, np.append(first, t.num_rows))
            arrays = [out[n] for n in names]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a if isinstance(a, pa.Array) else pa.array(a, from_pandas=True) for a in arrays]
            return pa.RecordBatch.from_arrays(arrays, names)

        held = []
        for b in batches:
            first = np.flatnonzero(b.column(b.schema.get_field_index("__n")).to_numpy() == 1)
            cut = int(first[-1]) if len(first) else b.num_rows
            if cut:
                held.append(b.slice(0, cut))
            if len(first):
                if held:
                    yield made(held)
                held = [b.slice(cut)]
        if held:
            yield made(held)

    return d.mapInArrow(run, schema)


def average_ranks(x, bounds):
    """Ranks from 1 of values, none undefined, within the groups between bounds, ties at their mean."""
    import numpy as np

    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((x, group))
    g, x = group[by], x[by]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
    size = np.diff(np.append(first, len(x)))
    rank = np.empty(len(x))
    rank[by] = np.repeat(first + (size - 1) / 2, size) - bounds[g] + 1
    return rank


def group_ranks(df: DataFrame, keys: list[str], columns: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """df with the ranks of columns within the groups of keys, by names: rows are put in order once, whatever the number of columns."""
    schema, kept = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]), df.columns
    return over_groups(df, keys, lambda t, bounds: {c: t[c] for c in kept} | {n: average_ranks(_numbers(t[c]), bounds) for c, n in zip(columns, names)}, schema, columns[0])


def _numbers(column):
    """An Arrow column as doubles, nulls as NaN."""
    import numpy as np

    return np.asarray(column.cast("double").to_numpy(), float)


def rolling_moments(bars: DataFrame, w: int, z: str | None, pairs: tuple[str, str] | None, names: tuple[str, str], size: int | None = None) -> DataFrame:
    """symbol, idx, and by names: zscore(z, w), and the slope of rolling_ols(*pairs, w). Windows of a chunk are rows of one view, so that a
    window's sums are made by array."""
    kind = bars.schema["symbol"].dataType.simpleString()
    size = max(size or CHUNK, w)
    k = F.floor(F.col("idx") / size)
    columns = list(dict.fromkeys([z, *pairs]))
    b = bars.select("symbol", "idx", *columns, F.explode(F.when(F.col("idx") % size >= size - w, F.array(k, k + 1)).otherwise(F.array(k))).alias("__k"))

    def make(t, bounds):
        import numpy as np

        view = lambda x: np.lib.stride_tricks.sliding_window_view(x, w)
        v = {c: _numbers(t[c]) for c in columns}
        n = t.num_rows
        score, slope = np.full(n, np.nan), np.full(n, np.nan)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ends = np.flatnonzero((group[w - 1 :] == group[: n - w + 1])) if n >= w else np.empty(0, int)  # windows within one group
        for a in range(0, len(ends), 20_000):
            at = ends[a : a + 20_000]
            with np.errstate(all="ignore"):
                x = view(v[z])[at]
                mean = x.mean(1)
                sd = np.where(x.max(1) > x.min(1), np.sqrt(((x - mean[:, None]) ** 2).mean(1)), 0.0)
                score[at + w - 1] = np.where(sd > 0, (v[z][at + w - 1] - mean) / sd, np.nan)
                y, x = view(v[pairs[0]])[at], view(v[pairs[1]])[at]
                mx, my = x.mean(1), y.mean(1)
                var = (x * x).mean(1) - mx * mx
                slope[at + w - 1] = np.where(var > 1e-18, ((x * y).mean(1) - mx * my) / var, np.nan)
        idx = t["idx"].to_numpy()
        own = idx // size == t["__k"].to_numpy()
        t = t.filter(own)
        return {"symbol": t["symbol"], "idx": t["idx"], names[0]: score[own], names[1]: slope[own]}

    return over_groups(b, ["symbol", "__k"], make, f"symbol {kind}, idx long, {names[0]} double, {names[1]} double")


def over_chunks(bars: DataFrame, w: int, make: Callable, size: int | None = None) -> DataFrame:
    """make(bars), which adds columns from windows that end at a row and look back fewer than w rows, on chunks of each
    series that take w rows of the chunk before along. make sees a chunk as a symbol of its own and keeps symbol and idx."""
    size = max(size or CHUNK, w)
    k = F.floor(F.col("idx") / size)
    b = bars.withColumn("__k", F.explode(F.when(F.col("idx") % size >= size - w, F.array(k, k + 1)).otherwise(F.array(k))))
    out = make(b.withColumn("symbol", F.struct("symbol", F.col("__k").alias("k"))).drop("__k"))
    return out.filter(F.floor(F.col("idx") / size) == F.col("symbol.k")).withColumn("symbol", F.col("symbol.symbol"))


def _before(parts: DataFrame, value: Column, name: str) -> DataFrame:
    """parts (symbol, __k) with value over the chunks before, as name: a row a chunk."""
    return parts.withColumn(name, value.over(by_symbol("__k").rowsBetween(Window.unboundedPreceding, -1)))


def drawdowns(bars: DataFrame, value: str, size: int | None = None) -> DataFrame:
    """bars with drawdown, the fall of value from its peak so far as a share of it. The peak is carried from chunk to chunk."""
    b = materialize(bars, "values").withColumn("__k", F.floor(F.col("idx") / (size or CHUNK)))  # read twice
    peaks = _before(b.groupBy("symbol", "__k").agg(F.max(value).alias("__m")), F.max("__m"), "__p").drop("__m")
    inside = F.max(value).over(Window.partitionBy("symbol", "__k").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("__i", inside).join(peaks, ["symbol", "__k"])
    peak = F.greatest("__i", "__p")  # leaves nulls out
    return b.withColumn("drawdown", F.when(peak > 0, (peak - F.col(value)) / peak).otherwise(0.0)).drop("__k", "__i", "__p")


def islands(df: DataFrame, label: str, size: int | None = None) -> DataFrame:
    """df with run, the number of the run of equal labels a row is in. Rows are in order of idx, which may have holes; a
    chunk knows the last label and the number of runs before it."""
    b = materialize(df, "labels").withColumn("__k", F.floor(F.col("idx") / (size or CHUNK)))  # three parts of the plan read it
    w = Window.partitionBy("symbol", "__k").orderBy("idx")
    ends = b.groupBy("symbol", "__k").agg(F.max_by(F.struct(F.col(label).alias("l")), "idx").alias("__e"), F.min("idx").alias("__f"))
    ends = _before(ends, F.last("__e"), "__b").drop("__e")
    b = b.join(ends, ["symbol", "__k"])
    prev = F.when(F.col("idx") == F.col("__f"), F.col("__b.l")).otherwise(F.lag(label).over(w))
    first = (F.col("idx") == F.col("__f")) & F.col("__b").isNull()
    b = b.withColumn("__c", F.when(first | ~F.col(label).eqNullSafe(prev), 1).otherwise(0))
    before = _before(b.groupBy("symbol", "__k").agg(F.sum("__c").alias("__n")), F.sum("__n"), "__r").drop("__n")
    run = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__r", F.lit(0))
    return b.join(before, ["symbol", "__k"]).withColumn("run", run).drop("__k", "__f", "__b", "__c", "__r")


def _chunked(bars: DataFrame, column: str, alpha: float, chunk: int, hold_null: bool) -> DataFrame:
    """y_t = (1 - alpha) y_{t-1} + alpha x_t in chunks of rows: each chunk is solved from 0 in its own task, the chunks'
    ends are chained (one row a chunk), and the carry is added. y starts at the first x."""
    b = bars.withColumn("__chunk", F.floor(F.col("idx") / chunk))
    first = F.min(F.when(F.col(column).isNotNull(), F.col("idx"))).over(Window.partitionBy("symbol"))
    b = b.withColumn("__start", first)

    solve = recurrence(1 - alpha)

    def local(t, bounds):
        import numpy as np

        x, idx, start = _numbers(t[column]), t["idx"].to_numpy(), _numbers(t["__start"])
        ys, ps = np.zeros(len(x)), np.ones(len(x))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = np.flatnonzero(idx[a:z] == start[a])  # the first x lies in this chunk, or there is none
            s = a + int(at[0]) if len(at) else a - 1
            known = ~np.isnan(x[s + 1 : z])
            y = solve(np.concatenate([[0.0], alpha * x[s + 1 : z][known]]), x[s] if len(at) else 0.0)
            so_far = np.cumsum(known)
            ys[s + 1 : z] = y[so_far]
            ps[s + 1 : z] = 0.0 if len(at) else (1 - alpha) ** so_far
            if len(at):
                ys[s], ps[s] = x[s], 0.0
        return {c: t[c] for c in names} | {"__y": ys, "__p": ps}

    names = b.columns
    schema = T.StructType([*b.schema.fields, T.StructField("__y", T.DoubleType()), T.StructField("__p", T.DoubleType())])
    part = over_groups(b, ["symbol", "__chunk"], local, schema)
    shown = (F.col("idx") >= F.col("__start")) & (F.lit(hold_null) | F.col(column).isNotNull())
    most = bars.agg(F.max("idx")).first()[0]
    if most is None or most < chunk:  # nothing is carried: part is read once
        return part.withColumn("ema", F.when(shown, F.col("__y"))).drop("__chunk", "__y", "__p", "__start")
    ends = part.groupBy("symbol", "__chunk").agg(F.max_by(F.struct("__y", "__p"), "idx").alias("e")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("__chunk", "e"))).alias("ends"))
    carry = F.aggregate("ends", F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<k:bigint,c:double>>").alias("out")), lambda a, x: F.struct((x["e"]["__y"] + x["e"]["__p"] * a["c"]).alias("c"), F.concat(a["out"], F.array(F.struct(x["__chunk"].alias("k"), a["c"].alias("c")))).alias("out")))["out"]
    carried = ends.select("symbol", F.explode(carry).alias("x")).select("symbol", F.col("x.k").alias("__chunk"), F.col("x.c").alias("__c"))
    return part.join(carried, ["symbol", "__chunk"]).withColumn("ema", F.when(shown, F.col("__y") + F.col("__p") * F.col("__c"))).drop("__chunk", "__y", "__p", "__c", "__start")


def ema(bars: DataFrame, column: str, span: int, chunk: int = 50_000) -> DataFrame:
    """bars with ema: exponential mean with 2 / (span + 1); leading nulls stay, inner ones hold the value."""
    return _chunked(bars, column, 2 / (span + 1), chunk, True)


def rolling_quantile(bars: DataFrame, column: str, w: int, qs: dict[str, float], chunk: int | None = None, min_rows: int | None = None, interpolation: str = "linear") -> DataFrame:
    """bars with interpolated rolling quantiles over w rows. Chunks of rows take w - 1 rows of halo along, so a
    long window neither sits in one task nor costs w steps a row."""
    size = chunk or max(20 * w, 10_000)
    k = F.floor(F.col("idx") / size)
    halo = F.when(F.col("idx") % size > size - w, F.array(k, k + 1)).otherwise(F.array(k))
    b = bars.withColumn("__chunk", F.explode(halo)) if w <= size else bars.withColumn("__chunk", F.explode(F.sequence(k, F.floor((F.col("idx") + w - 1) / size))))
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in qs]])

    names = bars.columns

    def run(t, bounds):
        import numpy as np
        import pandas as pd

        x = _numbers(t[column])
        out = {n: np.full(len(x), np.nan) for n in qs}
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if z - a >= (min_rows or w):
                r = pd.Series(x[a:z]).rolling(w, min_periods=min_rows or w)
                for n, q in qs.items():
                    out[n][a:z] = r.quantile(q, interpolation=interpolation).to_numpy()
        own = t["idx"].to_numpy() // size == t["__chunk"].to_numpy()
        t = t.filter(own)
        return {c: t[c] for c in names} | {n: v[own] for n, v in out.items()}

    return over_groups(b, ["symbol", "__chunk"], run, schema)
