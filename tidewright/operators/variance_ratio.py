"""Variance ratios with heteroscedasticity-robust z over windows of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

HORIZONS = (2, 5, 15, 60)


def kernel(prices, q: int):
    """VR - 1 and z of each row of a matrix of W prices; NaN where undefined."""
    import numpy as np

    y = np.asarray(prices, float)
    n = y.shape[1] - 1
    out = np.full((2, len(y)), np.nan)
    if q < 2:
        raise ValueError("q must be 2 or more")
    m = q * (n - q + 1) * (1 - q / n) if n else 0.0
    if n < q + 1 or m == 0:
        return out
    mu = (y[:, -1] - y[:, 0])[:, None] / n
    d2 = (np.diff(y, axis=1) - mu) ** 2
    total = d2.sum(1)
    with np.errstate(all="ignore"):
        vr = (((y[:, q:] - y[:, :-q]) - q * mu) ** 2).sum(1) / m / (total / (n - 1))
        phi = sum(4 * (1 - k / q) ** 2 * n * (d2[:, k:] * d2[:, :-k]).sum(1) for k in range(1, q)) / total**2
        good = (total > 0) & (phi > 0)
        out[0] = np.where(good, vr - 1, np.nan)
        out[1] = np.where(good, np.sqrt(n) * (vr - 1) / np.sqrt(phi), np.nan)
    return out


def strided(bars: DataFrame, w: int, horizons=HORIZONS) -> DataFrame:
    """A row for each symbol, full window of w bars without overlap, and horizon: win, end_idx, end_ts, q, vr_dev (VR - 1)
    and z. Only windows that are kept are computed: one exchange by window, then matrices of windows."""
    b = bars.groupBy("symbol", F.floor(F.col("idx") / w).alias("win")).agg(F.count("close").alias("n"), F.max("idx").alias("end_idx"), F.max("ts").alias("end_ts"), F.array_sort(F.collect_list(F.struct("idx", "close"))).alias("c"))
    b = b.filter(F.col("n") == w).select("symbol", "win", "end_idx", "end_ts", F.col("c.close").alias("close"))
    return _measure(b, w, horizons)


def rolling(bars: DataFrame, w: int, horizons=HORIZONS, chunk: int = 4096) -> DataFrame:
    """As strided(), for the window that ends at every bar; chunks of bars take w - 1 bars of halo along."""
    k = F.floor(F.col("idx") / chunk)
    b = bars.withColumn("chunk", F.explode(F.sequence(k, F.floor((F.col("idx") + w - 1) / chunk))))
    b = b.groupBy("symbol", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "close", "ts"))).alias("c")).select("symbol", "chunk", F.col("c.idx").alias("i"), F.col("c.close").alias("close"), F.col("c.ts").alias("t"))
    kind = bars.schema["symbol"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in range(b.num_rows):
                i, close, t = (np.asarray(b.column(c)[row].values.to_numpy(zero_copy_only=False)) for c in (2, 3, 4))
                if len(close) < w:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(close, w)
                own = i[w - 1 :] // chunk == b.column(1)[row].as_py()
                e, ts = i[w - 1 :][own], t[w - 1 :][own]
                for q in horizons:
                    v, z = kernel(windows[own], q)
                    n = len(e)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[row].as_py()] * n, b.column(0).type), pa.array(e), pa.array(ts), pa.array(np.full(n, q, np.int32)), pa.array(v, from_pandas=True), pa.array(z, from_pandas=True)], ["symbol", "end_idx", "end_ts", "q", "vr_dev", "z"])

    return b.mapInArrow(run, f"symbol {kind}, end_idx long, end_ts long, q int, vr_dev double, z double")


def by_stride(bars: DataFrame, w: int, horizons=HORIZONS, stride: int = 1) -> DataFrame:
    """Windows of w bars at every stride: all of them, those that don't overlap, or every stride-th of all."""
    if stride == w:
        return strided(bars, w, horizons).drop("win")
    return rolling(bars, w, horizons).filter((F.col("end_idx") - (w - 1)) % stride == 0)


def _measure(windows: DataFrame, w: int, horizons) -> DataFrame:
    kind = windows.schema["symbol"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, w)
            for q in horizons:
                v, z = kernel(y, q)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(v), q, np.int32)), pa.array(v, from_pandas=True), pa.array(z, from_pandas=True)], ["symbol", "win", "end_idx", "end_ts", "q", "vr_dev", "z"])

    return windows.mapInArrow(run, f"symbol {kind}, win long, end_idx long, end_ts long, q int, vr_dev double, z double")


def significance(vr: DataFrame, *by: str, closed: float = 0.001) -> DataFrame:
    """By q (and by): windows, median and mean |VR - 1|, median z, and whether the median is as good as 0. Without by, a
    horizon holds all windows: its medians are found without gathering them."""
    v = vr.filter("vr_dev IS NOT NULL")
    size = F.abs("vr_dev")
    if by:
        s = v.groupBy(*by, "q").agg(F.count("*").alias("n"), F.percentile(size, F.lit(0.5)).alias("median_dev"), F.avg(size).alias("mean_dev"), F.percentile("z", F.lit(0.5)).alias("median_z"))
    else:
        from .measures import exact_quantiles

        v = materialize(v.select("q", "vr_dev", "z"), "windows")  # quantiles read it several times
        m = exact_quantiles(v, size, {"median_dev": 0.5}, "q").join(exact_quantiles(v, F.col("z"), {"median_z": 0.5}, "q").drop("n"), "q")
        s = m.join(v.groupBy("q").agg(F.avg(size).alias("mean_dev")), "q").select("q", "n", "median_dev", "mean_dev", "median_z")
    return s.withColumn("closed", F.col("median_dev") < closed)


def departure(vr: DataFrame, name: str, *by: str) -> DataFrame:
    """By q (and by, a few values): windows, and the median |VR - 1|, found without gathering them."""
    from .measures import exact_quantiles

    v = vr.filter("vr_dev IS NOT NULL").select(*by, F.col("q").cast("long").alias("q"), F.abs("vr_dev").alias("x"))
    return exact_quantiles(materialize(v, "windows"), F.col("x"), {name: 0.5}, *by, "q")


def vr_sql(w: int, horizons, source: str = "panel") -> str:
    """The same windows in DuckDB, as CTE vr."""
    qs = ", ".join(map(str, horizons))
    return f"""v0 AS (
  SELECT symbol, idx // {w} AS win, list(close ORDER BY idx) AS y, max(idx) AS end_idx, max(ts) AS end_ts FROM {source} GROUP BY ALL HAVING count(*) = {w}
), v1 AS (
  SELECT *, {w - 1} AS n, (y[{w}] - y[1]) / {w - 1} AS mu FROM v0
), v2 AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: (y[i + 1] - y[i] - mu) ** 2) AS d FROM v1
), v3 AS (
  SELECT *, list_sum(d) AS s FROM v2
), v4 AS (
  SELECT symbol, win, end_idx, end_ts, q, n, s,
         list_sum(list_transform(range(1, n - q + 2), lambda i: (y[i + q] - y[i] - q * mu) ** 2)) / (q * (n - q + 1) * (1 - q / n)) / (s / (n - 1)) AS ratio,
         list_sum(list_transform(range(1, q), lambda k: 4 * (1 - k / q) ** 2 * n * list_sum(list_transform(range(k + 1, n + 1), lambda i: d[i] * d[i - k])))) / (s * s) AS phi
  FROM v3, (SELECT unnest([{qs}]) AS q) WHERE n >= q + 1 AND s > 0
), vr AS (
  SELECT symbol, win, end_idx, end_ts, q, ratio - 1 AS vr_dev, sqrt(n) * (ratio - 1) / sqrt(phi) AS z FROM v4 WHERE phi > 0
)"""
