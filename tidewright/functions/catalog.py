"""Functions that SQL can call: table functions over partitioned, ordered tables, statistics, and a user's own by path.

register(spark) adds those of this library. A table function gets the rows of one partition in order:

    SELECT * FROM bars_by_volume(TABLE(bars) PARTITION BY symbol ORDER BY (idx), 500)

A user's file is read through Spark, so it may lie in any store that Spark reads; what it defines travels to the workers with
the plan. register_statistic() and register_table_function() take a name, the file's path and the name in it, and the declared
types; settings() reads a JSON file of settings over defaults.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

BAR_TYPE = "symbol string, idx bigint, ts bigint, open double, high double, low double, close double, volume double, amount double"


class BarsByAmount:
    """Bars of a partition's rows, closed when the amounts since the last close reach the threshold; an open tail goes."""

    column = "volume"

    def __init__(self):
        self.bars, self.open = 0, None

    def eval(self, row, threshold):
        amount = row[self.column]
        if amount is None or not amount > 0:
            return
        o, h, low, c, v = (float(row[k]) for k in ("open", "high", "low", "close", "volume"))
        if self.open is None:
            self.open = [o, h, low, 0.0, 0.0]
        b = self.open
        b[1], b[2], b[3], b[4] = max(b[1], h), min(b[2], low), b[3] + v, b[4] + float(amount)
        if b[4] >= float(threshold) * (1 - 1e-12):
            yield str(row["symbol"]), self.bars, int(row["ts"]), b[0], b[1], b[2], c, b[3], b[4]
            self.bars, self.open = self.bars + 1, None


class BarsByVariance(BarsByAmount):
    column = "rv_part"


class FilledGaps:
    """A partition's bars with flat ones in every gap of step_ms, as clean.gap_fill makes them."""

    def __init__(self):
        self.last = None

    def eval(self, row, step_ms, most_ms):
        ts, step = int(row["ts"]), int(step_ms)
        if self.last is not None:
            at, close = self.last
            for k in range(1, (ts - at) // step):
                yield str(row["symbol"]), at + k * step, close, close, close, close, 0.0, ts - at > int(most_ms)
        o, h, low, c, v = (float(row[k]) for k in ("open", "high", "low", "close", "volume"))
        yield str(row["symbol"]), ts, o, h, low, c, v, False
        self.last = (ts, c)


TABLE_FUNCTIONS = {
    "bars_by_volume": (BarsByAmount, BAR_TYPE),
    "bars_by_variance": (BarsByVariance, BAR_TYPE),
    "filled_gaps": (FilledGaps, "symbol string, ts bigint, open double, high double, low double, close double, volume double, trading_disabled boolean"),
}


def register(spark: SparkSession) -> None:
    """Makes this library's table functions known to SQL."""
    for name, (handler, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=kind))


def loaded(spark: SparkSession, path: str, name: str) -> Callable:
    """What a Python file defines under a name. The file's code runs on the driver: give only files you trust."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FileNotFoundError(path)
    space: dict = {"__name__": "tidewright_user"}
    exec(compile(text["value"], path, "exec"), space)  # noqa: S102
    if not callable(space.get(name)):
        raise ValueError(f"{path} defines no {name}")
    return space[name]


def register_statistic(spark: SparkSession, name: str, path: str, function: str, kind: str = "double") -> None:
    """A statistic of columns for GROUP BY: function takes a pandas series a column and gives one value of the declared type."""
    f = loaded(spark, path, function)
    hints = getattr(f, "__annotations__", {})
    if "return" not in hints:
        import inspect

        import pandas as pd

        f.__annotations__ = {p: pd.Series for p in inspect.signature(f).parameters} | {"return": float}
    spark.udf.register(name, pandas_udf(f, kind))


def register_table_function(spark: SparkSession, name: str, path: str, handler: str, kind: str) -> None:
    """A table function, such as a strategy: a class whose eval() gets the rows of a partition in order and yields rows of the
    declared type."""
    spark.udtf.register(name, udtf(loaded(spark, path, handler), returnType=kind))


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """defaults with the values of a JSON file; a name that defaults don't have is an error."""
    text = spark.read.text(path, wholetext=True).first()
    given = json.loads(text["value"]) if text else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def found(spark: SparkSession, name: str, *folders: str) -> str:
    """The path of a strategy's or configuration's file: the name itself, or the name in the first folder that has it."""
    jvm = spark._jvm
    for path in (name, *(f"{f.rstrip('/')}/{name}" for f in folders), *(f"{f.rstrip('/')}/{name.rsplit('/', 1)[-1]}" for f in folders)):
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(place) and fs.getFileStatus(place).isFile():
            return path
    raise FileNotFoundError(name)
