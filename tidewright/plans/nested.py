"""Queries over nested regressions and detection limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regress
from .common import query, rounded
from .features import QUANT, labels


@query(QUANT + """, d AS (SELECT symbol, idx, rv AS y, label, lag(label) OVER (PARTITION BY symbol ORDER BY idx) AS prev FROM l)
SELECT symbol, idx, round(y, 6) AS y, (label = 1)::INT::DOUBLE AS x1, (label = 2)::INT::DOUBLE AS x2, (prev = 1)::INT::DOUBLE AS x3, (prev = 2)::INT::DOUBLE AS x4, (label <> prev)::INT::DOUBLE AS x5 FROM d WHERE (idx + 1) % 20 = 0 AND label >= 0 AND prev >= 0 AND y IS NOT NULL""")
def design_matrix(spark, sf):
    return rounded(regress.design(labels(spark, sf), "label", "rv", 20).drop("x0"), "y")


@query()
def nested_regression(spark, sf):
    """What is solved are a few sums of six columns; only these come to the driver."""
    d = regress.design(labels(spark, sf), "label", "rv", 20).persist()  # four aggregates read it
    xs = [f"x{k}" for k in range(6)]
    try:
        rows = [(name, *(None if t[c] is None else float(t[c]) for c in ("wald", "p", "gain")), t["n"]) for name, added in (("change", ["x5"]), ("previous", ["x3", "x4"])) for t in [regress.nested_test(d, xs, added)]]
    finally:
        d.unpersist()
    return spark.createDataFrame(rows, "test string, wald double, p double, gain double, n long")


@query("""WITH a AS (SELECT l_returnflag AS cell, l_linenumber AS x, avg(l_discount) * 10 + min(l_linenumber) / 20 AS y FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY cell ORDER BY x))
SELECT cell, round(min(CASE WHEN y >= 0.65 THEN CASE WHEN py IS NULL OR py >= 0.65 THEN x ELSE px + (x - px) * (0.65 - py) / (y - py) END END), 5) AS at FROM p GROUP BY cell""")
def detection_limit(spark, sf):
    a = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").cast("double").alias("x")).agg((F.avg("l_discount") * 10 + F.min("l_linenumber") / 20).alias("y"))
    return rounded(regress.first_reaching(a, "x", "y", 0.65, "cell"), "at", digits=5)
