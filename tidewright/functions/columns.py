"""Closed forms as column expressions, and their DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 150


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the series of odd powers over double factorials; 0 beyond 8, null for null."""
    x = F.least(F.abs(z), F.lit(8.0))
    start = F.struct(x.alias("t"), x.alias("s"))

    def add(a, k):
        t = a["t"] * x * x / (2 * k + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add)["s"]
    return F.when(F.abs(z) >= 8, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * total))


def normal_cdf(x: Column) -> Column:
    tail = two_sided_p(x) / 2
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided_p_sql(z: str) -> str:
    """The same from the gamma function."""
    return f"CASE WHEN abs({z}) >= 8 THEN 0 WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 * exp(-(({z}) ** 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, {TERMS}), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))) END"


def zero_filled(label: Column, states: int, name: str = "n_") -> list[Column]:
    """Counts of the labels 0 to states - 1, as aggregates."""
    return [F.sum(F.when(label == k, 1).otherwise(0)).cast("long").alias(f"{name}{k}") for k in range(states)]
