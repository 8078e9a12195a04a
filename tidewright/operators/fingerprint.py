"""Fingerprints of result tables, and the keys in which two tables differ, found down a tree of hashes.

A row's hash is cut from the SHA-256 of its values as text; a set of rows has the sum of its rows' hashes, so that neither order
nor partitions matter. Keys are dealt by the hex digits of their own hash: two tables are compared by the first digits, and only
branches whose sums differ are looked into, `digits` further down at a time. Tables never meet row by row but in branches that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are of 60-bit numbers: decimals of 38 digits hold those of 10^19 rows.
_HALF = 15


def row_hash(columns: list[str]) -> Column:
    """Hex digits of a row: values as text, null apart from every text, joined by a unit separator."""
    text = F.concat_ws("\x1f", *[F.when(F.col(c).isNull(), F.lit("\x00")).otherwise(F.col(c).cast("string")) for c in columns])
    return F.sha2(text, 256)


def _number(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, _HALF), 16, 10).cast("decimal(20,0)")


def _sums(h: str) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(_number(F.col(h), 1)).alias("a"), F.sum(_number(F.col(h), 1 + _HALF)).alias("b")]


def fingerprint(df: DataFrame, columns: list[str] | None = None, *by: str) -> DataFrame:
    """By by: n, and a and b, the sums that stand for the rows' values of columns (all, in order of name, without them)."""
    d = df.withColumn("__h", row_hash(columns or sorted(c for c in df.columns if c not in by)))
    return d.groupBy(*by).agg(*_sums("__h"))


def differing_keys(a: DataFrame, b: DataFrame, key: str, columns: list[str], digits: int = 2, leaf: int = 50_000) -> DataFrame:
    """key, in_a, in_b: the keys whose rows aren't the same in both tables. Branches are looked into until those that differ
    hold at most leaf rows each; branch names that differ go through the driver, at most 16 ** digits times those above them,
    and a table that differs nearly everywhere is joined at once."""
    side = lambda d: d.select(key, F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("\x00")), 256).alias("__k"), row_hash([key, *columns]).alias("__h"))
    a, b, depth, open_ = side(a), side(b), digits, None
    while True:
        prefix = F.substring("__k", 1, depth)
        held = [d if open_ is None else d.filter(F.substring("__k", 1, depth - digits).isin(open_)) for d in (a, b)]
        x, y = (d.groupBy(prefix.alias("p")).agg(*_sums("__h")) for d in held)
        j = x.select("p", F.struct("n", "a", "b").alias("x")).join(y.select("p", F.struct("n", "a", "b").alias("y")), "p", "full")
        bad = j.filter(~F.col("x").eqNullSafe(F.col("y"))).select("p", F.coalesce("x.n", F.lit(0)).alias("m"), F.coalesce("y.n", F.lit(0)).alias("n"))
        found = bad.limit(4 * 16**digits + 1).collect()
        if len(found) > 4 * 16**digits or depth >= 12 or all(max(r["m"], r["n"]) <= leaf for r in found):
            break
        open_, depth = [r["p"] for r in found], depth + digits
    if len(found) <= 4 * 16**digits:
        a, b = (d.filter(F.substring("__k", 1, depth).isin([r["p"] for r in found])) for d in (a, b))
    x, y = (d.groupBy(key).agg(*_sums("__h")) for d in (a, b))
    same = F.col("l.n").eqNullSafe(F.col("r.n")) & F.col("l.a").eqNullSafe(F.col("r.a")) & F.col("l.b").eqNullSafe(F.col("r.b"))
    j = x.alias("l").join(y.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full").filter(~same)
    return j.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), F.coalesce("l.n", F.lit(0)).alias("in_a"), F.coalesce("r.n", F.lit(0)).alias("in_b"))


def differing_fields(a: DataFrame, b: DataFrame, key: str, columns: list[str], **settings) -> DataFrame:
    """key, field, a, b (as text) for the fields of keys that differ and that both tables have once."""
    keys = differing_keys(a, b, key, columns, **settings).filter("in_a = 1 AND in_b = 1").select(key)
    one = lambda d, n: keys.join(d, key).select(key, *[F.col(c).cast("string").alias(f"{n}_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns]))
    return one(a, "a").join(one(b, "b"), key).select(key, each.alias("x")).select(key, "x.*").filter(~F.col("a").eqNullSafe(F.col("b")))


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows, from one row of each."""
    return reduce(lambda x, y: x == y, (tuple(fingerprint(d, columns).first()) for d in (a, b)))
