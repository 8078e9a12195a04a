"""Mixing sources to target weights by hash thresholds: histograms, not sorts.

Every document has a 60-bit hash. For a source with a budget, the words of its documents are summed by hash
bucket; the bucket in which the running sum passes the budget is the boundary, and only that bucket is dealt
into finer buckets, until it holds one hash. Documents below the boundary are taken once more than the whole
rounds that fit; the boundary document gives the words that are left. A larger budget has a higher threshold,
so the choices of several budgets are nested.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null source is a source, the last one;
rows that share a hash (repeated rows, null ids) share what the boundary leaves by size, rounded down; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sized_join

BITS, LEVEL = 60, 12


def n_words(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash60(key: Column) -> Column:
    """The first 15 hexadecimal digits of the id's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: their place by code point, null last. Ranges are dealt out; only their counts meet in one task."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(before, "part").withColumn("rank", F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part", "count", "before")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with weight and target: share times all sizes is dealt by weight, and what is
    over most times a source's size is dealt again among the others. Each round is one aggregate."""
    w = reduce(lambda c, k: c.when(F.col("rank") % len(weights) == k, float(weights[k])), range(len(weights)), F.when(F.lit(False), 0.0))
    s = materialize(ranked(sources).withColumn("weight", w).withColumn("most", most * F.col("source_size")), "weights")
    pool = share * (s.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= level * F.col("weight")
        x = s.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = (pool - (x["spent"] or 0.0)) / x["open"] if x["open"] else level
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight"))).select("source", "source_size", "weight", "target")


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of budgets (source, source_size, rest): at, the boundary hash; left, the words that the rows
    with that hash give; held, their words. docs: source, size, hash."""
    docs = docs.filter("size > 0")
    open_, shift = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left")), BITS
    while shift:
        shift -= LEVEL
        bucket = F.shiftright("hash", shift)
        if shift + LEVEL == BITS:
            rows = docs.select("source", bucket.alias("bucket"), "size")
        else:  # only the boundary bucket of each source
            d = docs.withColumn("prefix", F.shiftright("hash", shift + LEVEL))
            rows = d.join(open_.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))).select("source", bucket.alias("bucket"), "size")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))  # at most 2 ** LEVEL rows a source
        o = open_.select(F.col("source").alias("s"), F.col("left").alias("l"))
        passed = run.join(o, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("upto") > F.col("l")) & (F.col("upto") - F.col("words") <= F.col("l")))
        open_ = materialize(passed.select("source", F.col("bucket").alias("prefix"), (F.col("l") - F.col("upto") + F.col("words")).alias("left"), F.col("words").alias("held")), "thresholds")
    return open_.withColumnRenamed("prefix", "at")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=(3, 1, 2), shares=(1.5,), most: float = 2.0, carry: bool = False) -> DataFrame:
    """doc_id, source, (with carry: all columns of df) size, source_size and, for each share, target and taken (target_1,
    taken_1, ... for the further ones). With carry, columns of df named like a result are replaced, no other."""
    docs = materialize(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hash60(F.col(key)).alias("hash")), "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes, own = docs, {c: f"__mix_{c}" for c in ("source", "size", "hash", "z", "target", "rounds", "at", "left", "held")}
    kept = ["doc_id", "source"]
    if carry:
        results = {"size", "source_size"} | {x + (f"_{n}" if n else "") for x in ("target", "taken") for n in range(len(shares))}
        kept, docs = [c for c in df.columns if c not in results], df
    numbers = (n_words(F.col(text)), hash60(F.col(key))) if carry else (F.col("size"), F.col("hash"))
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.struct(F.col(source if carry else "source").alias("source")).alias(own["source"]), numbers[0].alias(own["size"]), numbers[1].alias(own["hash"]))
    for n, share in enumerate(shares):
        tail = f"_{n}" if n else ""
        t = targets(sources, weights, share, most)
        per = t.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
        per = materialize(per.withColumn("rest", (F.round("target").cast("long") - F.col("rounds") * F.col("source_size"))), "budgets")
        b = thresholds(sizes.select("source", "size", "hash"), per.filter("rest > 0"))
        plan = per.join(b.select(F.col("source").alias("s"), "at", "left", "held"), F.col("source").eqNullSafe(F.col("s")), "left")
        plan = plan.select(F.struct("source").alias(own["source"]), F.col("source_size").alias(own["z"]), *(F.col(c).alias(own[c]) for c in ("target", "rounds", "at", "left", "held")))
        plan = materialize(plan, "plan")
        docs = sized_join(docs, plan, [own["source"]], "inner", F.coalesce(F.octet_length(f"{own['source']}.source"), F.lit(0)) + 80)
        size, hash_, at = (F.col(own[c]) for c in ("size", "hash", "at"))
        extra = F.when(hash_ < at, size).when(hash_ == at, F.expr(f"CAST(({own['left']} * {own['size']}) div {own['held']} AS BIGINT)")).otherwise(F.lit(0))
        made = [*(["source_size"] if n == 0 else []), "target" + tail, "taken" + tail]
        values = [*([F.col(own["z"])] if n == 0 else []), F.col(own["target"]), F.col(own["rounds"]) * size + F.coalesce(extra, F.lit(0))]
        docs = docs.select("*", *(v.alias(c) for v, c in zip(values, made))).drop(*(own[c] for c in ("z", "target", "rounds", "at", "left", "held")))
        kept += made
    first = kept.index("source_size")
    return docs.select(*(F.col(f"`{c}`") for c in kept[:first]), F.col(own["size"]).alias("size"), *kept[first:])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL_OP2_FROM = r"""
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM {docs}
), s0 AS (
  SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source
), s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * z AS most FROM s0
), s2 AS (
  SELECT *, row_number() OVER (ORDER BY most / w, source) AS k,
         coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (ORDER BY most / w DESC, source DESC) AS open, 1.5::DOUBLE * sum(z) OVER () AS pool FROM s1
), s3 AS (
  SELECT *, (pool - spent) / open AS level FROM s2
), lv AS (
  SELECT arg_min(level, k) AS level FROM s3 WHERE level <= most / w
), s4 AS (
  SELECT source, z, CASE WHEN z = 0 THEN 0.0 ELSE least(most, lv.level * w) END AS target FROM s3, lv
), s5 AS (
  SELECT *, CASE WHEN z > 0 THEN floor(target / z)::BIGINT ELSE 0 END AS rounds FROM s4
), s6 AS (
  SELECT *, round(target)::BIGINT - rounds * z AS rest FROM s5
), h AS (
  SELECT source, hash, sum(size)::BIGINT AS held FROM d GROUP BY source, hash
), h2 AS (
  SELECT *, (sum(held) OVER (PARTITION BY source ORDER BY hash))::BIGINT - held AS before FROM h
), r AS (
  SELECT d.doc_id, d.size, s.z AS source_size, s.target, s.rounds * d.size + CASE WHEN h.before + h.held <= s.rest THEN d.size
         WHEN h.before < s.rest THEN ((s.rest - h.before) * d.size) // h.held ELSE 0 END AS taken
  FROM d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source JOIN h2 h ON d.source IS NOT DISTINCT FROM h.source AND d.hash = h.hash
)
"""
SQL_OP2 = "WITH" + SQL_OP2_FROM.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM r"
