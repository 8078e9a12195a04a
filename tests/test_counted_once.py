"""Rows are counted or ranked once, and no task gathers a table's rows or values."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import benchmark as B, measures as M, resample, studies as S


def plan(df):
    return df._jdf.queryExecution().toString()


def labelled(spark, n=400):
    r = random.Random(3)
    rows = [(s, i, r.randint(-1, 2), r.randint(0, 2), r.randint(0, 2), r.gauss(0, 1)) for s in range(4) for i in range(n // 4)]
    return spark.createDataFrame(rows, "symbol long, idx long, a int, b int, c int, fwd double")


def test_state_counts_of_a_table_take_no_window(spark):  # F40
    df = labelled(spark).select("symbol", "idx", F.col("a").alias("label"))
    got = B.state_counts(df, 3, 5)
    assert "Window" not in plan(got)
    rows = [(r["idx"], r["label"]) for r in df.collect()]
    first = min(i for i, x in rows if x >= 0)
    on = [x for i, x in rows if i >= first and (i - first) % 5 == 0]
    assert tuple(got.first()) == (sum(x >= 0 for _, x in rows), *(on.count(k) for k in range(3)))


def test_pairs_read_counts_not_rows(spark):  # F30
    df = labelled(spark)
    got = B.agreement_of_pairs(df, ["a", "b", "c"])
    assert "fwd" not in plan(got) and "LogicalRDD" not in plan(got)
    both = df.filter("a >= 0")
    want = {tuple(r) for x, y in (("a", "b"), ("a", "c"), ("b", "c")) for r in M.agreement(both, x, y).select(F.lit(f"{x}__{y}"), "n", F.round("kappa", 9), F.round("ari", 9)).collect()}
    assert {tuple(r) for r in got.select("pair", "n", F.round("kappa", 9), F.round("ari", 9)).collect()} == want


def test_medians_by_state_are_not_gathered(spark):  # F29
    df = labelled(spark)
    got = B.contingent_information(df.filter("a <> 1"), "a", "fwd", 3, 9.0)
    assert "percentile(" not in plan(got)
    r = got.first()
    for k in (0, 2):
        x = df.filter(F.col("a") == k).agg(F.count("*").alias("n"), F.percentile("fwd", F.lit(0.5)).alias("m")).first()
        assert r[f"n_{k}"] == x["n"] and r[f"median_{k}"] == pytest.approx(x["m"], abs=1e-12)
    assert r["n_1"] == 0 and r["median_1"] is None and r["mean_1"] is None


def test_degeneracy_of_few_groups(spark):  # F37
    df = labelled(spark).select("c", F.abs("fwd").alias("x"))
    a, b = (M.degeneracy(df, "x", "c", few=few) for few in (False, True))
    assert "percentile(" not in plan(b)
    close = lambda d: [[pytest.approx(v, rel=1e-9) for v in r] for r in d.select("c", "n", "mean", "std", "iqr", "rail", "zero", "cv").orderBy("c").collect()]
    assert [list(r) for r in b.select("c", "n", "mean", "std", "iqr", "rail", "zero", "cv").orderBy("c").collect()] == close(a)


def test_ranks_in_one_order_of_rows(spark):  # F38, F43
    r = random.Random(8)
    df = spark.createDataFrame([(s, i, float(r.randint(0, 9)), float(r.randint(0, 9))) for s in range(3) for i in range(9 + s)], "symbol long, idx long, x double, y double")
    p, ic = S.rank_products(df, "x", "y", "symbol"), M.spearman(df, "x", "y", "symbol")
    # one window in each of the four forms of the plan: the number of the row
    assert plan(p).count("Window [") <= 4 and "avg" not in plan(p) and "rank(" not in plan(ic)
    mean = {r["symbol"]: r["m"] for r in p.groupBy("symbol").agg(F.avg("rank_product").alias("m")).collect()}
    by = {r["symbol"]: (r["n"], r["ic"]) for r in ic.collect()}
    pd = df.toPandas()
    assert set(mean) == {1, 2} and by[0] == (9, None)
    for s in (1, 2):
        d = pd[pd["symbol"] == s]
        want = d["x"].rank().corr(d["y"].rank())
        assert mean[s] == pytest.approx(want) and by[s] == (9 + s, pytest.approx(want))


def test_drawn_blocks_do_not_move(spark):  # F41
    r = random.Random(2)
    df = spark.createDataFrame([(s, i, r.gauss(0, 1)) for s, n in (("a", 41), ("b", 60), ("c", 7)) for i in range(n)], "symbol string, idx long, r double")
    short, long = (resample.block_bootstrap_ci(df, "r", 20, 30, whole=w) for w in (100, 0))
    assert "start" not in plan(short)
    rows = lambda d: [(x["symbol"], x["n"], x["reps"], None if x["lo"] is None else round(x["lo"], 9), None if x["hi"] is None else round(x["hi"], 9)) for x in d.orderBy("symbol").collect()]
    assert rows(short) == rows(long) and rows(short)[2][3] is None
