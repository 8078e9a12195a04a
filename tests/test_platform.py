"""Versioned tables, fingerprints, functions for SQL, and replay gates: against plain Python."""

import math
import pathlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import catalog
from tidewright.operators import clean, fingerprint as P, replay as R, variance_ratio as VR
from tidewright.sources import versioned

BARS = "symbol string, year int, ts long, open double, high double, low double, close double, volume double"


def bar(symbol, year, ts, close=1.0):
    return (symbol, year, ts, close, close, close, close, 1.0)


def closes(spark, path):
    return {(r["symbol"], r["ts"]): r["close"] for r in versioned.read(spark, path).collect()}


# versions


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [bar("A", 2020, 1), bar("A", 2021, 2), bar("B", 2021, 3)]
    assert versioned.commit(spark, path, lambda old: spark.createDataFrame(rows, BARS), ["symbol", "year"]) == 0
    return path


def test_upsert_keeps_what_was_there_and_rewrites_touched_parts_only(spark, store):
    before = versioned.manifest(spark, store)["parts"]
    assert versioned.upsert(spark, store, spark.createDataFrame([bar("A", 2021, 2, 9.0), bar("A", 2021, 5, 5.0), bar("C/ü", 2022, 7)], BARS), ["symbol", "year"]) == 1
    after = versioned.manifest(spark, store)["parts"]
    assert closes(spark, store) == {("A", 1): 1.0, ("A", 2): 1.0, ("A", 5): 5.0, ("B", 3): 1.0, ("C/ü", 7): 1.0}
    assert {p for p in before if before[p] == after[p]} == {"symbol:A,year:2020", "symbol:B,year:2021"}
    assert versioned.read(spark, store, lambda p: p.endswith("year:2021")).count() == 3


def test_a_key_is_committed_once(spark, store):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "draw int, z double")
    assert [versioned.cell(spark, store + "-grid", k, rows) for k in ("d0.1", "d0.2", "d0.1")] == [0, 1, 1]
    assert versioned.read(spark, store + "-grid").groupBy("cell").count().orderBy("cell").collect() == [("d0.1", 2), ("d0.2", 2)]


def test_a_writer_that_dies_leaves_the_old_version(spark, store):
    boom = F.udf(lambda x: 1 / 0, "double")
    bad = spark.createDataFrame([bar("A", 2021, 9), bar("B", 2021, 9)], BARS).withColumn("close", boom("close"))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        versioned.upsert(spark, store, bad, ["symbol", "year"])
    assert versioned.version(spark, store) == 0 and len(closes(spark, store)) == 3
    dead = pathlib.Path(store) / "data" / "dead" / "part=symbol%3AA,year%3A2021"  # what a killed process leaves behind
    dead.mkdir(parents=True)
    (dead / "part-0.parquet").write_bytes(b"half")
    (pathlib.Path(store) / "manifests" / "000000000001.json.x.tmp").write_text("{")
    versioned.upsert(spark, store, spark.createDataFrame([bar("B", 2021, 9)], BARS), ["symbol", "year"])
    assert len(closes(spark, store)) == 4 and versioned.vacuum(spark, store) == ["dead"] and len(closes(spark, store)) == 4


def test_of_two_writers_none_is_lost(spark, store):
    """The second one commits between the first one's reading and renaming."""
    late = spark.createDataFrame([bar("B", 2021, 11, 11.0)], BARS)
    calls = []

    def make(old):
        before = old(["symbol:B,year:2021"])
        rows = before.unionByName(spark.createDataFrame([bar("B", 2021, 10, 10.0)], BARS))
        if not calls:
            versioned.upsert(spark, store, late, ["symbol", "year"])
        calls.append(1)
        return rows

    assert versioned.commit(spark, store, make, ["symbol", "year"]) == 2 and len(calls) == 2
    assert {k: v for k, v in closes(spark, store).items() if k[0] == "B"} == {("B", 3): 1.0, ("B", 10): 10.0, ("B", 11): 11.0}


def test_provenance_says_what_was_committed(spark, store, tmp_path):
    rows = [bar("B", 2021, 3), bar("A", 2020, 1), bar("A", 2021, 2)]
    other = str(tmp_path / "other")
    versioned.commit(spark, other, lambda old: spark.createDataFrame(rows, BARS).repartition(3), ["symbol", "year"])
    p, q = (versioned.manifest(spark, x)["provenance"] for x in (store, other))
    assert p == q and p["rows"] == 3
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, str(tmp_path / "nothing"))


# fingerprints


def test_equal_tables_are_equal_and_a_differing_key_is_named(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 else k) for k in range(5_000)]
    a = spark.createDataFrame(rows, "k long, v string, x int")
    b = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "k long, v string, x int").repartition(7)
    assert P.same(a, b, ["k", "v", "x"]) and P.differing_keys(a, b, "k", ["v", "x"]).count() == 0
    changed = [(k, v if k != 77 else "w", x if k != 4_001 else 0) for k, v, x in rows if k != 123] + [(9_999, "n", 1), (5, "v5", 5), (None, "z", 1)]
    c = spark.createDataFrame(changed, "k long, v string, x int")
    want = [(None, 0, 1), (5, 1, 2), (77, 1, 1), (123, 1, 0), (4_001, 1, 1), (9_999, 0, 1)]
    for digits, leaf in ((1, 4), (2, 50_000), (1, 0)):
        assert sorted(map(tuple, P.differing_keys(a, c, "k", ["v", "x"], digits, leaf).collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == want
    assert sorted(map(tuple, P.differing_fields(a, c, "k", ["v", "x"]).collect())) == [(77, "v", "v0", "w"), (4_001, "x", None, "0")]
    assert not P.same(a, c, ["k", "v", "x"])
    everywhere = a.withColumn("v", F.lit("q"))
    assert P.differing_keys(a, everywhere, "k", ["v"], 1, 10).count() == 5_000


# SQL


USER = '''
def spread(x, y):
    return float((x - y).abs().max())


class Crossings:
    """A strategy: long above its first price."""

    def __init__(self):
        self.first = None

    def eval(self, row):
        self.first = row["close"] if self.first is None else self.first
        yield row["symbol"], row["idx"], 1 if row["close"] > self.first else 0
'''


def walk(n, seed=1):
    rng = random.Random(seed)
    out = []
    for s in "AB":
        price = 10.0
        for i in range(n):
            price += rng.choice([-0.5, 0.0, 0.75])
            out.append((s, i, i * 60_000 + (600_000 if i > n // 2 else 0), price, price + 1, price - 1, price, float(rng.randint(0, 9))))
    return out


WALK = "symbol string, idx long, ts long, open double, high double, low double, close double, volume double"


def test_table_functions_equal_the_operators(spark):
    from tidewright.operators import rebar

    catalog.register(spark)
    b = spark.createDataFrame(walk(200), WALK)
    b.createOrReplaceTempView("walked")
    got = spark.sql("SELECT * FROM bars_by_volume(TABLE(walked) PARTITION BY symbol ORDER BY (idx), 25)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rebar.volume_bars(b, 25).collect()))
    got = spark.sql("SELECT * FROM filled_gaps(TABLE(walked) PARTITION BY symbol ORDER BY (ts), 60000, 300000)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clean.gap_fill(b, 60_000, 300_000).collect()))


def test_a_user_s_statistic_and_strategy_by_path(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "study.py").write_text(USER)
    (tmp_path / "mine" / "study.json").write_text('{"w": 5}')
    path = catalog.found(spark, "study.py", str(tmp_path), str(tmp_path / "mine"))
    catalog.register_statistic(spark, "spread", path, "spread")
    catalog.register_table_function(spark, "crossings", path, "Crossings", "symbol string, idx bigint, side int")
    rows = walk(50)
    spark.createDataFrame(rows, WALK).createOrReplaceTempView("walked2")
    got = {r["symbol"]: r["s"] for r in spark.sql("SELECT symbol, spread(high, close) AS s FROM walked2 GROUP BY symbol").collect()}
    assert got == {"A": 1.0, "B": 1.0}
    first = {s: next(r[6] for r in rows if r[0] == s) for s in "AB"}
    got = {(r["symbol"], r["idx"]): r["side"] for r in spark.sql("SELECT * FROM crossings(TABLE(walked2) PARTITION BY symbol ORDER BY (idx))").collect()}
    assert got == {(r[0], r[1]): int(r[6] > first[r[0]]) for r in rows}
    assert catalog.settings(spark, str(tmp_path / "mine" / "study.json"), {"w": 1, "q": 2}) == {"w": 5, "q": 2}
    with pytest.raises(ValueError, match="unknown settings"):
        catalog.settings(spark, str(tmp_path / "mine" / "study.json"), {"q": 2})
    with pytest.raises(ValueError, match="defines no"):
        catalog.loaded(spark, path, "nothing")
    with pytest.raises(FileNotFoundError):
        catalog.found(spark, "other.py", str(tmp_path))


def test_held_out_years_open_by_flag_and_marker(spark, tmp_path):
    b = spark.createDataFrame([("A", 1_600_000_000_000), ("A", 1_700_000_000_000)], "symbol string, ts long")
    marker = tmp_path / "opened"
    for permitted in (False, True):
        with pytest.raises(PermissionError):
            clean.open_holdout(b, 2023, permitted, str(marker))
    marker.write_text("")
    with pytest.raises(PermissionError):
        clean.open_holdout(b, 2023, False, str(marker))
    assert [r["ts"] for r in clean.open_holdout(b, 2023, True, str(marker)).collect()] == [1_700_000_000_000]


# replay


def plain_gates(rows, w, q, start, end, window, stride):
    out = {}
    for s in sorted({r[0] for r in rows}):
        b = sorted(r for r in rows if r[0] == s)
        r = [0.0] + [math.log(y[3]) - math.log(x[3]) for x, y in zip(b, b[1:])]
        for t in range(start, end + 1, stride):
            inside = [i for i, x in enumerate(b) if t - window <= x[2] <= t]
            if not inside:
                continue
            a, z = inside[0], inside[-1]
            zs = []
            for k in range(len(b) // w):
                if k * w >= a and k * w + w - 1 <= z:
                    v = VR.kernel(np.array([[x[3] for x in b[k * w : k * w + w]]]), q)[1][0]
                    zs += [v] if np.isfinite(v) else []
            positive, k = max(0.0, statistics.median(zs)) if zs else 0.0, len(zs) or 1
            x, y = [v > 0 for v in r[a : z + 1 - q]], [v > 0 for v in r[a + q : z + 1]]
            mi = 0.0
            if len(inside) > q + 2:
                for u in (False, True):
                    for v in (False, True):
                        n = sum(p == u and o == v for p, o in zip(x, y))
                        if n:
                            mi += n / len(x) * math.log(n * len(x) / (x.count(u) * y.count(v)))
            out[s, t] = (len(inside), max(map(abs, r[a : z + 1])), k, positive, positive * math.sqrt(k), max(0.0, mi) * math.sqrt(max(len(inside) - q, 1)))
    return out


@pytest.mark.parametrize("window,stride,q", [(60, 20, 2), (50, 20, 3), (45, 60, 4), (7, 7, 2)])
def test_gates_of_windows_equal_the_loop(spark, window, stride, q):
    rng = random.Random(window)
    rows = []
    for s in "AB":
        ts, price = rng.randint(0, 30), 50.0
        for i in range(220):
            price *= math.exp(rng.gauss(0, 0.01))
            rows.append((s, i, ts, price))
            ts += rng.choice([1, 1, 1, 2, 5, 40 if s == "B" and i % 50 == 9 else 1])
    want = plain_gates(rows, 8, q, 40, 300, window, stride)
    got = R.gate_statistics(spark.createDataFrame(rows, "symbol string, idx long, ts long, close double"), 8, q, 40, 300, window, stride).collect()
    assert {(r["symbol"], r["decision"]) for r in got} == set(want)
    for r in got:
        assert np.allclose(tuple(r)[2:], want[r["symbol"], r["decision"]], atol=1e-9), (r, want[r["symbol"], r["decision"]])


def test_thresholds_are_quantiles_of_resampled_maxima(spark):
    import hashlib

    rng = random.Random(2)
    rows = [("A", t, rng.random(), rng.random()) for t in range(23)]
    got = {r["gate"]: r for r in R.maxima_thresholds(spark.createDataFrame(rows, "symbol string, decision long, u double, v double"), {"u": 0.02, "v": 0.3}, 200).collect()}
    for at, (gate, alpha) in ((2, ("u", 0.02)), (3, ("v", 0.3))):
        x, block = [r[at] for r in rows], 5
        tops = []
        for rep in range(200):
            path = []
            for blk in range(5):
                s = int(hashlib.sha256(f"A|{gate}|{rep}|{blk}".encode()).hexdigest()[:15], 16) % 23
                path += [x[(s + k) % 23] for k in range(block)]
            tops.append(max(path[:23]))
        assert got[gate]["threshold"] == float(np.quantile(tops, 1 - alpha, method="higher")) and got[gate]["top"] == max(x) and got[gate]["n"] == 23
