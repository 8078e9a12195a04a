"""Null paths of a lot are drawn at once: the same however many are asked for, and of the law that their method says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import nulls
from tidewright.operators.variance_ratio import kernel
from tidewright.plans import simulation
from tidewright.plans.registry import QUERIES

SPECS = [("circular-block", 10), ("moving-block", 20), ("stationary-block", 20), ("wild", None), ("student-t", None), ("rank-sign", None)]


def centred(n=130):
    x = np.random.default_rng(4).normal(size=n)
    return x - x.mean()


@pytest.mark.parametrize("method, block", SPECS)
def test_paths_however_dealt(method, block):
    x = centred()
    whole = np.concatenate([p for _, p in nulls.null_paths(method, x, block, [43, 9], 0, 120, 120)])
    parts = [(k, p) for a, z in ((0, 7), (7, 60), (60, 120)) for k, p in nulls.null_paths(method, x, block, [43, 9], a, z, 120, held=700)]
    assert whole.shape == (120, 130) and [k for k, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts]])[:-1].tolist()
    assert (np.concatenate([p for _, p in parts]) == whole).all() and len(np.unique(whole[:, 1:], axis=0)) == 120


def test_what_paths_keep():
    x = centred()
    get = lambda m, b=None: np.concatenate([p for _, p in nulls.null_paths(m, x, b, [1], 0, 400, 400)])
    assert np.allclose(np.abs(get("wild")), np.abs(x)) and abs((get("wild") > 0).mean() - 0.5) < 0.01
    assert np.allclose(np.sort(np.abs(get("rank-sign")), 1), np.sort(np.abs(x)))
    t = get("student-t")
    assert t.std() == pytest.approx(x.std(ddof=1), rel=0.03) and abs(t.mean()) < 0.02
    place = {v: i for i, v in enumerate(x)}
    for method, block, share in (("circular-block", 10, 0.9), ("moving-block", 20, 0.95), ("stationary-block", 20, 0.95)):
        at = np.vectorize(place.get)(get(method, block))
        goes_on = (np.diff(at, axis=1) == 1) | (np.diff(at, axis=1) == 1 - len(x))
        assert abs(goes_on.mean() - share) < 0.012 and abs(at.mean() - 64.5) < 3  # blocks go on, all rows are taken alike
        assert method != "moving-block" or (np.diff(at, axis=1) != 1 - len(x)).mean() > 0.999


def test_student_law():
    x = centred(2_000) ** 3
    df = nulls.degrees_of_freedom(x - x.mean())
    t = np.concatenate([p for _, p in nulls.null_paths("student-t", x - x.mean(), None, [2], 0, 200, 200)]).ravel()
    want = np.random.default_rng(0).standard_t(df, len(t)) / np.sqrt(df / (df - 2)) * x.std(ddof=1)
    ps = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    assert np.quantile(t, ps) == pytest.approx(np.quantile(want, ps), rel=0.03, abs=0.02 * x.std())


def test_cells_share_squares():
    paths = np.random.default_rng(1).normal(0, 0.01, (30, 250))
    paths[3] = 0
    cells = [(60, 2), (60, 5), (40, 3), (300, 2), (60, 60)]
    for got, (w, q) in zip(nulls.cell_medians(paths, cells), cells):
        assert np.allclose(got, nulls.medians_z(paths, w, q), rtol=1e-9, atol=1e-10, equal_nan=True)
    y = np.exp(np.cumsum(paths[:, :60], axis=1))
    assert all(np.allclose(z, kernel(y, q)[1], rtol=1e-9, equal_nan=True) for q, z in zip((2, 5, 15), nulls.kernel_z(y, (2, 5, 15))))


def test_a_series_moves_once_a_share(spark):
    """A row for each specification took every series along."""
    d = spark.createDataFrame([("S", i, float(np.sin(i))) for i in range(200)], "symbol string, idx long, r double")
    out = nulls.programme(d, "r", [(60, 2)], SPECS, 100)
    rows = out.groupBy("method").count().collect()
    assert len(rows) == len(SPECS) and all(r["count"] == 101 for r in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate") == 2 and "size(" in plan


def test_by_block_draws_what_has_a_block(spark, monkeypatch):
    real, seen = nulls.programme, []
    monkeypatch.setattr(nulls, "programme", lambda df, value, cells, specs, *a, **k: seen.extend(specs) or real(df, value, cells, specs, *a, **k))
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["null_by_block"](spark, sf).collect()))
    assert seen == [("circular-block", 10), ("circular-block", 20), ("moving-block", 20), ("stationary-block", 20)]
    monkeypatch.undo()
    report = nulls.by_block(nulls.null_report(simulation.paths(spark, sf)))
    want = report.select("symbol", "method", "W", "q", F.to_json("p_by_block"), F.to_json("holm_by_block"))
    assert got == sorted(map(tuple, want.collect()))
