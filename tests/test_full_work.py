"""Queries do the whole of the study's work: its starts, steps and resamples, and all pairs."""

import inspect

import numpy as np
import pandas as pd
import pytest

from tidewright.functions import neighbours
from tidewright.operators import information, markov
from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["markov_fits", "markov_states"])
def test_markov_fits_take_all_starts(spark, monkeypatch, name):
    real, seen = markov.restarts, []

    def noted(*args, **settings):
        b = inspect.signature(real).bind(*args, **settings)
        b.apply_defaults()
        seen.append(tuple(b.arguments[k] for k in ("starts", "steps", "retry")))
        return real(*args, **settings)

    monkeypatch.setattr(markov, "restarts", noted)
    QUERIES[name](spark, SF)
    assert seen == [(10, 100, 200)]


def test_neighbour_information_takes_all_pairs(spark):
    x, y = neighbours.gaussian_pairs(50_300, 0.3, 7)
    d = spark.createDataFrame(pd.DataFrame({"symbol": "S", "idx": np.arange(len(x)), "x": x, "y": y}))
    r = information.information(d, reps=2).first()
    assert r["n"] == len(x) and r["mi"] == pytest.approx(neighbours.ksg(x, y), abs=1e-12) and r["se"] > 0


def test_neighbour_information_takes_all_resamples(spark, monkeypatch):
    real, seen = information.information, []

    def noted(*args, **settings):
        b = inspect.signature(real).bind(*args, **settings)
        b.apply_defaults()
        seen.append(b.arguments["reps"])
        return real(*args, **settings)

    monkeypatch.setattr(information, "information", noted)
    QUERIES["neighbour_information"](spark, SF)
    assert seen == [500]
