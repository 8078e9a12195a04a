"""Nested reports: what labels tell, JSON both ways."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import reports as R


def wide(spark, seed=1):
    rng, rows = random.Random(seed), []
    for s in "ABCDEFGH":
        for i in range(120):
            a, b = rng.randrange(2), i // 10 % 2
            rows.append((s, i, (1.0 if rng.random() < (0.9 if a else 0.1) else -1.0), a, b, -1 if i < 5 else a))
    return spark.createDataFrame(rows, "symbol string, idx long, fwd double, knows int, blind int, short int")


@pytest.fixture(scope="module")
def report(spark):
    return R.task_report(wide(spark), ["knows", "blind", "short"], "2-state", 2, 10, 1, 10.0, 200, 300)


def test_a_report_holds_what_was_measured(spark, report):
    r = report.collect()[0]
    assert (r["task"], r["states"], set(r["detectors"]), set(r["pairs"])) == ("2-state", 2, {"knows", "blind", "short"}, {"knows__blind", "knows__short", "blind__short"})
    rows = [x for x in wide(spark).collect() if x["short"] >= 0]
    blind = r["detectors"]["blind"]
    assert blind["n"] == len(rows) == 920 and [(o["state"], o["n"]) for o in blind["occupancy"]] == [(k, sum(x["blind"] == k for x in rows)) for k in (0, 1)]
    assert blind["transitions"] == [[8 * (4 + 9 * 5), 8 * 6], [8 * 5, 8 * 9 * 6]]
    assert {(x["state"], x["runs"], x["longest"]) for x in blind["runs"]} == {(0, 48, 10), (1, 48, 10)}
    assert r["pairs"]["knows__short"]["nmi"] == pytest.approx(1.0) and r["pairs"]["knows__blind"]["nmi"] < 0.05


def test_p_and_interval_tell_knowing_from_blind_labels(report):
    d = report.collect()[0]["detectors"]
    knows, blind = d["knows"]["information"], d["blind"]["information"]
    assert knows["p"] == 1 / 301 and blind["p"] > 0.02
    assert 0 < knows["lo"] <= knows["mi"] <= knows["hi"] and knows["mi"] == pytest.approx(0.37, abs=0.08) and blind["mi"] < 0.01
    assert knows["net_bps"] == pytest.approx(1e4 * knows["mi"] - 10)


def test_json_both_ways_and_checked(spark, report):
    lines = R.as_json(report)
    assert R.from_checked_json(lines).collect() == report.collect()
    for bad in ("{", '{"task": "x"}', '{"task": "x", "states": "two", "detectors": {}, "pairs": {}}', None):
        with pytest.raises(Exception, match="(?i)malformed|not a report"):
            R.from_checked_json(spark.createDataFrame([(bad,)], "json string")).collect()


def test_disposition_over_tasks(report):
    assert R.disposition(report).first()["classification"] == "mixed_family_structure"
    failed = report.withColumn("detectors", F.transform_values("detectors", lambda k, v: v.withField("status", F.lit("instrument_failure"))))
    assert R.disposition(failed).first()["classification"] == "instrument_failure"
