import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import detect, robust


def test_kth_values_are_exact(spark, monkeypatch):
    monkeypatch.setattr(robust, "PARTS", 40)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=300), "b": np.round(rng.normal(size=80), 1), "c": np.array([2.0]), "d": np.exp(rng.normal(size=200) * 20), "e": np.zeros(9)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    k = [(g, int(i)) for g, vs in groups.items() for i in {1, len(vs) // 2 + 1, len(vs)}]
    got = {(r.g, r.k): r.kth for r in robust.kth_value(rows, ["g"], "v", spark.createDataFrame(k, "g string, k long")).collect()}
    assert got == {(g, i): float(np.sort(groups[g])[i - 1]) for g, i in k}


@pytest.fixture(scope="module")
def mixed():
    """Two series with a cloud and a fifth of rows far away."""
    rng = np.random.default_rng(5)
    out = {}
    for name, n in (("long", 60_000), ("short", 3_000)):
        x = rng.normal(size=(n, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.5], [0, 0, 0.7]]) + [5, -1, 0]
        x[rng.random(n) < 0.2] += [9, 9, -9]
        out[name] = x
    return out


def test_fit_over_tasks_equals_the_fit_in_one(spark, mixed):
    rows = spark.createDataFrame([(a, i, v.tolist()) for a, x in mixed.items() for i, v in enumerate(x)], "accession string, idx long, x array<double>").repartition(6)
    got = {r.accession: r for r in detect._fit(rows, 0.1, 0.7, 3, 1).collect()}
    assert set(got) == {"long", "short"}
    for a, x in mixed.items():
        where, precision = detect.robust_covariance(x, 0.7, 3)
        z = x - where
        far = np.einsum("ij,jk,ik->i", z, precision, z)
        assert np.allclose(got[a].location, where, atol=1e-3) and np.allclose(got[a].precision, precision, rtol=1e-2, atol=1e-3)
        assert got[a].offset == pytest.approx(np.percentile(-far, 10), rel=1e-2)


def test_all_series_over_tasks(spark, mixed, monkeypatch):
    """The same calls whichever way a series is fitted."""
    x = mixed["short"]
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "accession string, idx long, x array<double>")
    calls = lambda: [r.score < 0 for r in detect.two_stage_envelope(rows, stride=1).orderBy("idx").collect()]
    one = calls()
    monkeypatch.setattr(detect, "FIT_ROWS", 100)
    many = calls()
    assert np.mean(np.array(one) == np.array(many)) > 0.995 and 0.1 < np.mean(one) < 0.3
