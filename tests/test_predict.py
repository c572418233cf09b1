import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import detect, predict


def series(spark, x, name="s", column="x"):
    return spark.createDataFrame([(name, i, v.tolist()) for i, v in enumerate(x)], f"accession string, idx long, {column} array<double>")


def test_components_equal_those_of_a_decomposition(spark):
    rng = np.random.default_rng(61)
    x, y = rng.normal(size=(45, 5)) @ rng.normal(size=(5, 5)), rng.normal(size=(45, 3))
    df = spark.createDataFrame([("s", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "accession string, idx long, x array<double>, y array<double>")
    got = detect.pca_all(df, {"x": 3, "y": 9}).orderBy("idx").collect()
    for name, full, d in (("x", x, 3), ("y", y, 3)):
        u, s, _ = np.linalg.svd(full - full.mean(axis=0), full_matrices=False)
        assert np.abs([r[name] for r in got]) == pytest.approx(np.abs(u[:, :d] * s[:d]), abs=1e-6)


def plain_envelope(x, contamination, support, stride, seed=3):
    def fitted(rows, c, h):
        some = rows[::stride]
        where, precision = detect.robust_covariance(some, h, seed)
        far = lambda z: -np.einsum("ij,jk,ik->i", z - where, precision, z - where)
        return lambda z: far(z) - np.percentile(far(some), 100 * c)

    first = fitted(x, contamination[0], support[0])(x)
    inside = first >= 0
    score = first.copy()
    if inside.sum() > x.shape[1] + 2:
        score[inside] = fitted(x[inside], contamination[1], support[1])(x[inside])
    return score


@pytest.mark.parametrize("stride", [1, 3])
def test_envelope_against_numpy(spark, stride):
    rng = np.random.default_rng(62)
    x = rng.normal(size=(150, 3))
    x[40:55] += 6
    got = [r.score for r in detect.two_stage_envelope(series(spark, x), stride=stride).orderBy("idx").collect()]
    want = plain_envelope(x, (0.15, 0.05), (0.75, 0.9), stride)
    assert got == pytest.approx(want.tolist(), abs=1e-6) and all(v < 0 for v in got[40:55])


def test_envelope_takes_all_rows_of_a_long_series(spark, monkeypatch):
    """Beyond what one task fits, all rows are fitted over all tasks: no sample, and nearly the same calls."""
    rng = np.random.default_rng(63)
    x = np.vstack([rng.normal(size=(200, 2)), rng.normal(size=(20, 2)) + 9])
    calls = lambda: np.array([r.score < 0 for r in detect.two_stage_envelope(series(spark, x), stride=1).orderBy("idx").collect()])
    one = calls()
    monkeypatch.setattr(detect, "FIT_ROWS", 40)
    many = calls()
    assert many[200:].all() and (one == many).mean() >= 0.93


def plain_islands(scores, width, w, dw, gap, least, length, assign):
    n, half = len(scores), width // 2
    smooth = [sorted(scores[i - half : i - half + width])[width // 2] if n > width > 1 and half <= i < n - half else scores[i] for i in range(n)]
    shift = 0 if assign == "start" else w // 2 - dw // 2
    covered = {p for i, v in enumerate(smooth) if v < 0 for p in range(i * dw + shift, (i + 1) * dw + shift)}
    runs = []
    for p in sorted(q for q in covered if 0 <= q < length):
        if runs and p - runs[-1][1] - 1 <= gap:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return [(s, e) for s, e in runs if e - s + 1 >= least]


def change(v):
    n = len(v)
    stat = [round((k * (n - k) / n) ** 0.5 * abs(sum(v[:k]) / k - sum(v[k:]) / (n - k)), 9) for k in range(1, n)]
    return n // 2 if n < 4 else stat.index(max(stat)) + 1


@pytest.mark.parametrize("ready", [True, False])
def test_whole_predictor_against_numpy(spark, ready):
    """Vectors with two planted stretches, through every stage, beside the same stages over arrays."""
    rng = np.random.default_rng(64)
    tile, w, dw, d, width, gap, least, radius, context = 10, 60, 10, 3, 5, 20, 30, 60, 90
    e = rng.normal(size=(180, 4))
    for a, b in ((50, 74), (120, 141)):
        e[a:b, 0] += 7
    length = 180 * tile
    tiles = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(e)], "accession string, tile_idx long, vec array<double>")
    lengths = spark.createDataFrame([("s", length)], "accession string, length long")
    got = sorted((r.start, r.end) for r in predict.by_vectors(tiles, lengths, tile, w, dw, d, width, gap, least, ready=ready, refine=(radius, context), stride=2).collect())

    if ready:
        z = e[:, :d]
    else:
        unit = e / np.linalg.norm(e, axis=1, keepdims=True)
        u, s, _ = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)
        z = u[:, :d] * s[:d]
        z *= np.sign([r[np.abs(r).argmax()] for r in np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)[2][:d]])
    pooled = np.array([z[i : i + w // tile].mean(axis=0) for i in range(max(0, -(-(length - w) // dw)))])
    coarse = plain_islands(plain_envelope(pooled, (0.15, 0.05), (0.75, 0.9), 2).tolist(), width, w, dw, gap, least, length, "center")
    centre = np.median(z, axis=0)
    far = np.linalg.norm((z - centre) / (np.median(np.abs(z - centre), axis=0) * 1.4826 + 1e-8), axis=1)
    signal = [statistics.median(far[min(179, max(0, i + k))] for k in range(-2, 3)) for i in range(180)]
    moved = []
    for s, t in coarse:
        lo, hi, lo2, hi2 = max(0, (s - context) // tile), min(180, (s + radius) // tile + 1), max(0, (t - radius) // tile), min(180, (t + context) // tile + 1)
        a = (lo + change(signal[lo:hi])) * tile if hi - lo >= 4 else s
        b = (lo2 + change(signal[lo2:hi2])) * tile - 1 if hi2 - lo2 >= 4 else t
        moved.append((s, t) if b <= a else (a, min(length - 1, b)))
    want = []
    for s, t in sorted(moved):
        if want and s - want[-1][1] - 1 <= gap:
            want[-1] = (want[-1][0], max(want[-1][1], t))
        else:
            want.append((s, t))
    want = [(s, t) for s, t in want if t - s + 1 >= least]
    assert got == want
    assert not ready or all(any(s <= 10 * a + 30 and 10 * b - 30 <= t for s, t in got) for a, b in ((50, 74), (120, 141)))


def test_composition_matrix_and_baseline(spark):
    rng = random.Random(65)
    plain, odd = ("".join(rng.choices("ATCG", weights, k=n)) for weights, n in (((30, 30, 20, 20), 4000), ((5, 5, 45, 45), 600)))
    seq = plain[:1500] + odd + plain[1500:]
    df = spark.createDataFrame([("s", seq)], "accession string, seq string")
    features = S.window_features(df, "seq", "accession", 200, 50)
    rows = predict.composition_matrix(features).orderBy("win_idx").collect()
    raw = features.orderBy("win_idx").collect()
    assert len(rows[0].vec) == 11 and [r.vec[0] for r in rows] == [r.gc for r in raw]
    aa = np.array([r.aa for r in raw])
    u, s, _ = np.linalg.svd(aa - aa.mean(axis=0), full_matrices=False)
    assert np.abs([r.vec[7:9] for r in rows]) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-6)
    assert len(predict.composition_matrix(features, entropy=False, dinuc=False).first().vec) == 6
    found = [(r.start, r.end) for r in predict.by_composition(df, 200, 50, 5, 100, "center").collect()]
    assert any(s <= 1600 and e >= 2000 for s, e in found)


def test_blocks_are_joined_by_window(spark):
    block = lambda rows: spark.createDataFrame(rows, "accession string, win_idx long, vec array<double>")
    both = predict.window_matrix([block([("s", 0, [1.0]), ("s", 1, [2.0])]), block([("s", 0, [5.0, 6.0]), ("t", 1, [9.0])])]).collect()
    assert [tuple(r) for r in both] == [("s", 0, [1.0, 5.0, 6.0])]
    with pytest.raises(ValueError):
        predict.window_matrix([])


def test_detrended_tiles(spark):
    rng = np.random.default_rng(66)
    x = rng.normal(size=(20, 3))
    tiles = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "accession string, tile_idx long, vec array<double>")
    got = [r.vec for r in predict.tile_matrix(tiles, 2, ready=True, detrend=5).orderBy("tile_idx").collect()]
    want = [[x[i, c] - np.median([x[min(19, max(0, i + k)), c] for k in range(-2, 3)]) for c in range(2)] for i in range(20)]
    assert np.array(got) == pytest.approx(np.array(want))


def test_no_query_replaces_another():
    from strandline.plans import catalogue, reports

    assert not set(catalogue.queries()) & set(reports.queries())
    assert all(f"q_project_{m}{a}" in catalogue.queries() | reports.queries() for m in ("", "narrow_") for a in ("start", "center"))


def test_steps_are_written_to_the_shared_folder_only(spark):
    from types import SimpleNamespace

    from strandline.sources import staging

    assert F.col("x") is not None and staging.cut(spark.range(3)).count() == 3
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        staging.shared_dir(cluster)
