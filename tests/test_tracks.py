import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import tracks, vectors


def line(spark, values, name="t"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "accession string, idx long, score double")


def column(df, name):
    return [r[name] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("n,width", [(37, 6), (37, 7), (5, 6), (6, 6), (30, 1)])
def test_smoothing_and_its_sign(spark, n, width):
    rng = random.Random(n * width)
    v = [rng.uniform(-1, 1) for _ in range(n)]
    half = width // 2
    whole = lambda i: width > 1 and n > width and half <= i < n - half
    want = [sorted(v[i - half : i - half + width])[width // 2] if whole(i) else v[i] for i in range(n)]
    df = line(spark, v)
    assert column(tracks.smooth_median(df, width), "smoothed") == want
    assert column(tracks.alien(df, width), "alien") == [x < 0 for x in want]


def test_running_medians_with_replicated_ends(spark):
    rng = random.Random(77)
    v = [rng.uniform(0, 9) for _ in range(23)]
    at = lambda i: v[min(len(v) - 1, max(0, i))]
    assert column(tracks.smooth5(line(spark, v)), "smoothed") == [statistics.median(at(i + k) for k in range(-2, 3)) for i in range(23)]
    got = column(tracks.detrend(line(spark, v), 9), "detrended")
    assert got == pytest.approx([v[i] - statistics.median(at(i + k) for k in range(-4, 5)) for i in range(23)])
    assert column(tracks.detrend(line(spark, v), 40), "detrended") == pytest.approx([x - statistics.median(v) for x in v])


def test_runs_and_projection(spark):
    flags = "..##.#....####"
    df = spark.createDataFrame([("t", i, c == "#") for i, c in enumerate(flags)], "accession string, idx long, alien boolean")
    found = tracks.runs(df)
    assert sorted((r.first, r.last) for r in found.collect()) == [(2, 3), (5, 5), (10, 13)]
    lengths = spark.createDataFrame([("t", 128)], "accession string, length long")
    spans = lambda assign, *more: sorted((r.start, r.end) for r in tracks.project(found, 40, 8, assign, *more).collect())
    assert spans("start") == [(16, 31), (40, 47), (80, 111)] and spans("center") == [(32, 47), (56, 63), (96, 127)]
    assert spans("center", lengths.withColumn("length", F.lit(100).cast("long"))) == [(32, 47), (56, 63), (96, 99)]


def cusum(v):
    n = len(v)
    if n < 4:
        return n // 2
    stat = lambda k: round((k * (n - k) / n) ** 0.5 * abs(sum(v[:k]) / k - sum(v[k:]) / (n - k)), 9)
    return max(range(1, n), key=lambda k: (stat(k), -k))


@pytest.mark.parametrize("seed", range(4))
def test_change_points(spark, seed):
    rng = random.Random(seed)
    v = [rng.gauss(3 * (i > 11), 1) for i in range(rng.choice((3, 4, 26)))]
    assert tracks.cusum(line(spark, v), ["accession"], "idx", "score").first().k == cusum(v)


def test_refinement(spark):
    rng = random.Random(41)
    tile, radius, context, n = 10, 60, 90, 80
    v = [rng.gauss(5 * (22 <= i < 47), 1) for i in range(n)]
    given = [(190, 500), (0, 25), (300, 310), (760, 799), (-30, 40)]
    coarse = spark.createDataFrame([("t", s, e) for s, e in given], "accession string, start long, end long")
    lengths = spark.createDataFrame([("t", n * tile)], "accession string, length long")
    got = sorted((r.start, r.end) for r in tracks.refine(coarse, line(spark, v), tile, radius, context, lengths).collect())
    want = []
    for s, e in given:
        lo, hi = max(0, (s - context) // tile), min(n, (s + radius) // tile + 1)
        lo2, hi2 = max(0, (e - radius) // tile), min(n, (e + context) // tile + 1)
        a = (lo + cusum(v[lo:hi])) * tile if hi - lo >= 4 else s
        b = (lo2 + cusum(v[lo2:hi2])) * tile - 1 if hi2 - lo2 >= 4 else e
        a, b = (s, e) if b <= a else (a, b)
        want.append((max(0, a), min(n * tile - 1, b)))
    assert got == sorted(want) and (220, 469) in got


def test_pooling_is_a_weighted_mean(spark):
    rng = np.random.default_rng(8)
    tile, w, e = 12, 31, rng.normal(size=(14, 5))
    tiles = spark.createDataFrame([("t", i, v.tolist()) for i, v in enumerate(e)], "accession string, tile_idx long, vec array<double>")
    starts = [0, 5, 12, 40, 137, 160]
    win = spark.createDataFrame([("t", i, s) for i, s in enumerate(starts)], "accession string, win_idx long, start long")
    got = {r.win_idx: r.vec for r in vectors.pool_vectors(tiles, win, tile, w).collect()}
    for i, s in enumerate(starts):
        held = [min(13, p // tile) for p in range(s, s + w) if p < 14 * tile]
        assert got[i] == pytest.approx(e[held].mean(axis=0).tolist())
    long = vectors.pool_windows(tiles, win, tile, w).where("win_idx = 3").orderBy("dim").collect()
    assert [r.value for r in long] == pytest.approx(got[3])
    with pytest.raises(ValueError):
        vectors.pool_vectors(tiles, win, tile, w, step=tile // 2)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.1]), ([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    unit = [r[0] for r in df.select(vectors.l2(F.col("a"))).collect()]
    assert unit == [[pytest.approx(0.6), pytest.approx(0.8)], [0, 0]]
    guard = vectors.cosine_guard(df.limit(1), "a", "b").first()
    assert guard.n == 1 and guard.lowest == pytest.approx((9 + 16.4) / (5 * (9 + 16.81) ** 0.5)) and guard.accepted
    assert not vectors.cosine_guard(df, "a", "b").first().accepted and not vectors.cosine_guard(df.limit(0), "a", "b").first().accepted
