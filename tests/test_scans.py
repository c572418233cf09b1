"""Pieces of a few positions each, so that frames, runs and running values reach over many borders."""

import random

import numpy as np
import pytest

from strandline.operators import intervals, scans, tracks, vectors


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 7)


def values(seed, n):
    rng = random.Random(seed)
    return [rng.choice((-1.5, -0.5, 0.0, 0.5, rng.uniform(-2, 2))) for _ in range(n)]


@pytest.fixture(scope="module")
def series():
    return {f"s{n}": values(n, n) for n in (1, 4, 7, 8, 50, 93)} | {None: values(5, 30)}


@pytest.fixture(scope="module")
def track(spark, series):
    rows = [(a, i, float(v)) for a, vs in series.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "accession string, idx long, score double").repartition(3)


def by_series(df, column):
    out = {}
    for r in df.orderBy("idx").collect():
        out.setdefault(r.accession, []).append(r[column])
    return out


@pytest.mark.parametrize("width", [1, 2, 5, 6, 20])
def test_frames_over_borders(small, track, series, width):
    half = width // 2

    def middle(v, i):
        n = len(v)
        return v[i] if i < half or i >= n - half or n <= width or width <= 1 else sorted(v[i - half : i - half + width])[half]

    want = {a: [middle(v, i) for i in range(len(v))] for a, v in series.items()}
    assert by_series(tracks.smooth_median(track, width), "smoothed") == want
    assert by_series(tracks.alien(track, width), "alien") == {a: [x < 0 for x in v] for a, v in want.items()}
    at = lambda v, i: v[min(len(v) - 1, max(0, i))]
    five = {a: [sorted(at(v, i + k) for k in range(-2, 3))[2] for i in range(len(v))] for a, v in series.items()}
    assert by_series(tracks.smooth5(track), "smoothed") == five
    whole = lambda v: float(np.median(v))
    local = lambda v, i: whole(v) if len(v) <= width or width < 3 else sorted(at(v, i - half + k) for k in range(width))[half]
    got = by_series(tracks.detrend(track, width), "detrended")
    assert got == {a: pytest.approx([v[i] - local(v, i) for i in range(len(v))]) for a, v in series.items()}


def test_runs_and_sums_over_borders(small, track, series):
    got = sorted(((r.accession or "", r.first, r.last) for r in tracks.runs(track.withColumn("alien", track.score < 0)).collect()))
    want = []
    for a, v in series.items():
        i = 0
        while i < len(v):
            j = i
            while j < len(v) and v[j] < 0:
                j += 1
            if j > i:
                want.append((a or "", i, j - 1))
            i = max(j, i + 1)
    assert got == sorted(want)
    long = tracks.runs(track.withColumn("alien", track.score > -9))
    assert sorted((r.accession or "", r.first, r.last) for r in long.collect()) == sorted((a or "", 0, len(v) - 1) for a, v in series.items())
    sums = by_series(tracks.prefix_sums(track), "upto")
    assert sums == {a: pytest.approx(np.cumsum(v).tolist()) for a, v in series.items()}
    found = {r.accession: (r.k, r.n) for r in tracks.cusum(track, ["accession"], "idx", "score").collect()}
    whole = {r.accession: (r.k, r.n) for r in tracks.cusum(track, ["accession"], "idx", "score", short=True).collect()}
    assert found == whole and len(found) == len(series)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_over_borders(spark, small, seed):
    rng = random.Random(seed)

    def some(n):
        out = []
        for _ in range(n):
            s = rng.randrange(120)
            out.append((rng.choice("ab"), s, s + rng.choice((0, 3, 40))))
        return out

    df = lambda rows: spark.createDataFrame(rows, "accession string, start long, end long")
    places = lambda rows: {(a, p) for a, s, e in rows for p in range(s, e + 1)}
    got = lambda f: [tuple(r) for r in f.select("accession", "start", "end").collect()]
    one, two = some(15), some(12)
    one += one[:3]
    assert places(got(intervals.subtract(df(one), df(two)))) == places(one) - places(two)
    for gap in (0, 4):
        own = got(intervals.joined(df(one), gap=gap))
        assert places(one) <= places(own) and len(own) == len(set(own))
        for a in "ab":
            line = sorted((s, e) for x, s, e in own if x == a)
            assert all(s - e - 1 > gap for (_, e), (s, _) in zip(line, line[1:]))
            merged = []
            for s, e in sorted((s, e) for x, s, e in one if x == a):
                if merged and s - merged[-1][1] - 1 <= gap:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            assert line == [tuple(m) for m in merged]
    hit = places(two)
    assert sorted(got(intervals.overlapping(df(one), df(two)))) == sorted(r for r in one if places([r]) & hit)
    points = [(rng.choice("ab"), rng.randrange(170), i) for i in range(80)]
    inside = intervals.points_inside(spark.createDataFrame(points, "accession string, pos long, nth int"), df(two)).collect()
    assert {r.nth: r.inside for r in inside} == {i: (a, p) in hit for a, p, i in points}


def test_one_series_in_many_tasks(spark):
    """A series of ten million rows: its frames are medians of known rows, and no task has more than a piece."""
    from pyspark.sql import functions as F

    n = 10_000_000
    rows = spark.range(n).select(F.lit("x").alias("accession"), F.col("id").alias("idx"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("score"))
    rows = rows.repartition(16, F.floor(F.col("idx") / scans.PIECE))
    found = tracks.smooth_median(rows, 401)
    assert found.groupBy().agg(F.count("*"), F.sum("idx")).first() == (n, n * (n - 1) // 2)
    some = {r.idx: r.smoothed for r in found.where(F.col("idx").isin(5_000_000, 65_536, 65_535, 9_999_799)).collect()}
    for i, v in some.items():
        assert v == sorted((j * 7919) % 1009 for j in range(i - 200, i + 201))[200]


def test_kth_smallest_of_frames():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300):
        codes = rng.integers(0, rng.choice([1, 3, 50, 1000]), n)
        low = rng.integers(0, n, 60)
        high = np.minimum(n, low + 1 + rng.integers(0, n, 60))
        k = rng.integers(0, high - low)
        assert scans.kth_smallest(codes, low, high, k).tolist() == [int(np.sort(codes[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


@pytest.mark.parametrize("tile,w,dw", [(10, 35, 5), (4, 4, 3), (6, 2, 1), (3, 50, 7)])
def test_pooling_over_pieces(spark, monkeypatch, tile, w, dw):
    monkeypatch.setattr(vectors, "TILES", 5)
    rng = np.random.default_rng(w)
    there = {a: sorted(rng.choice(60, 45, replace=False).tolist()) for a in ("p", "q")}
    vec = {(a, t): rng.normal(size=3).tolist() for a, ts in there.items() for t in ts}
    tiles = spark.createDataFrame([(a, t, v) for (a, t), v in vec.items()] + [("p", 99, None)], "accession string, tile_idx long, vec array<double>")
    windows = [(a, i, i * dw) for a in ("p", "q", "none") for i in range(60 * tile // dw)]
    got = {(r.accession, r.win_idx): r.vec for r in vectors.pool_vectors(tiles, spark.createDataFrame(windows, "accession string, win_idx long, start long"), tile, w).collect()}
    want = {}
    for a, i, s in windows:
        parts = [(min(s + w, (t + 1) * tile) - max(s, t * tile), vec[a, t]) for t in range(s // tile, (s + w - 1) // tile + 1) if (a, t) in vec]
        if parts:
            want[a, i] = pytest.approx(np.average([v for _, v in parts], axis=0, weights=[x for x, _ in parts]).tolist())
    assert got == want
