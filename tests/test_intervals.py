import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import evaluate, intervals


def made(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "accession string, start long, end long")


def cells(rows):
    return {p for s, e in rows for p in range(s, e + 1)}


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_algebra_against_sets_of_positions(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(s, s + rng.randrange(9)) for s in (rng.randrange(120) for _ in range(n))]
    a, b, c = draw(15), draw(12), draw(10)
    da, db, dc = (made(spark, *x) for x in (a, b, c))
    assert cells(spans(intervals.union(da))) == cells(a)
    assert cells(spans(intervals.subtract(da, db))) == cells(a) - cells(b)
    line = spark.createDataFrame([("s", 140), ("empty", 4), ("none", 0)], "accession string, length long")
    got = intervals.complement(da, line)
    assert cells(spans(got.where("accession = 's'"))) == set(range(140)) - cells(a) and spans(got.where("accession = 'empty'")) == [(0, 3)]
    assert spans(intervals.overlapping(da, db)) == sorted((s, e) for s, e in a if cells([(s, e)]) & cells(b))
    roles = intervals.confusion(da.withColumn("role", F.lit("pred")).union(db.withColumn("role", F.lit("pos"))).union(dc.withColumn("role", F.lit("neg"))))
    r, (p, t, f) = roles.first(), (cells(x) for x in (a, b, c))
    assert (r.TP, r.FN, r.FP, r.TN) == (len(p & t), len(t - p), len(p & f), len(f - p))
    points = spark.createDataFrame([("s", i) for i in range(-2, 140)], "accession string, pos long")
    assert {x.pos for x in intervals.points_inside(points, da).where("inside").collect()} == cells(a)


def test_merging_takes_gaps_up_to_the_limit(spark):
    df = made(spark, (3, 6), (9, 9), (14, 20), (15, 16))
    assert spans(intervals.joined(df, gap=1)) == [(3, 6), (9, 9), (14, 20)]
    assert spans(intervals.joined(df, gap=2)) == [(3, 9), (14, 20)]
    assert spans(intervals.joined(df, gap=4)) == [(3, 20)]
    assert spans(intervals.drop_short(df, 4)) == [(3, 6), (14, 20)]


def test_evaluated_clips_and_keeps_empty_series(spark):
    lengths = spark.createDataFrame([("s", 50), ("other", 9)], "accession string, length long")
    found = intervals.evaluated(made(spark, (-5, 9), (45, 80)), made(spark, (5, 14), (48, 90)), made(spark, (0, 4), (20, 29)), lengths)
    got = {r.accession: (r.TP, r.FN, r.FP, r.TN) for r in found.collect()}
    assert got == {"s": (5 + 2, 5, 5, 10), "other": (0, 0, 0, 0)}


@pytest.mark.parametrize("scale", [1, 700])
def test_best_overlap_against_all_pairs(spark, scale):
    rng = random.Random(scale)
    draw = lambda n: [(s * scale, s * scale + rng.randrange(1, 30) * scale) for s in (rng.randrange(200) for _ in range(n))]
    truth, pred = draw(25), draw(20)
    got = {(r.ts, r.te): r for r in intervals.best_overlap(made(spark, *truth), made(spark, *pred)).collect()}
    assert set(got) == set(truth)
    for s, e in truth:
        shared = lambda x, s=s, e=e: min(e, x[1]) - max(s, x[0]) + 1
        best = min((x for x in pred if shared(x) > 0), key=lambda x: (-shared(x), x), default=None)
        r = got[s, e]
        if best is None:
            assert not r.matched and r.jaccard == 0 and r.start_err is None and r.mean_err is None
        else:
            assert (r.signed_start, r.signed_end, r.mean_err) == (best[0] - s, best[1] - e, (abs(best[0] - s) + abs(best[1] - e)) / 2)
            assert r.jaccard == pytest.approx(shared(best) / (max(e, best[1]) - min(s, best[0]) + 1))


def test_boundary_summary(spark):
    matches = intervals.best_overlap(made(spark, (10, 19), (40, 59), (80, 89)), made(spark, (12, 25), (41, 55))).withColumn("of", F.lit("m"))
    lost = intervals.best_overlap(made(spark, (1, 2)), made(spark, (5, 6))).withColumn("of", F.lit("n"))
    got = {r.of: r for r in evaluate.boundary_summary(matches.union(lost), ["of"], (2, 4)).collect()}
    r = got["m"]  # errors of both edges: 2, 6, 1, 4
    assert (r.n_matched, r.mabe, r.within_2, r.within_4, r.median_signed_start) == (2, 3.0, 50.0, 75.0, 1.5)
    assert r.median_jaccard == pytest.approx((8 / 16 + 15 / 20) / 2)
    n = got["n"]
    assert n.n_matched == 0 and n.mabe is None and n.median_jaccard is None and n.within_2 is None


def test_methods_in_one_sweep_equal_each_alone(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["pred_0", "pred_1", "pos", "neg"]), s, s + rng.randrange(9)) for s in (rng.randrange(90) for _ in range(60))]
    rows += [("alone", "pred_1", 3, 5), ("copies", "pos", 0, 9), ("copies", "pos", 0, 9), ("empty", "pos", 4, 3)]
    df = spark.createDataFrame(rows, "accession string, role string, start long, end long")
    got = intervals.by_method(df, [0, 1], intervals.CONFUSION)
    want = set()
    for m in (0, 1):
        own = df.where(F.col("role").isin(f"pred_{m}", "pos", "neg")).withColumn("role", F.when(F.col("role").startswith("pred"), "pred").otherwise(F.col("role")))
        want |= {(r.accession, m, r.TP, r.FN, r.FP, r.TN) for r in intervals.confusion(own).collect()}
    assert {tuple(r) for r in got.select("accession", "method", "TP", "FN", "FP", "TN").collect()} == want and got.count() == len(want)
    preds, truth = df.where("role like 'pred%'").withColumn("method", F.substring("role", 6, 1).cast("long")), df.where("role = 'pos'")
    got = intervals.best_overlap(truth, preds, methods=[0, 1])
    for m in (0, 1):
        alone = intervals.best_overlap(truth, preds.where(F.col("method") == m))
        assert sorted(map(str, got.where(F.col("method") == m).drop("method").collect())) == sorted(map(str, alone.collect()))


def test_all_rows_of_a_scan_are_shuffled_once(spark):
    """Borders are summed by position, then lie by piece; what else is shuffled has a row for each piece. No join."""
    df = made(spark, (3, 9), (5, 12), (200_000, 200_004)).withColumn("role", F.lit("pos"))
    plan = intervals.sweep(df, ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "piece_" in plan
    assert spans(intervals.sweep(df, ["pos"])) == [(3, 4), (5, 9), (10, 12), (13, 199_999), (200_000, 200_004)]


def test_sweep_deals_intervals_not_borders(spark, monkeypatch):
    """Copies are counted before, and borders made after the shuffles; intervals that reach over several pieces, and roles of no count, part segments as before."""
    monkeypatch.setattr(intervals.scans, "PIECE", 16)
    rng = random.Random(31)
    rows = [(a, r, s, s + rng.choice((0, 3, 15, 16, 70))) for a in ("s", None) for r in ("a", "b", "other", None) for s in (rng.randrange(-20, 120) for _ in range(12))]
    rows += [("s", "a", 15, 15)] * 40 + [("one", "b", 31, 31), ("s", "a", 9, 8)]
    got = intervals.sweep(spark.createDataFrame(rows, "accession string, role string, start long, end long"), ["a", "b"])
    want = []
    for series in ("s", None, "one"):
        own = [x for x in rows if x[0] == series and x[3] >= x[2]]
        at = sorted({p for x in own for p in (x[2], x[3] + 1)})
        want += [(series, p, q - 1, *(sum(x[1] == r and x[2] <= p <= x[3] for x in own) for r in ("a", "b"))) for p, q in zip(at, at[1:])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [x for x in lines if "Exchange hashpartitioning" in x]
    assert dealt and not any("pos#" in x for x in dealt)
