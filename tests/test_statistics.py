import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import evaluate


def test_rates(spark):
    rows = [(8, 2, 5, 5), (0, 0, 7, 0), (0, 3, 0, 4)]
    got = evaluate.rates(spark.createDataFrame(rows, "TP long, FP long, TN long, FN long")).collect()
    r = got[0]
    assert (r.precision, r.accuracy) == (80, 65) and r.recall == pytest.approx(800 / 13) and r.f1 == pytest.approx(2 * 80 * (800 / 13) / (80 + 800 / 13))
    assert r.mcc == pytest.approx((40 - 10) / math.sqrt(10 * 13 * 7 * 10))
    assert [(x.precision, x.recall, x.f1, x.mcc) for x in got[1:]] == [(0, 0, 0, 0), (0, 0, 0, -1)]


def test_auc_against_all_pairs(spark):
    rng = random.Random(51)
    rows = [(g, rng.randrange(8) / 2, rng.random() < 0.4) for g in "pq" for _ in range(30)] + [("r", 1.0, True), ("r", 2.0, False)]
    got = {r.g: r for r in evaluate.auc(spark.createDataFrame(rows, "g string, score double, positive boolean"), ["g"]).collect()}
    for g in "pq":
        a, b = ([s for h, s, p in rows if h == g and p == side] for side in (True, False))
        assert got[g].auc == pytest.approx(sum((x > y) + (x == y) / 2 for x in a for y in b) / (len(a) * len(b)))
    assert got["r"].auc is None and (got["r"].n_pos, got["r"].n_neg) == (1, 1)


@pytest.mark.parametrize("zeros", ["wilcox", "zsplit"])
def test_signed_ranks(spark, zeros):
    d = [3.0, -1.0, 0.0, 2.0, 2.0, -2.0, 0.0, 5.0, -7.0, 4.0]
    w = evaluate.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double"), zeros).first()
    used = [x for x in d if x or zeros == "zsplit"]
    rank = lambda x: statistics.mean(i for i, y in enumerate(sorted(map(abs, used)), 1) if y == abs(x))
    half = sum(rank(x) for x in used if not x) / 2
    up, down = (half + sum(rank(x) for x in used if s * x > 0) for s in (1, -1))
    k, ties = len(used), sum(m**3 - m for m in (sum(abs(y) == v for y in used) for v in set(map(abs, used))))
    z = (min(up, down) - k * (k + 1) / 4) / math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48)
    assert (w.w_plus, w.w_minus, w.n, w.wins) == (up, down, 10, 5) and w.z == pytest.approx(z)
    p = spark.createDataFrame([(1.96,), (0.0,), (None,)], "z double").select(evaluate.normal_p(F.col("z"))).collect()
    assert p[0][0] == pytest.approx(0.05, abs=1e-4) and p[1][0] == 1 and p[2][0] is None


def test_exact_tests_against_counting(spark):
    a, b, c, d = 4, 2, 1, 6
    n, row, col = a + b + c + d, a + b, a + c
    tables = [sum(i < row for i in picked) for picked in itertools.combinations(range(n), col)]
    t = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long")
    assert t.select(evaluate.fisher_greater(*map(F.col, "abcd"))).first()[0] == pytest.approx(sum(x >= a for x in tables) / len(tables))
    got = [r[0] for r in spark.createDataFrame([(2, 9), (0, 0), (3, 6)], "k long, n long").select(evaluate.binomial_two_sided(F.col("k"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(2 * sum(math.comb(9, i) for i in range(3)) / 2**9) and (got[1] is None or math.isnan(got[1])) and got[2] == 1
    ratio = spark.createDataFrame([(4.0, 2.0, 1.0, 6.0), (1.0, 0.0, 1.0, 1.0)], "a double, b double, c double, d double").select(evaluate.odds_ratio(*map(F.col, "abcd"))).collect()
    assert [r[0] for r in ratio] == [12.0, math.inf]


def test_bootstrap(spark):
    rng = random.Random(52)
    d = [(i, rng.gauss(2, 1)) for i in range(400)]
    r = evaluate.bootstrap(spark.createDataFrame(d, "key long, d double"), 300).first()
    mean, error = statistics.mean(x for _, x in d), statistics.stdev(x for _, x in d) / 20
    assert abs(r.mean - mean) < 0.3 * error and abs(r.low - (mean - 1.96 * error)) < 0.5 * error and abs(r.high - (mean + 1.96 * error)) < 0.5 * error


def test_density_and_halves(spark):
    v = [1.0, 1.0, 4.0, 6.0, 9.0]
    h = statistics.stdev(v) * 5**-0.2
    got = {r.x: r.density for r in evaluate.kde(spark.createDataFrame([(x,) for x in [*v, None]], "v double"), "v", 0.0, 10.0, 6).collect()}
    assert sorted(got) == [0, 2, 4, 6, 8, 10]
    assert all(got[x] == pytest.approx(sum(math.exp(-(((x - y) / h) ** 2) / 2) for y in v) / (5 * h * math.sqrt(2 * math.pi))) for x in got)
    rows = [("k", x) for x in (1, 5, 5, 8)] + [("l", 3)]
    half = sorted((r.g, r.v, r.half) for r in evaluate.halves(spark.createDataFrame(rows, "g string, v long"), "v", ["g"]).collect())
    assert half == [("k", 1, 0), ("k", 5, 0), ("k", 5, 0), ("k", 8, 1), ("l", 3, 0)]


def test_folds_and_cross_validation(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(53)] * 2, "unit string")
    dealt = {r.unit: r.fold for r in evaluate.folds(units, "unit", 5, 3).collect()}
    sizes = [list(dealt.values()).count(f) for f in range(5)]
    assert len(dealt) == 53 and sorted(sizes) == [10, 10, 11, 11, 11]
    assert dealt == {r.unit: r.fold for r in evaluate.folds(units, "unit", 5, 3).collect()} != {r.unit: r.fold for r in evaluate.folds(units, "unit", 5, 4).collect()}
    rng = random.Random(53)
    scores = [(u, f, c, rng.gauss(0.3 * (c == "b"), 1)) for u, f in dealt.items() for c in "abc"]
    got = {r.out: r for r in evaluate.cross_validate(spark.createDataFrame(scores, "unit string, fold int, config string, v double"), ["config"], "unit", "v", 5).collect()}
    for f in range(5):
        mean = lambda c, inside, f=f: statistics.mean(v for _, g, x, v in scores if x == c and (g == f) == inside)
        best = max("abc", key=lambda c: mean(c, False))
        assert got[f].config == best and got[f].held_out_mean == pytest.approx(mean(best, True)) and got[f].train_mean == pytest.approx(mean(best, False))


def test_self_comparisons_are_told(spark):
    tests = spark.createDataFrame([("same", 0.001, 1.0), ("equal means", 0.0, 0.4), ("other", 1.2, 1.0), ("no test", 0.0, None)], "name string, mean_diff double, p double")
    assert {r.name for r in evaluate.self_comparisons(tests).where("suspect").collect()} == {"same"}
    assert evaluate.checked_comparisons(tests.where("name <> 'same'")).count() == 3
    with pytest.raises(Exception, match="self-comparison"):
        evaluate.checked_comparisons(tests).collect()


def test_enrichment_by_categories(spark):
    from strandline.plans.configs import CATEGORIES

    genes = [("IS66 family", True), ("putative PHAGE tail", True), ("isx", False), ("toxin", False), (None, True), ("plain", False), ("efflux pump", False)]
    rows = spark.createDataFrame(genes, "product string, inside boolean")
    flagged = rows.select("inside", *[c.alias(n) for n, c in evaluate.flags(F.col("product"), CATEGORIES, ("mobility", "virulence")).items()])
    got = {r.category: r for r in evaluate.enrichment(flagged, [], ["mobility", "any_hgt"]).collect()}
    m = got["mobility"]
    assert (m.marker_in, m.genes_in, m.odds_ratio) == (2, 3, math.inf) and m.rate_in == pytest.approx(200 / 3) and m.rate_out == 0 and m.p == pytest.approx(3 / 21)
    assert (got["any_hgt"].marker_in, got["any_hgt"].odds_ratio) == (2, pytest.approx(2 * 3 / (1 * 1)))
