"""Rates, summaries, rank and paired statistics, selection of configurations."""

from __future__ import annotations

import functools
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import scans


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy (in percent) and mcc from TP, FP, TN, FN; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = 100 * safe(tp, tp + fp), 100 * safe(tp, tp + fn)
    mcc = safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.withColumns({"precision": p, "recall": r, "f1": safe(2 * p * r, p + r), "accuracy": 100 * safe(tp + tn, tp + tn + fp + fn), "mcc": mcc})


def boundary_summary(matches: DataFrame, by: list[str], limits: tuple[int, ...] = (1000, 2500, 5000)) -> DataFrame:
    """n_matched, mabe, medians and shares within ``limits`` of both edges' errors, of the rows of ``best_overlap``; null where none matched."""
    # both edges of each row: what is of the row itself counts at the first
    edges = matches.withColumn("err_", F.explode(F.array(*[F.struct(F.lit(i).alias("edge"), F.col(c).alias("err")) for i, c in enumerate(("start_err", "end_err"))])))
    m, err = F.col("matched") & (F.col("err_.edge") == 0), F.when(F.col("matched"), F.col("err_.err"))
    medians = [F.median(F.when(m, F.col(c))).alias(f"median_{c}") for c in ("jaccard", "signed_start", "signed_end")]
    within = [F.avg(F.when(err <= n, 100.0).when(err > n, 0.0)).alias(f"within_{n}") for n in limits]
    return edges.groupBy(*by).agg(F.sum(m.cast("long")).alias("n_matched"), *medians, F.median(err).alias("mabe"), *within)


def auc(scored: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Mann-Whitney AUC of ``score`` by ``positive`` with average ranks; null with fewer than ``least`` on a side."""
    level = scored.groupBy(*by, "score").agg(F.count("*").alias("m"), F.sum(F.col("positive").cast("long")).alias("pos"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = level.withColumn("rank", before + (F.col("m") + 1) / 2)
    n1, n0 = F.sum("pos"), F.sum(F.col("m") - F.col("pos"))
    u = F.sum(F.col("pos") * F.col("rank")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(n1.alias("n_pos"), n0.alias("n_neg"), F.when((n1 >= least) & (n0 >= least), u / (n1 * n0)).alias("auc"))


def paired(values: DataFrame, key: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """(key, x, y, d) of two methods where both have a value."""
    each = values.where(F.col(method).isin(a, b)).groupBy(key).agg(*[F.max(F.when(F.col(method) == m, F.col(value))).alias(n) for m, n in ((a, "x"), (b, "y"))])
    return each.where("x is not null and y is not null").withColumn("d", F.col("x") - F.col("y"))


def wilcoxon(diffs: DataFrame, zeros: str = "wilcox") -> DataFrame:
    """Signed ranks of ``d``: n, wins, mean, w_plus, w_minus and the tie-corrected normal z; p by :func:`normal_p`, or of few
    differences without ties and zeros by :func:`signed_rank_p`. Ranks are counted in ranges of the absolute differences.

    ``zeros``: ``wilcox`` drops zero differences, ``zsplit`` ranks them and halves their ranks to both sides.
    """
    rows = diffs.where("d is not null").withColumn("a", F.abs("d"))
    used = rows.where("d <> 0") if zeros == "wilcox" else rows
    level = used.groupBy("a").agg(F.count("*").alias("m"), F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down"))
    level = scans.scanned(scans.ranges(level, "a"), [], "a", ["a"], {"before_": ("sum", "m", 1)})
    r = level.withColumn("r", F.coalesce("before_", F.lit(0)) + (F.col("m") + 1) / 2)
    nil = F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("r") * F.col("m"))), F.lit(0.0)) / 2
    n = F.sum("m")
    w = r.agg((F.sum(F.col("r") * F.col("up")) + nil).alias("w_plus"), (F.sum(F.col("r") * F.col("down")) + nil).alias("w_minus"), n.alias("n_used"), F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("ties"))
    k = F.col("n_used").cast("double")
    z = F.try_divide(F.least("w_plus", "w_minus") - k * (k + 1) / 4, F.sqrt(k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48))
    whole = rows.agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.avg("d").alias("mean_diff"))
    return whole.join(w, F.lit(True)).select("n", "wins", "mean_diff", "w_plus", "w_minus", z.alias("z"))  # one row each


def _normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def _ln_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return math.exp(top) * math.fsum(math.exp(t - top) for t in terms)


def _fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Upper hypergeometric tail of 2 x 2 tables: P(X >= a) with the margins fixed."""
    out = []
    for x, y, u, v in zip(a, b, c, d, strict=True):
        row, col, n = x + y, x + u, x + y + u + v
        whole = _ln_choose(n, col)
        out.append(min(1.0, _log_sum([_ln_choose(row, i) + _ln_choose(n - row, col - i) - whole for i in range(x, min(row, col) + 1)])))
    return pd.Series(out)


def _binomial_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided test of k of n at 1/2; null for n = 0."""
    return pd.Series([None if m == 0 else min(1.0, 2 * _log_sum([_ln_choose(m, i) - m * math.log(2) for i in range(min(j, m - j) + 1)])) for j, m in zip(k, n, strict=True)])


#: Most differences for which the distribution of signed ranks is counted out.
COUNTED = 50


@functools.cache
def _rank_sums(n: int) -> list[int]:
    """In how many ways signs give each sum of positive ranks 1 to ``n`` or a smaller one."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [a + b for a, b in itertools.zip_longest(ways, [0] * r + ways, fillvalue=0)]
    return list(itertools.accumulate(ways))


def _signed_rank_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact tail of the smaller rank sum of n differences without ties; null beyond ``COUNTED``, for none, and for sums that are no whole number."""
    none = lambda x, m: pd.isna(x) or pd.isna(m) or not 0 < m <= COUNTED or x != int(x)
    return pd.Series([None if none(x, m) else min(1.0, 2 * _rank_sums(int(m))[int(x)] / 2 ** int(m)) for x, m in zip(w, n, strict=True)], dtype=float)


def signed_rank_p(w: Column, n: Column) -> Column:
    return F.pandas_udf(_signed_rank_p, "double")(w, n)


def normal_p(z: Column) -> Column:
    return F.pandas_udf(_normal_p, "double")(z)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.pandas_udf(_fisher_greater, "double")(a, b, c, d)


def binomial_two_sided(k: Column, n: Column) -> Column:
    return F.pandas_udf(_binomial_two_sided, "double")(k, n)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / F.nullif(b * c, F.lit(0)))


def bootstrap(diffs: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of ``d`` and its 2.5 and 97.5 percentiles over resamples, by Poisson weights: each row is drawn Poisson(1) times
    in each resample, from a hash of its key, so that no row has to be looked up by number."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "b"), 11) + 0.5) / float(1 << 53)
    times, low = F.lit(0), 0.0
    for k in range(8):
        low += math.exp(-1) / math.factorial(k)
        times = times + (u > low).cast("int")
    each = diffs.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("t", times)
    means = each.groupBy("b").agg(F.try_divide(F.sum(F.col("t") * F.col("d")), F.sum("t")).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def best_config(scores: DataFrame, objective: Column, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The configuration (keys) with the largest objective, of equals the first by keys; one for each ``by``."""
    line = Window.partitionBy(*(by or [F.lit(1)])).orderBy(objective.desc(), *keys)
    return scores.withColumn("nth_", F.row_number().over(line)).where("nth_ = 1").drop("nth_")


def folds(units: DataFrame, unit: str, n: int, seed: int = 0) -> DataFrame:
    """(unit, fold): distinct units dealt into ``n`` folds of equal size (one more or less), in the order of a seeded hash.

    Units are numbered within hash ranges, and ranges by running counts of a row each, so that no task takes them all.
    """
    ranges = 1024
    rows = units.select(unit).distinct().withColumn("h_", F.xxhash64(F.lit(seed), unit)).withColumn("r_", F.shiftrightunsigned("h_", 54))
    inside = F.row_number().over(Window.partitionBy("r_").orderBy("h_", unit))
    sizes = rows.groupBy("r_").agg(F.count("*").alias("m_"))
    ahead = sizes.select("r_", F.coalesce(F.sum("m_").over(Window.orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))  # 1024 rows
    assert ranges == 1 << 10
    return rows.withColumn("i_", inside).join(F.broadcast(ahead), "r_").select(unit, ((F.col("i_") - 1 + F.col("ahead_")) % n).cast("int").alias("fold"))


def self_comparisons(tests: DataFrame, difference: str = "mean_diff", p: str = "p", digits: int = 2) -> DataFrame:
    """``tests`` with ``suspect``: a difference that rounds to 0 beside a p-value of 1, as of a method held against itself."""
    return tests.withColumn("suspect", F.coalesce((F.round(difference, digits) == 0) & (F.col(p) >= 1 - 1e-9), F.lit(False)))


def checked_comparisons(tests: DataFrame, **columns) -> DataFrame:
    """``tests``; reading a row that compares a method with itself raises an error."""
    found = self_comparisons(tests, **columns)
    return found.where(F.when(F.col("suspect"), F.raise_error(F.lit("self-comparison: a method held against itself"))).otherwise(F.lit(True)).cast("boolean")).drop("suspect")


def flags(text: Column, categories: dict[str, list[str]], any_of: tuple[str, ...] = ()) -> dict[str, Column]:
    """A boolean for each category whose patterns (case does not count) a text matches, and ``any_hgt`` of those ``any_of``; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    found = {name: t.rlike("(?i)" + "|".join(patterns)) for name, patterns in categories.items()}
    some = F.lit(False)
    for name in any_of or categories:
        some = some | found[name]
    return found | {"any_hgt": some}


def enrichment(genes: DataFrame, by: list[str], categories: list[str]) -> DataFrame:
    """(by, category, marker_in, genes_in, rate_in, rate_out, odds_ratio, p) of ``genes`` (by, inside, a boolean column for each category)."""
    long = genes.select(*by, "inside", F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("has")) for c in categories])))
    cell = lambda i, h: F.sum(((F.col("inside") == i) & (F.col("has") == h)).cast("long"))
    t = long.groupBy(*by, "category").agg(cell(True, True).alias("a"), cell(False, True).alias("b"), cell(True, False).alias("c"), cell(False, False).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    rate = lambda x, y: 100 * x / F.greatest(x + y, F.lit(1))
    ratio = odds_ratio(*[x.cast("double") for x in (a, b, c, d)])
    return t.select(*by, "category", a.alias("marker_in"), (a + c).alias("genes_in"), rate(a, c).alias("rate_in"), rate(b, d).alias("rate_out"), ratio.alias("odds_ratio"), fisher_greater(a, b, c, d).alias("p"))


def cross_validate(scores: DataFrame, config: list[str], unit: str, value: str, folds: int) -> DataFrame:
    """Per fold the configuration chosen on the other folds' units, and its mean on the fold's. ``scores`` has ``fold``."""
    train = scores.crossJoin(F.broadcast(scores.sparkSession.range(folds).select(F.col("id").alias("out"))))  # a row for each fold
    means = train.where("fold <> out").groupBy("out", *config).agg(F.avg(value).alias("train_mean"))
    chosen = best_config(means, F.round("train_mean", 9), config, ["out"])
    held = scores.select(F.col("fold").alias("out"), *config, value)
    return chosen.join(held, ["out", *config]).groupBy("out", *config, "train_mean").agg(F.avg(value).alias("held_out_mean"))


def kde(values: DataFrame, value: str, low: float, high: float, points: int) -> DataFrame:
    """(x, density) of a Gaussian kernel estimate with Scott's bandwidth on a grid; equal values are pre-aggregated."""
    level = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    stat = values.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    grid = values.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    z = (F.col("x") - F.col("v")) / h
    rows = level.join(F.broadcast(stat), F.lit(True)).join(F.broadcast(grid), F.lit(True))  # one row, and a fixed grid
    return rows.groupBy("x").agg((F.sum(F.col("m") * F.exp(-0.5 * z * z)) / (F.max("n") * F.max(h) * math.sqrt(2 * math.pi))).alias("density"))


def halves(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``half`` 0 or 1: at most the group's median, or above."""
    cut = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return rows.join(cut, by).withColumn("half", (F.col(value) > F.col("median")).cast("int"))
