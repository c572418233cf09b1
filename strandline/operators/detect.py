"""Per-series models fitted in grouped tasks, scored by Spark expressions: PCA and a two-stage robust envelope."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import robust, scans
from strandline.sources.staging import cut


def pca_all(rows: DataFrame, dims: dict[str, int], key: str = "accession") -> DataFrame:
    """``rows`` with each column of ``dims`` as its centred principal component scores within each key, so many at most.

    Second moments are sums over rows, so each task sends a matrix for each key
    and column and not its rows; only those meet. Signs make each axis's largest
    entry positive. ``rows`` is read twice.
    """
    columns = list(dims)

    def moments(frames):
        held: dict = {}
        for f in frames:
            for k, g in f.groupby(key, dropna=False):
                for c in columns:
                    x = np.stack(g[c].to_numpy()).astype(float)
                    n, s, m = held.get((k, c), (0, 0.0, 0.0))
                    held[k, c] = n + len(x), s + x.sum(axis=0), m + x.T @ x
        for (k, c), (n, s, m) in held.items():
            yield pd.DataFrame({key: [k], "column": [c], "n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    def axes(f: pd.DataFrame) -> pd.DataFrame:
        n, s = int(f.n.sum()), np.sum([np.array(x) for x in f.s], axis=0)
        m = np.sum([np.array(x) for x in f.m], axis=0).reshape(len(s), len(s))
        mean = s / n
        _, v = np.linalg.eigh(m / n - np.outer(mean, mean))
        v = v[:, ::-1][:, : min(dims[f.column.iloc[0]], len(s), max(2, n - 1))]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        return pd.DataFrame({key: f[key].iloc[:1], "column": f.column.iloc[:1], "mean": [mean.tolist()], "axes": [v.T.tolist()]})

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(key, *columns).mapInPandas(moments, f"{key} {kind}, column string, n long, s array<double>, m array<double>")
    model = parts.groupBy(key, "column").applyInPandas(axes, f"{key} {kind}, column string, mean array<double>, axes array<array<double>>")
    own = lambda c: F.max(F.when(F.col("column") == c, F.struct("mean", "axes"))).alias(f"model_{c}")
    rows = rows.join(model.groupBy(key).agg(*[own(c) for c in columns]), key)
    for c in columns:
        rows = rows.withColumn(c, _onto(c, F.col(f"model_{c}"))).drop(f"model_{c}")
    return rows


def _onto(column: str, fit: Column) -> Column:
    centred = F.zip_with(column, fit["mean"], lambda x, m: x - m)
    dot = lambda axis: F.aggregate(F.zip_with(axis, centred, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.transform(fit["axes"], dot)


def pca(rows: DataFrame, d: int, key: str = "accession") -> DataFrame:
    """``rows`` with ``scores`` (array of ``d``): centred principal component scores of ``vec`` within each key."""
    return pca_all(rows.withColumn("scores", F.col("vec")), {"scores": d}, key)


def _chi2_cut(d: int, p: float) -> float:
    """Quantile of the chi-squared distribution by bisection of the incomplete gamma series."""

    def below(x: float) -> float:
        a, term, total, n = d / 2, 1.0, 1.0, 1
        while term > 1e-15 * total:
            term *= (x / 2) / (a + n)
            total += term
            n += 1
        return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))

    low, high = 1e-9, 10.0 * d + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def robust_covariance(x: np.ndarray, support: float, seed: int, starts: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Location and precision: minimum covariance determinant by concentration steps, then reweighted; with ``starts``, the best of so many short runs as it is."""
    n, d = x.shape
    h = min(n, max(int(math.ceil(support * n)), d + 1))
    rng = np.random.default_rng(seed)
    ridge = 1e-9 * np.eye(d) * max(1e-9, float(np.trace(np.cov(x.T).reshape(d, d))) / d)

    def steps(chosen: np.ndarray, most: int):
        last = np.inf
        for _ in range(most):
            mean, cov = x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True).reshape(d, d) + ridge
            z = x - mean
            far = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(cov), z)
            chosen = np.argpartition(far, h - 1)[:h]
            now = float(np.linalg.slogdet(cov)[1])
            if now >= last - 1e-9:
                break
            last = now
        return last, chosen, mean, cov, far

    first = [steps(rng.choice(n, min(n, d + 1), replace=False), 3) for _ in range(starts or 30)]
    if starts:
        mean, cov = min(first, key=lambda f: f[0])[2:4]
        return mean, np.linalg.pinv(cov)
    best = min((steps(f[1], 50) for f in sorted(first, key=lambda f: f[0])[:5]), key=lambda f: f[0])
    _, _, mean, cov, far = best
    cov = cov * np.median(far) / _chi2_cut(d, 0.5)
    z = x - mean
    keep = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(cov), z) <= _chi2_cut(d, 0.975)
    if keep.sum() > d + 1:
        mean, cov = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True).reshape(d, d) + ridge
    return mean, np.linalg.pinv(cov)


#: Rows of a series that are fitted in one task; longer ones are fitted over all tasks.
FIT_ROWS = 50_000


def _fit(rows: DataFrame, contamination: float, support: float, seed: int, stride: int) -> DataFrame:
    """(accession, location, precision, offset) fitted on every ``stride``-th row of a series."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f.sort_values("idx").x.to_numpy()).astype(float)
        where, precision = robust_covariance(x, support, seed)
        z = x - where
        d2 = np.einsum("ij,jk,ik->i", z, precision, z)
        return pd.DataFrame({"accession": f.accession.iloc[:1], "location": [where.tolist()], "precision": [precision.tolist()], "offset": [float(np.percentile(-d2, 100 * contamination))]})

    kind = rows.schema["accession"].dataType.simpleString()
    some = rows.select("accession", "idx", "x")
    if stride > 1:
        nth = scans.scanned(scans.pieces(some.withColumn("one_", F.lit(1)), "idx"), ["accession"], "idx", ["idx"], {"nth_": ("sum", "one_", 0)})
        some = nth.where((F.col("nth_") - 1) % stride == 0).select("accession", "idx", "x")
    sizes = cut(some.groupBy("accession").agg(F.count("*").alias("rows_")))
    long = sizes.where(F.col("rows_") > FIT_ROWS)
    short = some.join(sizes.where(F.col("rows_") <= FIT_ROWS), "accession").select("accession", "idx", "x")
    found = short.groupBy("accession").applyInPandas(fit, f"accession {kind}, location array<double>, precision array<array<double>>, offset double")
    if not long.limit(1).count():
        return found
    return found.unionByName(robust.long_fit(some.join(long.select("accession"), "accession"), long, contamination, support, seed, robust_covariance, _chi2_cut))


def _scored(rows: DataFrame, model: DataFrame, name: str) -> DataFrame:
    z = F.zip_with("x", "location", lambda a, b: a - b)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    r = rows.join(model, "accession", "left").withColumn("z_", z)
    d2 = dot(F.transform("precision", lambda p: dot(p, F.col("z_"))), F.col("z_"))
    return r.withColumn(name, -d2 - F.col("offset")).drop("z_", "location", "precision", "offset")


def two_stage_envelope(rows: DataFrame, contamination=(0.15, 0.05), support=(0.75, 0.9), stride: int = 10, seed: int = 3) -> DataFrame:
    """``rows`` (accession, idx, x array) with ``score``: below 0 is alien.

    A first envelope scores all rows; a second one, fitted on its inliers,
    scores those anew; outliers of the first keep their score. Rows and first
    scores are written, as each is read several times.
    """
    rows = cut(rows)
    first = cut(_scored(rows, _fit(rows, contamination[0], support[0], seed, stride), "s1"))
    inside = first.where("s1 >= 0").select("accession", "idx", "x")
    enough = inside.groupBy("accession").agg((F.count("*") > F.max(F.size("x")) + 2).alias("enough")).where("enough")
    second = _fit(inside.join(enough.select("accession"), "accession"), contamination[1], support[1], seed, stride)
    both = _scored(first, second, "s2")
    return both.withColumn("score", F.when(F.col("s1") >= 0, F.coalesce("s2", "s1")).otherwise(F.col("s1"))).drop("s1", "s2")
