"""Minimum covariance determinant of series that are too long for one task.

Starts come from bounded subsets of a series' rows, dealt by hash, one task each.
From there every concentration step covers all rows: distances by Spark
expressions, the distance of the h-th row by an exact quantile, and the moments
of the rows within it as sums for each series and start. Only matrices of the
vectors' size meet in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.staging import cut

#: Subsets that starts are taken from, rows of each on average, starts in each, steps over all rows at most; parts of a range that a quantile looks at.
SUBSETS, SUBSET, STARTS, STEPS, PARTS = 6, 3000, 5, 50, 4096


def kth_value(rows: DataFrame, keys: list[str], value: str, k: DataFrame) -> DataFrame:
    """(keys, k, kth): the ``k``-th smallest (from 1) ``value`` of each group, exact, for every row (keys, k) of ``k``.

    The range that holds it is parted, the part that holds it becomes the range,
    until that is one value: a table of at most ``PARTS`` rows for each group and
    ``k`` each time. ``rows`` is read in every round; values must not be null.
    """
    whole = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    state = cut(k.join(whole, keys).withColumn("rest", F.col("k")))
    line = Window.partitionBy(*keys, "k").orderBy("part")
    while state.where("low < high").limit(1).count():
        part = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1)).alias("part")
        inside = rows.select(*keys, value).join(state.where("low < high"), keys).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))
        parts = inside.groupBy(*keys, "k", "rest", part).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        parts = parts.withColumn("upto", F.sum("n").over(line))
        found = parts.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        found = found.select(*keys, "k", "low", "high", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
        state = cut(found.unionByName(state.where("low >= high")))
    return state.select(*keys, "k", F.col("low").alias("kth"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s, m): rows, sums and summed products of ``x``, a row for each group and task."""

    def run(frames):
        held: dict = {}
        for f in frames:
            for key, g in f.groupby(keys, dropna=False):
                x = np.stack(g.x.to_numpy()).astype(float)
                n, s, m = held.get(key, (0, 0.0, 0.0))
                held[key] = n + len(x), s + x.sum(axis=0), m + x.T @ x
        for key, (n, s, m) in held.items():
            yield pd.DataFrame({**{c: [v] for c, v in zip(keys, key, strict=True)}, "n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, "x").mapInPandas(run, f"{kinds}, n long, s array<double>, m array<double>")


_MODEL = "n long, location array<double>, covariance array<array<double>>, precision array<array<double>>, size double"


def _model(moments: DataFrame, keys: list[str], ridge: DataFrame | None = None) -> DataFrame:
    """(keys, n, location, covariance, precision, size) of summed moments; ``size``: the logarithm of the determinant."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f.n.sum())
        s = np.sum([np.array(v) for v in f.s], axis=0)
        m = np.sum([np.array(v) for v in f.m], axis=0).reshape(len(s), len(s))
        mean = s / n
        cov = m / n - np.outer(mean, mean) + np.eye(len(s)) * (float(f.ridge.iloc[0]) if "ridge" in f else 0.0)
        return pd.DataFrame({**{c: f[c].iloc[:1] for c in keys}, "n": [n], "location": [mean.tolist()], "covariance": [cov.tolist()], "precision": [np.linalg.pinv(cov).tolist()], "size": [float(np.linalg.slogdet(cov)[1])]})

    rows = moments.join(ridge, "accession") if ridge is not None else moments
    kinds = ", ".join(f"{c} {moments.schema[c].dataType.simpleString()}" for c in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {_MODEL}")


def _square(x: str, location: str, precision: str) -> Column:
    """Squared distance of ``x`` from ``location``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    z = F.zip_with(x, location, lambda a, b: a - b)
    return F.get(F.transform(F.array(z), lambda c: dot(F.transform(precision, lambda p: dot(p, c)), c)), F.lit(0))


def _far(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Written rows (keys, x, far): squared distances from every model of a row's series."""
    return cut(rows.join(models.select(*keys, "location", "precision"), "accession").select(*keys, "x", _square("x", "location", "precision").alias("far")))


def _starts(rows: DataFrame, sizes: DataFrame, support: float, seed: int, steps) -> DataFrame:
    """(accession, start, location, precision) from subsets of each series."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        location, precision = steps(np.stack(f.sort_values("idx").x.to_numpy()).astype(float), support, seed + int(f.start.iloc[0]), STARTS)
        return pd.DataFrame({"accession": f.accession.iloc[:1], "start": f.start.iloc[:1], "location": [location.tolist()], "precision": [precision.tolist()]})

    dealt = rows.join(sizes.select("accession", F.greatest(F.lit(SUBSETS), F.ceil(F.col("rows_") / SUBSET)).alias("m_")), "accession")
    some = dealt.withColumn("start", F.pmod(F.xxhash64("accession", "idx", F.lit(seed)), F.col("m_")).cast("int")).where(F.col("start") < SUBSETS)
    kind = rows.schema["accession"].dataType.simpleString()
    return some.select("accession", "start", "idx", "x").groupBy("accession", "start").applyInPandas(run, f"accession {kind}, start int, location array<double>, precision array<array<double>>")


def long_fit(rows: DataFrame, sizes: DataFrame, contamination: float, support: float, seed: int, steps, chi2_cut) -> DataFrame:
    """(accession, location, precision, offset) of series (accession, idx, x) with ``sizes`` (accession, rows_), over all rows.

    As :func:`strandline.operators.detect.robust_covariance`, but that rows as
    far as the h-th one all count as within. ``steps`` fits a start in a task.
    """
    keys = ["accession", "start"]
    rows = cut(rows.select("accession", "idx", "x"))
    d = len(rows.select("x").first().x)
    h = F.least(F.col("rows_"), F.greatest(F.ceil(F.col("rows_") * support), F.lit(d + 1))).cast("long")
    trace = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0), lambda a, i: a + F.get(F.get("covariance", i), i))
    spread = _model(_moments(rows, ["accession"]), ["accession"])
    ridge = cut(spread.select("accession", (F.greatest(trace * F.col("n") / (F.col("n") - 1) / d, F.lit(1e-9)) * 1e-9).alias("ridge")))
    now = cut(_starts(rows, sizes, support, seed, steps).withColumn("size", F.lit(math.inf)))
    done = None
    for _ in range(STEPS):
        far = _far(rows, now, keys)
        k = now.select(*keys).join(sizes.select("accession", h.alias("k")), "accession")
        near = far.join(kth_value(far, keys, "far", k), keys).where("far <= kth")
        new = _model(_moments(near, keys), keys, ridge).join(now.select(*keys, F.col("size").alias("was")), keys)
        new = cut(new.withColumn("better", F.col("size") < F.col("was") - 1e-9))
        ended = new.where("not better").select(*keys, "location", "covariance", "precision", "size")
        done = ended if done is None else done.unionByName(ended)
        now = new.where("better").select(*keys, "location", "covariance", "precision", "size")
        if not now.limit(1).count():
            break
    else:
        done = done.unionByName(now)
    best = cut(done.groupBy("accession").agg(F.min_by(F.struct("location", "precision", "covariance"), F.struct("size", "start")).alias("b")).select("accession", "b.*"))
    half = lambda n, c: F.explode(F.array_distinct(F.array(F.floor((n - 1) * c) + 1, F.ceil((n - 1) * c) + 1)).cast("array<bigint>")).alias("k")

    def quantile(far: DataFrame, share: float) -> DataFrame:
        """(accession, q): with linear interpolation."""
        at = (F.col("rows_") - 1) * share
        k = sizes.select("accession", half(F.col("rows_"), share))
        got = kth_value(far, ["accession"], "far", k).groupBy("accession").agg(F.min("kth").alias("a"), F.max("kth").alias("b")).join(sizes, "accession")
        return got.select("accession", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("q"))

    far = _far(rows, best, ["accession"])
    scale = quantile(far, 0.5).select("accession", (F.col("q") / chi2_cut(d, 0.5)).alias("scale"))
    kept = far.join(scale, "accession").where(F.col("far") / F.col("scale") <= chi2_cut(d, 0.975))
    final = _model(_moments(kept, ["accession"]), ["accession"], ridge).where(F.col("n") > d + 1).select("accession", F.struct("location", "precision").alias("final"))
    scaled = F.struct("location", F.transform("precision", lambda p: F.transform(p, lambda v: v / F.col("scale"))).alias("precision"))
    models = cut(best.join(scale, "accession").join(final, "accession", "left").select("accession", F.coalesce("final", scaled).alias("f")).select("accession", "f.*"))
    offset = quantile(_far(rows, models, ["accession"]), 1 - contamination).select("accession", (-F.col("q")).alias("offset"))
    return models.join(offset, "accession")
