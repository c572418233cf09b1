"""Score tracks (accession, idx from 0 without gaps, score): smoothing, runs, projection, change points, boundary refinement.

A series of any length runs in many tasks; see :mod:`strandline.operators.scans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import intervals, scans


def _edges(width: int, n: str = "n_") -> Column:
    """True where the frame of ``width`` rows is not whole, or the track no longer than it: the row stays as it is."""
    half = width // 2
    return (F.col("idx") < half) | (F.col("idx") >= F.col(n) - half) | (F.col(n) <= width) | F.lit(width <= 1)


def smooth_median(track: DataFrame, width: int) -> DataFrame:
    """``smoothed``: the running median (of an even frame the upper middle value), edges untouched."""
    found = scans.running_median(track, width, False)
    return found.select(*track.columns, F.when(_edges(width), F.col("score")).otherwise(F.col("median_")).alias("smoothed"))


def alien(track: DataFrame, width: int) -> DataFrame:
    """``alien``: whether the running median is below 0, by the counts of negative scores up to a frame's ends."""
    half = width // 2
    rows = scans.with_halo(scans.sized(track, "accession", "n_"), "idx", half, width - half - 1)
    line = Window.partitionBy("accession", "piece_").orderBy("idx")
    rows = rows.withColumn("upto_", F.sum((F.col("score") < 0).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    many = F.lead("upto_", width - half - 1).over(line) - F.coalesce(F.lag("upto_", half + 1).over(line), F.lit(0)) >= width // 2 + 1
    found = rows.withColumn("many_", many).where("own_")
    return found.select(*track.columns, F.when(_edges(width), F.col("score") < 0).otherwise(F.col("many_")).alias("alien"))


def runs(flags: DataFrame, flag: str = "alien") -> DataFrame:
    """Maximal runs of set rows as (accession, first, last): those of each piece, then what meets at the pieces' borders."""
    line = Window.partitionBy("accession", "piece_").orderBy("idx")
    rows = scans.pieces(flags.where(flag), "idx").withColumn("g", F.col("idx") - F.row_number().over(line))
    parts = rows.groupBy("accession", "piece_", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    at_border = (F.col("first") % scans.PIECE == 0) | ((F.col("last") + 1) % scans.PIECE == 0)
    # two runs of a piece at most lie at its borders; only these stand in line along the whole series
    line = Window.partitionBy("accession", "near_").orderBy("first")
    parts = parts.withColumn("near_", F.when(~at_border, F.col("piece_")))
    parts = parts.withColumn("new_", F.coalesce(F.col("first") != F.lag("last").over(line) + 1, F.lit(True)).cast("int"))
    parts = parts.withColumn("group_", F.sum("new_").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("accession", "near_", "group_").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("near_", "group_")


def project(found: DataFrame, w: int, dw: int, assign: str, lengths: DataFrame | None = None) -> DataFrame:
    """Runs of windows as intervals of positions, from window starts or centres."""
    shift = 0 if assign == "start" else w // 2 - dw // 2
    out = found.select("accession", (F.col("first") * dw + shift).alias("start"), ((F.col("last") + 1) * dw + shift - 1).alias("end"))
    return intervals.clip(out.join(lengths, "accession")).drop("length") if lengths is not None else out


def islands(track: DataFrame, width: int, w: int, dw: int, gap: int, least: int, assign: str = "center") -> DataFrame:
    """From scores to intervals: smooth, threshold, run, project, merge, drop short."""
    found = project(runs(alien(track, width)), w, dw, assign)
    return intervals.drop_short(intervals.joined(found, gap=gap), least)


def smooth5(track: DataFrame) -> DataFrame:
    """Running median of five rows, ends replicated."""
    return scans.running_median(track, 5, True).select(*track.columns, F.col("median_").alias("smoothed"))


def detrend(track: DataFrame, width: int) -> DataFrame:
    """``detrended``: the score less its running median with replicated ends; less the whole median if the frame does not fit."""
    short = (F.col("n_") <= width) | F.lit(width < 3)
    found = scans.running_median(track, width, True)
    if width < 3:
        whole = track
    else:  # tracks that fit into a frame
        small = track.groupBy("accession").agg(F.count("*").alias("n_")).where(short).select(F.col("accession").alias("a_"))
        whole = track.join(small, F.col("accession").eqNullSafe(F.col("a_")), "left_semi")
    whole = whole.groupBy(F.col("accession").alias("a_")).agg(F.median("score").alias("whole_"))
    rows = found.join(whole, F.col("accession").eqNullSafe(F.col("a_")), "left")
    return rows.select(*track.columns, (F.col("score") - F.when(short, F.col("whole_")).otherwise(F.col("median_"))).alias("detrended"))


def prefix_sums(track: DataFrame) -> DataFrame:
    """``upto``: the sum of a track's scores up to each row."""
    return scans.scanned(scans.pieces(track, "idx"), ["accession"], "idx", ["idx"], {"upto": ("sum", "score", 0)}).drop("piece_")


def cusum(rows: DataFrame, keys: list[str], order: str, value: str, short: bool = False) -> DataFrame:
    """(keys, k, n): the change point that parts each group's means the most; ties the first; n // 2 below four rows.

    ``short``: groups are known to be of few rows, and are not scanned in pieces.
    """
    one, whole = F.lit(1).cast("long"), Window.partitionBy(*keys)
    if short:
        line = Window.partitionBy(*keys).orderBy(order)
        r = rows.select(*keys, F.row_number().over(line).alias("k"), F.count("*").over(whole).alias("n"), F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("sl"), F.sum(value).over(whole).alias("s"))
    else:
        r = scans.scanned(scans.pieces(rows.withColumn("one_", one), order), keys, order, [order], {"k": ("sum", "one_", 0), "sl": ("sum", value, 0)})
        sums = rows.groupBy(*[F.col(k).alias(f"same_{k}") for k in keys]).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
        r = r.select(*keys, "k", "sl").join(sums, scans._same(keys), "left")
    stat = F.sqrt(F.col("k") * (F.col("n") - F.col("k")) / F.col("n")) * F.abs(F.col("sl") / F.col("k") - F.try_divide(F.col("s") - F.col("sl"), F.col("n") - F.col("k")))
    best = r.withColumn("stat", F.when(F.col("k") < F.col("n"), F.round(stat, 9)))
    out = best.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.when(F.col("stat").isNotNull(), F.struct((-F.col("stat")).alias("a"), F.col("k").alias("k")))).alias("m"))
    return out.select(*keys, F.when(F.col("n") < 4, F.floor(F.col("n") / 2)).otherwise(F.col("m.k")).cast("long").alias("k"), F.col("n").cast("long").alias("n"))


def refine(coarse: DataFrame, signal: DataFrame, tile: int, radius: int, context: int, lengths: DataFrame) -> DataFrame:
    """Edges of ``coarse`` moved to the change points of the tile signal (accession, idx, score) around them."""
    sizes = signal.groupBy("accession").agg(F.count("*").alias("tiles"))
    c = coarse.join(sizes, "accession").join(lengths, "accession")
    lo = lambda e: F.greatest(F.lit(0), F.floor(e / tile))
    hi = lambda e: F.least(F.col("tiles"), F.floor(e / tile) + 1)
    s, e = F.col("start"), F.col("end")
    sides = F.array(F.struct(F.lit("s").alias("side"), lo(s - context).alias("lo"), hi(s + radius).alias("hi")), F.struct(F.lit("e").alias("side"), lo(e - radius).alias("lo"), hi(e + context).alias("hi")))
    slices = c.select("accession", "start", "end", F.inline(sides)).where("hi - lo >= 4")
    rows = slices.select("accession", "start", "end", "side", "lo", F.explode(F.expr("sequence(lo, hi - 1)")).alias("idx")).join(signal, ["accession", "idx"])
    found = cusum(rows, ["accession", "start", "end", "side", "lo"], "idx", "score", short=True)
    at = (F.col("lo") + F.col("k")) * tile
    edges = found.groupBy("accession", "start", "end").agg(F.max(F.when(F.col("side") == "s", at)).alias("ns"), F.max(F.when(F.col("side") == "e", at - 1)).alias("ne"))
    out = c.join(edges, ["accession", "start", "end"], "left").withColumns({"ns": F.coalesce("ns", "start"), "ne": F.coalesce("ne", "end")})
    keep = F.col("ne") <= F.col("ns")
    return out.select("accession", F.greatest(F.lit(0), F.when(keep, s).otherwise(F.col("ns"))).alias("start"), F.least(F.col("length") - 1, F.when(keep, e).otherwise(F.col("ne"))).alias("end"))
