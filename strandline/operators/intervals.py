"""Interval algebra by sweep line: inclusive, 0-based intervals (accession, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import scans

KEYS = ["accession"]


def sweep(intervals: DataFrame, roles: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Segments (keys, start, end) between neighbouring borders, with how many intervals of each role cover them.

    ``intervals`` has a column ``role``. Copies of an interval are counted first, and cost one row for each task. An
    interval is dealt to its piece as it is, or as its two borders where they lie in two pieces; the borders of a piece
    are made and summed by position where they are scanned.
    """
    which = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(roles)], F.lit(-1)).cast("byte")
    rows = intervals.where("end >= start").select(*keys, which.alias("role_"), "start", (F.col("end") + 1).alias("stop_")).groupBy(*keys, "role_", "start", "stop_").agg(F.count("*").alias("m_"))
    first, last = scans.piece_of("start"), scans.piece_of("stop_")
    whole = F.struct(first.alias("piece_"), F.col("start").alias("open_"), F.when(first == last, F.col("stop_")).alias("close_"))
    rest = F.struct(last.alias("piece_"), F.when(F.lit(False), F.col("start")).alias("open_"), F.when(first != last, F.col("stop_")).alias("close_"))
    rows = scans.dealt(rows.select(*keys, "role_", "m_", F.inline(F.array(whole, rest))).where("open_ is not null or close_ is not null"), keys, fixed=True)
    change = F.when(F.col("open_").isNotNull(), F.col("m_")).otherwise(0) - F.when(F.col("close_").isNotNull(), F.col("m_")).otherwise(0)
    totals = rows.groupBy(*keys, "piece_").agg(*[F.sum(F.when(F.col("role_") == i, change).otherwise(0)).alias(f"v_n_{r}") for i, r in enumerate(roles)], F.min(F.coalesce("open_", "close_")).alias("first_"))
    borders = F.array(F.struct(F.col("open_").alias("pos"), F.col("m_").alias("d")), F.struct(F.col("close_").alias("pos"), (-F.col("m_")).alias("d")))
    at = rows.select(*keys, "piece_", "role_", F.inline(borders)).where("pos is not null").groupBy(*keys, "piece_", "pos").agg(*[F.sum(F.when(F.col("role_") == i, F.col("d")).otherwise(0)).alias(f"d_{r}") for i, r in enumerate(roles)])
    made = {f"n_{r}": ("sum", f"d_{r}", 0) for r in roles}
    out = scans.scanned(at, keys, "pos", ["pos"], made, "next_pos_", totals).where("next_pos_ is not null")
    return out.select(*keys, F.col("pos").alias("start"), (F.col("next_pos_") - 1).alias("end"), *[F.col(f"n_{r}").alias(r) for r in roles])


def joined(segments: DataFrame, keys: list[str] = KEYS, gap: int = 0) -> DataFrame:
    """Intervals that lie at most ``gap`` apart (or overlap) as one. Of those with one start the longest counts."""
    rows = scans.pieces(segments.groupBy(*keys, "start").agg(F.max("end").alias("end")), "start")
    rows = scans.scanned(rows, keys, "start", ["start"], {"reach_": ("max", "end", 1)})
    rows = rows.withColumn("new_", F.when(F.col("start") - F.col("reach_") - 1 <= gap, 0).otherwise(1))
    rows = scans.scanned(rows, keys, "start", ["start"], {"group_": ("sum", "new_", 0)})
    return rows.groupBy(*keys, "group_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("group_")


def union(intervals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return joined(intervals.select(*keys, "start", "end"), keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """What of ``a`` no interval of ``b`` covers."""
    rows = a.select(*keys, "start", "end", F.lit("a").alias("role")).union(b.select(*keys, "start", "end", F.lit("b").alias("role")))
    return joined(sweep(rows, ["a", "b"], keys).where("a > 0 and b = 0"), keys)


def complement(intervals: DataFrame, lengths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """What of each sequence (keys, length) no interval covers."""
    return subtract(lengths.where("length > 0").select(*keys, F.lit(0).cast("long").alias("start"), (F.col("length") - 1).alias("end")), intervals, keys)


def clip(intervals: DataFrame, length: str = "length") -> DataFrame:
    out = intervals.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least(F.col("end"), F.col(length) - 1)})
    return out.where("end >= start")


def drop_short(intervals: DataFrame, least: int) -> DataFrame:
    return intervals.where(F.col("end") - F.col("start") + 1 >= least)


def confusion(intervals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """TP, FN, FP, TN in bases, of roles pred, pos and neg."""
    seg = sweep(intervals, ["pred", "pos", "neg"], keys)
    n = F.col("end") - F.col("start") + 1
    total = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("long")
    p, t, f = F.col("pred") > 0, F.col("pos") > 0, F.col("neg") > 0
    return seg.groupBy(*keys).agg(total(p & t).alias("TP"), total(~p & t).alias("FN"), total(p & f).alias("FP"), total(~p & f).alias("TN"))


def by_method(intervals: DataFrame, methods: list[int], totals: dict, keys: list[str] = KEYS) -> DataFrame:
    """(keys, method, ``totals``): bases of each method, of roles pred_<method>, and pos and neg that all methods share; one sweep for all.

    ``totals``: for each column what of a segment counts, of whether it is called, positive and negative. A method has a
    row where any of these intervals lies.
    """
    seg = sweep(intervals, [*(f"pred_{m}" for m in methods), "pos", "neg"], keys)
    n, t, f = F.col("end") - F.col("start") + 1, F.col("pos") > 0, F.col("neg") > 0
    made = []
    for m in methods:  # the methods, not rows
        p = F.col(f"pred_{m}") > 0
        made += [F.sum(F.when(c(p, t, f), n).otherwise(0)).cast("long").alias(f"{name}_{m}") for name, c in totals.items()] + [F.max(p | t | f).alias(f"any_{m}")]
    rows = F.array(*[F.struct(F.lit(m).cast("long").alias("method"), *[F.col(f"{name}_{m}").alias(name) for name in totals], F.col(f"any_{m}").alias("any_")) for m in methods])
    return seg.groupBy(*keys).agg(*made).select(*keys, F.inline(rows)).where("any_").drop("any_")


#: TP, FN, FP, TN for :func:`by_method`.
CONFUSION = {"TP": lambda p, t, f: p & t, "FN": lambda p, t, f: ~p & t, "FP": lambda p, t, f: p & f, "TN": lambda p, t, f: ~p & f}


def overlapping(main: DataFrame, other: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The intervals of ``main`` that any of ``other`` overlaps, whole.

    Against coalesced intervals, the last one that starts at or before an
    interval's end overlaps it or none does. Ends grow with starts, so that one's
    end is the largest so far.
    """
    rows = main.select(*keys, "start", "end", F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("upto"))
    marks = union(other, keys).select(*keys, "start", "end", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("upto"))
    found = scans.scanned(scans.pieces(rows.union(marks), "at"), keys, "at", ["at", "kind"], {"last": ("max", "upto", 0)})
    return found.where("kind = 1 and last >= start").select(*keys, "start", "end")


def points_inside(points: DataFrame, other: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``points`` (keys, pos, ...) with ``inside``: whether any interval covers the position."""
    extra = [c for c in points.columns if c not in keys and c != "pos"]
    rows = points.select(*keys, "pos", *extra, F.lit(1).alias("kind_"), F.lit(None).cast("long").alias("upto_"))
    marks = union(other, keys).select(*keys, F.col("start").alias("pos"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("kind_"), F.col("end").cast("long").alias("upto_"))
    found = scans.scanned(scans.pieces(rows.union(marks), "pos"), keys, "pos", ["pos", "kind_"], {"last_": ("max", "upto_", 0)})
    return found.where("kind_ = 1").select(*keys, "pos", *extra, F.coalesce(F.col("last_") >= F.col("pos"), F.lit(False)).alias("inside"))


def evaluated(pred: DataFrame, pos: DataFrame, neg: DataFrame, lengths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """TP, FN, FP, TN of every series of ``lengths`` (keys, length), with all intervals clipped to it; 0 where a series has none."""
    roles = (("pred", pred), ("pos", pos), ("neg", neg))
    rows = [clip(f.select(*keys, "start", "end").join(lengths.select(*keys, "length"), keys)).select(*keys, F.lit(r).alias("role"), "start", "end") for r, f in roles]
    found = confusion(rows[0].union(rows[1]).union(rows[2]), keys)
    names = ("TP", "FN", "FP", "TN")
    return lengths.select(*keys).join(found, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def best_overlap(truth: DataFrame, preds: DataFrame, keys: list[str] = KEYS, bin_: int = 64, methods: list[int] | None = None) -> DataFrame:
    """Each interval of ``truth`` with the prediction of the largest overlap (ties: the first), and its edge errors.

    Both sides are dealt into bins and joined on those: an equi-join instead of a range join. Bins are ``bin_`` positions
    wide, doubled until a series' intervals are two bins long at most on average. With ``methods``, predictions have a
    column ``method``, and each interval comes once for each method, after ``keys``.
    """
    spans = truth.select(*keys, "start", "end").unionByName(preds.select(*keys, "start", "end"))
    wide = spans.groupBy(*keys).agg((F.lit(bin_) * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.avg(F.col("end") - F.col("start") + 1), F.lit(1.0)) / bin_))))).cast("long").alias("bin_"))
    preds = preds.join(wide, keys)
    bins = lambda: F.explode(F.expr("sequence(start div bin_, end div bin_)")).alias("bin")
    t = truth.select(*keys, "start", "end").distinct()
    left = t.join(wide, keys).select(*keys, F.col("start").alias("ts"), F.col("end").alias("te"), bins())
    right = preds.select(*keys, *(["method"] if methods else []), F.col("start").alias("ps"), F.col("end").alias("pe"), bins())
    ov = F.least("te", "pe") - F.greatest("ts", "ps") + 1
    pairs = left.join(right, [*keys, "bin"]).withColumn("ov", ov).where("ov > 0")
    found = F.struct((-F.col("ov")).alias("o"), "ps", "pe")
    best = pairs.groupBy(*keys, "ts", "te").agg(*[F.min(F.when(F.col("method") == m, found)).alias(f"m_{m}") for m in methods] if methods else [F.min(found).alias("m")])
    out = t.select(*keys, F.col("start").alias("ts"), F.col("end").alias("te")).join(best, [*keys, "ts", "te"], "left")
    if methods:
        each = F.array(*[F.struct(F.lit(m).cast("long").alias("method"), F.col(f"m_{m}").alias("m")) for m in methods])
        out, keys = out.select(*keys, "ts", "te", F.inline(each)), [*keys, "method"]
    ps, pe = F.col("m.ps"), F.col("m.pe")
    union_ = F.greatest("te", pe) - F.least("ts", ps) + 1
    return out.select(
        *keys, "ts", "te", F.col("m").isNotNull().alias("matched"), (ps - F.col("ts")).alias("signed_start"), (pe - F.col("te")).alias("signed_end"), F.abs(ps - F.col("ts")).alias("start_err"), F.abs(pe - F.col("te")).alias("end_err"),
        ((F.abs(ps - F.col("ts")) + F.abs(pe - F.col("te"))) / 2).alias("mean_err"), F.coalesce(F.try_divide(-F.col("m.o"), union_), F.lit(0.0)).alias("jaccard")
    )
