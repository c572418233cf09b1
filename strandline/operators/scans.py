"""Scans along series in pieces, so that a series of any length runs in many tasks.

A piece is a range of ``PIECE`` positions of a series. A scan (running sums,
counts, reach) is made in each piece alone; summaries of the pieces, one row
each, are scanned along the series, and what lies before a piece goes into it as
a row ahead of its others. A moving frame gets its piece together with the halo of rows that its
frames reach into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.sources.staging import cut

#: Positions in a piece.
PIECE = 1 << 16

_SUMMARY = {"sum": F.sum, "max": F.max, "min": F.min}


def piece_of(at: str | Column, span: int | None = None) -> Column:
    """The piece that position ``at`` lies in."""
    return F.floor((F.col(at) if isinstance(at, str) else at) / (span or PIECE)).cast("long")


def _same(keys: list[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"same_{k}"))
    return match


def pieces(rows: DataFrame, at: str, span: int | None = None) -> DataFrame:
    """``rows`` with the piece that position ``at`` lies in, as ``piece_``."""
    return rows.withColumn("piece_", piece_of(at, span))


def dealt(rows: DataFrame, keys: list[str], fixed: bool = False) -> DataFrame:
    """``rows``, with :func:`pieces`, shuffled so that each piece lies in one task; ``fixed``: as many tasks as the session's
    shuffle partitions, not fewer by the rows' size, for rows that more are made of."""
    n = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))] if fixed else []
    return rows.repartition(*n, *keys, "piece_")


def ranges(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, as many as the session's shuffle partitions, numbered as ``piece_``: for scans without keys."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut(rows.repartitionByRange(n, order).withColumn("piece_", F.spark_partition_id()))


def scanned(rows: DataFrame, keys: list[str], at: str, order: list, made: dict[str, tuple], follows: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """``rows``, with :func:`pieces`, and running values along ``order`` within ``keys``; ``order`` must begin with ``at``, and part all rows.

    ``made``: for each new column (summary, column, rows before), the summary one
    of sum, max and min, and whether the row itself is left out (1) or not (0).
    ``follows``: name for the next position of the same ``keys``, null at the
    end. Nulls count for nothing; keys may be null. ``totals``: where the rows were made piece by piece of
    :func:`dealt` ones (``fixed``) and need no shuffle, each piece's summaries (keys, piece_, v_<new column>) and first position (first_).
    """
    inside = Window.partitionBy(*keys, "piece_").orderBy("head_", *order)
    line = Window.partitionBy(*keys).orderBy("piece_")  # over a row for each piece
    fixed = totals is not None
    rows = rows if fixed else dealt(rows, keys)  # the one shuffle of all rows: what follows needs them so
    totals = totals if fixed else rows.groupBy(*keys, "piece_").agg(*[_SUMMARY[f](c).alias(f"v_{n}") for n, (f, c, _) in made.items()], F.min(at).alias("first_"))
    kind = {n: totals.schema[f"v_{n}"].dataType for n in made}
    # a head's value stands in the column that is summed, if that one is of the sum's kind and of no other use
    used = [c for _, c, _ in made.values()]
    held = {n: c if used.count(c) == 1 and rows.schema[c].dataType == kind[n] and c not in [*keys, at, *order] else f"v_{n}" for n, (_, c, _) in made.items()}
    ahead = [_SUMMARY[f](f"v_{n}").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias(f"v_{n}") for n, (f, _, _) in made.items()]
    heads = totals.select(*keys, "piece_", *ahead, F.lead("first_").over(line).alias("after_"), F.lag("first_").over(line).alias("before_"), F.lit(0).alias("head_"))
    heads = heads.where("after_ is not null or before_ is not null").drop("before_")
    heads = dealt(heads, keys, fixed)  # none of a series in one piece
    own = rows.withColumns({**{v: F.col(made[n][1]).cast(kind[n]) for n, v in held.items() if v not in rows.columns}, "after_": F.lit(None).cast(rows.schema[at].dataType), "head_": F.lit(1)})
    r = own.unionByName(heads.withColumnsRenamed({f"v_{n}": v for n, v in held.items()}), allowMissingColumns=True)
    new = [_SUMMARY[f](held[n]).over(inside.rowsBetween(Window.unboundedPreceding, -1 if left_out else 0)).cast(kind[n]).alias(n) for n, (f, _, left_out) in made.items()]
    after = [F.coalesce(F.lead(at).over(inside), F.max("after_").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(follows)] if follows else []
    return r.select(*rows.columns, *new, *after, "head_").where("head_ = 1").drop("head_")


def with_halo(rows: DataFrame, at: str, before: int, after: int, span: int | None = None) -> DataFrame:
    """``rows`` in every piece (column ``piece_``) of whose frames, from ``before`` positions back to ``after`` on, they are part."""
    size = max(span or PIECE, before + after + 1)
    first, last = (F.floor((F.col(at) + d) / size).cast("long") for d in (-after, before))
    rows = rows.select("*", F.explode(F.sequence(F.greatest(F.lit(0), first), last)).alias("piece_"))
    return rows.withColumn("own_", F.floor(F.col(at) / size).cast("long") == F.col("piece_"))


def sized(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the number of rows of their ``key``."""
    sizes = rows.groupBy(F.col(key).alias(f"same_{key}")).agg(F.count("*").alias(name))
    return rows.join(sizes, _same([key]), "left").drop(f"same_{key}")


def kth_smallest(codes: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of ``codes[low:high]`` for all frames at once, bit by bit from the highest.

    The codes are parted stably by each bit, and a frame follows its answer's
    part by the counts before its ends, so the cost does not depend on the
    frames' widths. Frames must hold more than ``k`` codes.
    """
    out = np.zeros(len(low), np.int64)
    for bit in reversed(range(max(1, int(codes.max(initial=0)).bit_length()))):
        one = (codes >> bit & 1).astype(bool)
        zeros = np.append(0, np.cumsum(~one))
        here = zeros[high] - zeros[low]
        up = k >= here
        k = np.where(up, k - here, k)
        low, high = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        out |= up.astype(np.int64) << bit
        codes = np.concatenate([codes[~one], codes[one]])
    return out


def _medians(width: int, padded: bool):
    half = width // 2

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx_")
        idx, score = (table.column(c).to_numpy() for c in ("idx_", "score_"))
        there = ~table.column("score_").is_null().to_numpy()
        own, n = table.column("own_").to_numpy(), int(table.column("n_")[0].as_py())
        # without missing scores; ends repeated where the frame goes beyond the track
        head = half if padded and len(idx) and idx[0] == 0 and there[0] else 0
        tail = width - half if padded and len(idx) and idx[-1] == n - 1 and there[-1] else 0
        values, codes = np.unique(np.concatenate([np.repeat(score[:1], head), score[there], np.repeat(score[-1:], tail)]), return_inverse=True)
        before = np.append(0, np.cumsum(there))
        at = idx[own]
        low, high = (head + before[np.searchsorted(idx, x)] for x in (at - half, at + width - half))
        low = low - np.minimum(head, np.maximum(0, half - at))
        high = high + np.minimum(tail, np.maximum(0, at + width - half - n))
        full = high - low > half
        found = np.zeros(len(at))
        found[full] = values[kth_smallest(codes, low[full], high[full], np.full(full.sum(), half))] if full.any() else 0
        kept = table.filter(pa.array(own)).drop_columns(["idx_", "score_", "own_", "n_", "piece_", "key_"])
        return kept.append_column("median_", pa.array(found, mask=~full))

    return run


def running_median(track: DataFrame, width: int, padded: bool, key: str = "accession", span: int | None = None) -> DataFrame:
    """``track`` (key, idx from 0 without gaps, score) with ``median_``, the value at place ``width`` // 2 of its frame in order, and ``n_``, the track's rows.

    The frame of a row has ``width`` // 2 rows before it and ``width`` in all;
    where it goes beyond the track it is short, or ``padded`` with the end's
    score. Null scores are left out; a frame with too few others gives null.
    """
    half = width // 2
    rows = sized(track, key, "rows_").withColumn("n_", F.col("rows_"))
    rows = with_halo(rows.withColumns({"key_": F.col(key), "idx_": F.col("idx").cast("long"), "score_": F.col("score").cast("double")}), "idx_", half, width - half - 1, span)
    schema = [f for f in rows.schema.fields if f.name not in ("idx_", "score_", "own_", "n_", "piece_", "key_")]
    out = rows.groupBy("key_", "piece_").applyInArrow(_medians(width, padded), StructType([*schema, StructField("median_", DoubleType())]))
    return out.withColumnRenamed("rows_", "n_")
