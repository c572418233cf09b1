"""Functions for ``spark.sql``: tails of tests as scalar functions, windows and tiles of a length as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import evaluate

#: Scalar functions by name: what computes them over batches.
SCALARS = {"normal_p": evaluate._normal_p, "signed_rank_p": evaluate._signed_rank_p, "fisher_greater": evaluate._fisher_greater, "binomial_two_sided": evaluate._binomial_two_sided}


class SeriesWindows:
    """(win_idx, start) of the windows of ``w`` positions, ``dw`` apart, that end strictly before ``length`` does; none for nulls."""

    def eval(self, length: int, w: int, dw: int):
        if None not in (length, w, dw):
            for i in range(max(0, -(-(length - w) // dw))):
                yield i, i * dw


class SeriesTiles:
    """(tile_idx, start) of the whole tiles of ``length``, one after the other; none for nulls."""

    def eval(self, length: int, tile: int):
        if None not in (length, tile):
            for i in range(max(0, length // tile)):
                yield i, i * tile


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: scalars by the names in ``SCALARS``, tables ``series_windows`` and ``series_tiles``."""
    for name, run in SCALARS.items():
        spark.udf.register(name, F.pandas_udf(run, "double"))
    spark.udtf.register("series_windows", F.udtf(SeriesWindows, returnType="win_idx bigint, start bigint"))
    spark.udtf.register("series_tiles", F.udtf(SeriesTiles, returnType="tile_idx bigint, start bigint"))
