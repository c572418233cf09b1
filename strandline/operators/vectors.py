"""Tile vectors (accession, tile_idx, vec): normalising, pooling onto windows, robust distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import scans

#: Tiles in a piece of a series, for pooling.
TILES = 4096


def l2(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vec, lambda x: x / F.greatest(norm, F.lit(1e-8)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def cosine_guard(rows: DataFrame, a: str, b: str, least: float = 0.999) -> DataFrame:
    """(n, lowest, accepted): whether two versions of every vector point the same way."""
    return rows.agg(F.count("*").alias("n"), F.min(cosine(F.col(a), F.col(b))).alias("lowest")).withColumn("accepted", F.coalesce(F.col("lowest") > least, F.lit(False)))


def gathered(long: DataFrame, keys: list[str], dim: str, value: str) -> DataFrame:
    """(keys, vec) of rows of one entry each."""
    entries = F.array_sort(F.collect_list(F.struct(dim, value)))  # as many as a vector has
    return long.groupBy(*keys).agg(F.transform(entries, lambda e: e[value]).alias("vec"))


def _pooled(tile: int, w: int):
    """Windows pooled by two lookups each in cumulative tile vectors, less what their first and last tiles have outside."""

    def run(tiles: pa.Table, windows: pa.Table) -> pa.Table:
        start = windows.column("start").to_numpy()
        out = windows.select(["accession", "win_idx"])
        if not len(start) or not len(tiles):
            return out.slice(0, 0).append_column("vec", pa.array([], pa.list_(pa.float64())))
        at, vec = tiles.column("tile_idx").to_numpy(), tiles.column("vec").combine_chunks()
        vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        first, last = start // tile, (start + w - 1) // tile
        low, size = first.min(), int(last.max() - first.min()) + 1
        used = (at >= low) & (at < low + size)
        own = np.zeros((size, vec.shape[1] + 1))  # the last column counts a place's tiles
        np.add.at(own, at[used] - low, np.hstack([vec[used], np.ones((used.sum(), 1))]))
        upto = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)]) * tile
        first, last = first - low, last - low
        total = upto[last + 1] - upto[first]
        total -= own[first] * (start - (first + low) * tile)[:, None] + own[last] * ((last + low + 1) * tile - start - w)[:, None]
        weight = total[:, -1]
        some = weight > 0.5  # whole numbers but for rounding
        mean = (total[some, :-1] / weight[some, None]).ravel()
        ends = np.arange(some.sum() + 1, dtype=np.int32) * vec.shape[1]
        return out.filter(pa.array(some)).append_column("vec", pa.ListArray.from_arrays(pa.array(ends), pa.array(mean)))

    return run


def pool_vectors(tiles: DataFrame, windows: DataFrame, tile: int, w: int, step: int | None = None) -> DataFrame:
    """(accession, win_idx, vec): overlap-weighted mean of the tile vectors that each window (accession, win_idx, start) touches.

    Tiles and windows meet in pieces of a series; a window that touches no tile
    is left out, a missing tile or one without a vector counts for nothing.
    """
    if step not in (None, tile):
        raise ValueError("tiles must follow each other without gap or overlap")
    reach = w // tile + 1
    size = max(TILES, reach + 1)
    held = tiles.where("vec is not null").select("accession", F.col("tile_idx").cast("long").alias("tile_idx"), F.col("vec").cast("array<double>").alias("vec"))
    held = scans.with_halo(held, "tile_idx", 0, reach, size)
    begins = windows.select("accession", "win_idx", F.col("start").cast("long").alias("start"), F.floor(F.col("start") / (tile * size)).cast("long").alias("piece_"))
    kinds = dict(windows.dtypes)
    together = held.groupBy("accession", "piece_").cogroup(begins.groupBy("accession", "piece_"))
    return together.applyInArrow(_pooled(tile, w), f"accession {kinds['accession']}, win_idx {kinds['win_idx']}, vec array<double>")


def pool_windows(tiles: DataFrame, windows: DataFrame, tile: int, w: int) -> DataFrame:
    """(accession, win_idx, dim, value) of :func:`pool_vectors`."""
    return pool_vectors(tiles, windows, tile, w).select("accession", "win_idx", F.posexplode("vec").alias("dim", "value"))


def robust_distance(tiles: DataFrame) -> DataFrame:
    """(accession, tile_idx, distance): Euclidean distance from the medians, each dimension in its MAD."""
    long = tiles.select("accession", "tile_idx", F.posexplode("vec").alias("dim", "v"))
    centre = long.groupBy("accession", "dim").agg(F.median("v").alias("m"))
    off = long.join(centre, ["accession", "dim"]).withColumn("d", F.col("v") - F.col("m"))
    mad = off.groupBy("accession", "dim").agg((F.median(F.abs("d")) * 1.4826 + 1e-8).alias("mad"))
    z = off.join(mad, ["accession", "dim"]).withColumn("z", F.col("d") / F.col("mad"))
    return z.groupBy("accession", "tile_idx").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("distance"))


def tiles_mask(n_tiles: DataFrame, intervals: DataFrame, tile: int) -> DataFrame:
    """(accession, tile_idx, touched) for all tiles of (accession, tiles)."""
    hit = intervals.select("accession", F.explode(F.expr(f"sequence(start div {tile}, end div {tile})")).alias("tile_idx")).distinct().withColumn("hit", F.lit(True))
    all_ = n_tiles.where("tiles > 0").select("accession", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile_idx"))
    return all_.join(hit, ["accession", "tile_idx"], "left").select("accession", "tile_idx", F.coalesce("hit", F.lit(False)).alias("touched"))
