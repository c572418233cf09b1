"""The predictors end to end: composition windows and tile vectors to scores, scores to intervals, intervals refined.

Series are ``lengths`` (accession, length). Tile vectors are (accession,
tile_idx, vec), composition features (accession, win_idx, vec). Every step is a
DataFrame, so several configurations can share the steps before they part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import detect, intervals, tracks, vectors
from strandline.sources.staging import cut


def composition_matrix(features: DataFrame, key: str = "accession", d: int | dict[str, int] = 2, entropy: bool = True, dinuc: bool = True) -> DataFrame:
    """(key, win_idx, vec): share of G and C, skew, entropies if wanted, and ``d`` principal components of the pair biases (if wanted), amino acids and 4-mers.

    ``d`` may give each block (dinuc, aa, tetra) a number of its own. ``features`` are those of :func:`strandline.functions.sequence.window_features`.
    """
    scalars = ["gc", "skew", *(["h_dinuc", "h_aa", "h_tetra"] if entropy else [])]
    blocks = [*(["dinuc"] if dinuc else []), "aa", "tetra"]
    dims = {b: d[b] if isinstance(d, dict) else d for b in blocks}
    rows = detect.pca_all(cut(features.select(key, "win_idx", *scalars, *blocks)), dims, key)
    return rows.select(key, "win_idx", F.concat(F.array(*scalars), *blocks).alias("vec"))


def tile_matrix(tiles: DataFrame, d: int, ready: bool = False, detrend: int = 0) -> DataFrame:
    """(accession, tile_idx, vec): the first ``d`` columns of tiles that are ``ready``, else principal components of their unit vectors.

    ``detrend``: tiles of the running median that each column is taken less; 0 for none.
    """
    if ready:
        out = tiles.select("accession", "tile_idx", F.slice("vec", 1, d).alias("vec"))
    else:
        unit = tiles.select("accession", "tile_idx", vectors.l2(F.col("vec")).alias("vec"))
        out = detect.pca(unit, d).select("accession", "tile_idx", F.col("scores").alias("vec"))
    if not detrend:
        return out
    # each column is a track of its own
    long = out.select("accession", F.col("tile_idx").alias("idx"), F.posexplode("vec").alias("dim", "score"))
    track = long.select(F.struct("accession", "dim").alias("accession"), "idx", "score")
    flat = tracks.detrend(track, max(3, detrend)).select("accession.accession", "accession.dim", F.col("idx").alias("tile_idx"), F.col("detrended").alias("v"))
    return vectors.gathered(flat, ["accession", "tile_idx"], "dim", "v")


def window_matrix(blocks: list[DataFrame]) -> DataFrame:
    """(accession, win_idx, vec): the blocks' vectors one after the other, for the windows that all blocks have."""
    if not blocks:
        raise ValueError("neither tile vectors nor composition features")
    out = blocks[0].select("accession", "win_idx", "vec")
    for i, b in enumerate(blocks[1:]):
        out = out.join(b.select("accession", "win_idx", F.col("vec").alias(f"vec_{i}")), ["accession", "win_idx"])
        out = out.select("accession", "win_idx", F.concat("vec", f"vec_{i}").alias("vec"))
    return out


def coarse(scored: DataFrame, width: int, w: int, dw: int, gap: int | None, least: int, lengths: DataFrame, assign: str = "center") -> DataFrame:
    """Intervals of the windows (accession, idx, score) whose smoothed score is below 0; ``gap`` None: close ones stay apart."""
    found = tracks.project(tracks.runs(tracks.alien(scored, width)), w, dw, assign, lengths)
    return intervals.drop_short(found if gap is None else intervals.joined(found, gap=gap), least)


def tile_signal(matrix: DataFrame) -> DataFrame:
    """(accession, idx, score): each tile's robust distance from its series' centre, smoothed over five tiles."""
    far = vectors.robust_distance(matrix).select("accession", F.col("tile_idx").alias("idx"), F.col("distance").alias("score"))
    return tracks.smooth5(far).select("accession", "idx", F.col("smoothed").alias("score"))


def refined(found: DataFrame, signal: DataFrame, tile: int, radius: int, context: int, gap: int, least: int, lengths: DataFrame) -> DataFrame:
    """``found`` with its edges at the signal's change points, merged and without short ones."""
    return intervals.drop_short(intervals.joined(tracks.refine(found, signal, tile, radius, context, lengths), gap=gap), least)


def by_composition(sequences: DataFrame, w: int, dw: int, width: int, least: int, assign: str = "start", stride: int = 1, **envelope) -> DataFrame:
    """The compositional baseline: (accession, seq) to intervals. Close ones are not merged."""
    matrix = composition_matrix(S.window_features(sequences, "seq", "accession", w, dw))
    scored = detect.two_stage_envelope(matrix.select("accession", F.col("win_idx").alias("idx"), F.col("vec").alias("x")), stride=stride, **envelope)
    lengths = sequences.select("accession", F.length("seq").cast("long").alias("length"))
    return coarse(scored.select("accession", "idx", "score"), width, w, dw, None, least, lengths, assign)


def by_vectors(tiles: DataFrame, lengths: DataFrame, tile: int, w: int, dw: int, d: int, width: int, gap: int, least: int, composition: DataFrame | None = None, ready: bool = False, detrend: int = 0, assign: str = "center", refine: tuple[int, int] | None = None, stride: int = 10, **envelope) -> DataFrame:
    """The whole predictor: tile vectors, and composition features if given, to intervals.

    ``refine``: radius and context of the search for change points; None for coarse intervals.
    """
    matrix = cut(tile_matrix(tiles, d, ready, detrend))
    windows = S.starts(lengths, S.n_windows(F.col("length"), w, dw), dw).select("accession", "win_idx", "start")
    pooled = vectors.pool_vectors(matrix, windows, tile, w)
    x = window_matrix([pooled, *([composition] if composition is not None else [])])
    scored = detect.two_stage_envelope(x.select("accession", F.col("win_idx").alias("idx"), F.col("vec").alias("x")), stride=stride, **envelope)
    found = cut(coarse(scored.select("accession", "idx", "score"), width, w, dw, gap, least, lengths, assign))
    if refine is None:
        return found
    return refined(found, tile_signal(matrix), tile, *refine, gap, least, lengths)
