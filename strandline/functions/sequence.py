"""Sequence and composition functions over columns of bases A, T, C, G (anything else is ambiguous).

Sequences are looked at in chunks: rows of a bounded length that overlap by as
much as a k-mer or a window needs. So a sequence of any length is many rows, and
counts are summed over its chunks. Within a chunk, counting runs over arrays of
codes in Arrow batches; a row for each base would cost a hundred times as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ATCG"
#: The standard genetic code, codons in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}


def encode(seq: Column) -> Column:
    """Codes 0 to 3 of A, T, C, G in either case, -1 for anything else."""
    return F.transform(F.split(F.translate(seq, "atcg", BASES), ""), lambda ch: F.instr(F.lit(BASES), ch) - 1)


#: Bases of a chunk, about, and bases that are counted at once.
CHUNK, AT_ONCE = 1 << 18, 1 << 18
_CODE = np.full(128, 4, np.uint8)
for _i, _base in enumerate(BASES):
    _CODE[[ord(_base), ord(_base.lower())]] = _i


def chunked(rows: DataFrame, seq: str, size: int, overlap: int) -> DataFrame:
    """``rows`` with ``seq`` in chunks: each has ``offset`` (long), ``size`` positions from there and the next ``overlap`` ones, if there are any."""
    assert overlap <= size
    rest = [c for c in rows.columns if c != seq]
    parts = F.when(F.length(seq) <= size, F.array(F.col(seq))).otherwise(F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    joined = F.transform("c_", lambda x, i: F.struct((i.cast("long") * size).alias("offset"), F.concat(x, F.substring(F.coalesce(F.get("c_", i + 1), F.lit("")), 1, overlap)).alias(seq)))
    return rows.select(*rest, parts.alias("c_")).select(*rest, F.explode(joined).alias("c_")).select(*rest, "c_.offset", f"c_.{seq}")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0 to 3 of all texts' characters, 4 for ambiguous ones, and where each text begins (one more entry than texts)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODE[np.minimum(points, 127)], np.uint8(4))
    return codes, np.cumsum([0, *map(len, texts)])


def _kmer_ids(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ids) of the unambiguous k-mers that lie within one text; places count over all texts."""
    n = max(0, len(codes) - k + 1)
    ids, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        c = codes[j : j + n]
        ids = ids * 4 + c
        good &= c < 4
    for j in range(1, k):  # those that reach over a text's end
        ends = at[1:-1] - j
        good[ends[(ends >= 0) & (ends < n)]] = False
    places = np.flatnonzero(good)
    return places, ids[places]


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Texts of about ``most`` characters at a time, as (first, last + 1)."""
    low = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(lengths):
        yield low, len(lengths)


def _in_batches(rows: DataFrame, seq: str, keys: list[str], made: str, run, most: int | None = None) -> DataFrame:
    """``keys`` and what ``run`` (batch columns, texts) yields: indices of the texts and Arrow arrays of the columns ``made``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(seq))  # as strings only a slice at a time, which take up to four bytes a character
            held = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names if c != seq}
            for low, high in _slices(pc.utf8_length(texts).to_pylist(), min(most or AT_ONCE, AT_ONCE)):
                which, columns = run({c: v[low:high] for c, v in held.items()}, texts[low:high].to_pylist())
                if len(which):
                    own = [held[c].take(pa.array(which + low)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, *columns.values()], names=[*keys, *columns])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), made])
    return rows.where(F.col(seq).isNotNull()).mapInArrow(over, schema)


def kmer_text(kid: Column, k: int) -> Column:
    """The k-mer of an id (a long)."""
    return F.concat(*[F.substring(F.lit(BASES), (F.shiftright(kid, 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")) + 1).cast("int"), F.lit(1)) for i in range(k)])


def kmers(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """``rows`` without ``seq``, one row for each unambiguous k-mer (pos from 0, kmer)."""
    keys = [c for c in rows.columns if c != seq]

    def run(columns, texts):
        codes, at = _codes(texts)
        places, ids = _kmer_ids(codes, at, k)
        text = np.searchsorted(at, places, "right") - 1
        offset = columns["offset"].to_numpy(zero_copy_only=False)
        return text, {"pos": pa.array(places - at[text] + offset[text]), "kid": pa.array(ids)}

    found = _in_batches(chunked(rows, seq, CHUNK, k - 1), seq, keys, "pos long, kid long", run)
    return found.select(*keys, "pos", kmer_text(F.col("kid"), k).alias("kmer"))


def kmer_counts(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """(keys, kmer, n): counts are made for each chunk, or batch of chunks where there are no keys, and summed."""
    keys = [c for c in rows.columns if c != seq]

    def run(columns, texts):
        codes, at = _codes(texts)
        places, ids = _kmer_ids(codes, at, k)
        text = np.searchsorted(at, places, "right") - 1 if keys else np.zeros(len(places), np.int64)
        each, n = np.unique((text << 2 * k) + ids, return_counts=True)
        return each >> 2 * k, {"kid": pa.array(each & ((1 << 2 * k) - 1)), "n_": pa.array(n)}

    found = _in_batches(chunked(rows, seq, CHUNK, k - 1), seq, keys, "kid long, n_ long", run)
    return found.groupBy(*keys, "kid").agg(F.sum("n_").alias("n")).select(*keys, kmer_text(F.col("kid"), k).alias("kmer"), "n")


def kmer_id(kmer: Column, k: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out * 4 + F.instr(F.lit(BASES), F.substring(kmer, i + 1, 1)) - 1
    return out


def base_counts(seq: Column) -> dict[str, Column]:
    up = F.translate(seq, "atcg", BASES)
    return {b: (F.length(up) - F.length(F.replace(up, F.lit(b), F.lit("")))).cast("long") for b in BASES}


def n_windows(length: Column, w: int, dw: int) -> Column:
    """Windows that start at 0, dw, ... and end strictly before the sequence does."""
    return F.greatest(F.lit(0), F.ceil((length - w) / dw)).cast("long")


def n_tiles(length: Column, tile: int, step: int | None = None) -> Column:
    return F.greatest(F.lit(0), F.floor((length - tile) / (step or tile)) + 1).cast("long")


def starts(rows: DataFrame, n: Column, step: int, name: str = "win_idx") -> DataFrame:
    r = rows.withColumn("n_", n).where("n_ > 0")
    return r.select(*rows.columns, F.explode(F.expr("sequence(0L, n_ - 1)")).alias(name)).withColumn("start", F.col(name) * step)


#: Counts that a chunk's windows hold at once, about.
HELD = 1 << 21


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _over_windows(rows: DataFrame, seq: str, key: str, ks: list[int], w: int, dw: int, made: str, columns_of) -> DataFrame:
    """(key, win_idx, ``made``): what ``columns_of`` makes of each window's counts, {k: an array of a row for each window} for 1 and ``ks``.

    Places are parted where windows start and where a k-mer that ends in them
    must have begun. Counts of the parts are summed along the chunk once, and a
    window's are the difference of two of these sums. A chunk holds all places of
    the windows that start in it, so nothing is shuffled.
    """
    if w < 1 or dw < 1 or min(ks, default=1) < 1:
        raise ValueError("windows, steps and k-mers have at least one place")
    many = max(1, min(CHUNK // dw, HELD >> 2 * max(ks, default=1)))
    size = max(-(-w // dw), many) * dw

    def run(columns, texts):
        codes, at = _codes(texts)
        offset, length = (columns[c].to_numpy(zero_copy_only=False) for c in ("offset", "n_"))
        windows = np.clip(np.minimum(size // dw, -(-(length - w) // dw) - offset // dw), 0, None)
        text = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = at[text] + nth * dw
        counts = {}
        for k in (1, *ks):
            places, ids = _kmer_ids(codes, at, k)
            end = start + max(0, w - k + 1)
            part = np.zeros(len(codes) + 1, np.int32)
            part[start] = part[end] = 1
            part = np.cumsum(part)  # of each place; what begins before a part's first place lies in the parts before
            upto = np.bincount((part[places] << 2 * k) + ids, minlength=int(part[-1]) + 1 << 2 * k).reshape(-1, 1 << 2 * k).cumsum(axis=0)
            counts[k] = upto[part[end] - 1] - upto[part[start] - 1]
        return text, {"win_idx": pa.array(offset[text] // dw + nth), **columns_of(counts)}

    sized = rows.select(key, F.length(seq).cast("long").alias("n_"), seq).where(F.col("n_") > w)
    return _in_batches(chunked(sized, seq, size, w), seq, [key], f"win_idx long, {made}", run, size)


def window_counts(rows: DataFrame, seq: str, key: str, ks: list[int], w: int, dw: int) -> DataFrame:
    """(key, win_idx, c1, ck for each of ``ks``): counts, by id, of the bases and of the k-mers that start and end in each window; any w, dw and k."""
    made = ", ".join(f"c{k} array<bigint>" for k in (1, *ks))
    return _over_windows(rows, seq, key, ks, w, dw, made, lambda counts: {f"c{k}": _lists(n) for k, n in counts.items()})


def window_base_counts(rows: DataFrame, seq: str, key: str, w: int, dw: int) -> DataFrame:
    """(key, win_idx, A, T, C, G)."""
    return window_counts(rows, seq, key, [], w, dw).select(key, "win_idx", *[F.get("c1", F.lit(i)).alias(b) for i, b in enumerate(BASES)])


def window_kmer_counts(rows: DataFrame, seq: str, key: str, k: int, w: int, dw: int) -> DataFrame:
    """(key, win_idx, kmer, n), zero counts left out: k-mers that start in the window and end in it."""
    found = window_counts(rows, seq, key, [k], w, dw).select(key, "win_idx", F.posexplode(f"c{k}").alias("kid", "n")).where("n > 0")
    return found.select(key, "win_idx", kmer_text(F.col("kid").cast("long"), k).alias("kmer"), "n")


def _acids() -> np.ndarray:
    """The place of each 3-mer's class, by id, among the 21 in alphabetical order, * first."""
    order = sorted(set(AMINO_ACIDS))
    return np.array([order.index(CODONS["".join(codon)]) for codon in product(BASES, repeat=3)])


def _entropies(counts: np.ndarray) -> np.ndarray:
    """:func:`offset_entropy` of each row."""
    total = counts.sum(axis=1, keepdims=True)
    some = np.abs(total) > 1e-6
    share = counts / np.where(some, total, 1) + 1
    return np.where(some[:, 0], (share * np.log2(share)).sum(axis=1), 0.0)


def window_features(rows: DataFrame, seq: str, key: str, w: int, dw: int, mode: str = "normalized") -> DataFrame:
    """(key, win_idx, gc, skew, h_dinuc, h_aa, h_tetra, dinuc, aa, tetra): each window's composition, the last three as arrays.

    Made in the pass that counts: pair biases (see :func:`karlin`), counts of the
    21 classes of 3-mers in alphabetical order (* first, all frames), of 4-mers, and entropies of all three.
    """
    acids = _acids()

    def of(counts):
        n1, n2, n3, tetra = (counts[k].astype(float) for k in (1, 2, 3, 4))
        x, y = np.repeat(n1, 4, axis=1), np.tile(n1, 4)
        dinuc = n2 if mode == "raw" else n2 / ((x * y if mode == "original" else np.sqrt(x) * np.sqrt(y)) + 1e-6)
        aa = np.zeros((len(n3), int(acids.max()) + 1))
        for i, a in enumerate(acids):
            aa[:, a] += n3[:, i]
        c, g = n1[:, 2], n1[:, 3]
        scalars = {"gc": (g + c) / w, "skew": np.where(g + c > 0, (g - c) / np.maximum(g + c, 1), 0.0), "h_dinuc": _entropies(dinuc), "h_aa": _entropies(aa), "h_tetra": _entropies(tetra)}
        return {n: pa.array(v) for n, v in scalars.items()} | {"dinuc": _lists(dinuc), "aa": _lists(aa), "tetra": _lists(tetra)}

    made = "gc double, skew double, h_dinuc double, h_aa double, h_tetra double, dinuc array<double>, aa array<double>, tetra array<double>"
    return _over_windows(rows, seq, key, [2, 3, 4], w, dw, made, of)


def gc_skew(g: Column, c: Column) -> Column:
    return F.coalesce(F.try_divide(g - c, g + c), F.lit(0.0))


def karlin(n: Column, x: Column, y: Column, mode: str = "normalized") -> Column:
    """Dinucleotide bias from a pair's count and its two bases' counts."""
    if mode == "raw":
        return n.cast("double")
    return n / ((x * y if mode == "original" else F.sqrt(x) * F.sqrt(y)) + 1e-6)


def offset_entropy(counts: Column) -> Column:
    """Sum of p log2 p with p = f / sum + 1 over an array of counts; 0 if they sum to about nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    # the sum is bound to a lambda variable, so that it is not made again for each entry
    def of(s: Column) -> Column:
        share = lambda x: F.try_divide(x, s["t"]) + 1
        h = F.aggregate(s["c"], F.lit(0.0), lambda a, x: a + share(x) * F.log2(share(x)))
        return F.when(F.abs(s["t"]) > 1e-6, h).otherwise(0.0)

    return F.get(F.transform(F.array(F.struct(counts.alias("c"), total.alias("t"))), of), F.lit(0))


def amino_acid(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    return F.element_at(table, codon)


def gc_difference(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(gc_difference): by how much the shares of G and C among unambiguous bases differ between two names of (name, A, T, C, G)."""
    share = lambda n: F.try_divide(F.sum(F.when(F.col("name") == n, F.col("G") + F.col("C"))), F.sum(F.when(F.col("name") == n, F.col("A") + F.col("T") + F.col("C") + F.col("G"))))
    return counts.agg(F.abs(share(a) - share(b)).alias("gc_difference"))


def profile_distances(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """Euclidean, Manhattan and cosine distance of the k-mer profiles (name, kmer, f) of two names."""
    left, right = (profiles.where(F.col("name") == n).select("kmer", F.col("f").alias(f)) for n, f in ((a, "x"), (b, "y")))
    r = left.join(right, "kmer", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    cos = F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("y") ** 2)) + 1e-12)
    return r.agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("euclidean"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("manhattan"), (1 - cos).alias("cosine")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
