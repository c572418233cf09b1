import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S


def random_bases(seed, n, letters="ACGTacgtNé"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def plain_kmers(seq, k):
    up = seq.translate(str.maketrans("acgt", "ACGT"))
    return [(i, up[i : i + k]) for i in range(len(up) - k + 1) if set(up[i : i + k]) <= set("ACGT")]


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 60)
    monkeypatch.setattr(S, "AT_ONCE", 100)


def test_codes_of_letters(spark):
    got = spark.createDataFrame([("gCaTx",), ("",)], "s string").select(S.encode(F.col("s"))).collect()
    assert got[0][0] == [3, 2, 0, 1, -1]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_kmers_over_chunk_ends(spark, small_chunks, k):
    texts = {"x": random_bases(1, 400), "y": random_bases(2, 60), "z": "", "short": "AC"}
    df = spark.createDataFrame([*texts.items(), ("none", None)], "name string, seq string")
    got = sorted((r.name, r.pos, r.kmer) for r in S.kmers(df, "seq", k).collect())
    assert got == sorted((n, p, s) for n, t in texts.items() for p, s in plain_kmers(t, k))
    counted = {(r.name, r.kmer): r.n for r in S.kmer_counts(df, "seq", k).collect()}
    assert counted == collections.Counter((n, s) for n, t in texts.items() for _, s in plain_kmers(t, k))
    whole = {r.kmer: r.n for r in S.kmer_counts(df.select("seq"), "seq", k).collect()}
    assert whole == collections.Counter(s for t in texts.values() for _, s in plain_kmers(t, k))


def test_ids_follow_the_order_of_bases(spark):
    df = S.kmer_counts(spark.createDataFrame([("GCTA" * 3,)], "seq string"), "seq", 3).select("kmer", S.kmer_id(F.col("kmer"), 3).alias("id"))
    assert all(r.id == sum("ATCG".index(c) * 4 ** (2 - i) for i, c in enumerate(r.kmer)) for r in df.collect())


@pytest.mark.parametrize("length", [0, 29, 30, 31, 36, 77])
def test_grids(spark, length):
    df = spark.createDataFrame([(length,)], "n long")
    starts = lambda n, step: [r.start for r in S.starts(df, n, step).orderBy("start").collect()]
    assert starts(S.n_windows(F.col("n"), 30, 6), 6) == [s for s in range(0, length, 6) if s + 30 < length]
    assert starts(S.n_tiles(F.col("n"), 9), 9) == [s for s in range(0, length, 9) if s + 9 <= length]


@pytest.mark.parametrize("w,dw", [(24, 8), (40, 4), (30, 30), (25, 7), (3, 2), (9, 20), (31, 1)])
def test_window_counts_over_chunk_ends(spark, small_chunks, w, dw):
    texts = {i: random_bases(10 + i, n) for i, n in enumerate((500, 90, w, w + 1, 5, 61))}
    df = spark.createDataFrame([*texts.items()], "id int, seq string")
    got = {(r.id, r.win_idx): r for r in S.window_counts(df, "seq", "id", [2, 3, 4], w, dw).collect()}
    grid = {(i, n) for i, t in texts.items() for n in range(max(0, math.ceil((len(t) - w) / dw)))}
    assert set(got) == grid
    for i, n in grid:
        part = texts[i][n * dw : n * dw + w]
        for k in (1, 2, 3, 4):
            want = collections.Counter(s for _, s in plain_kmers(part, k))
            ids = {sum("ATCG".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(s)): m for s, m in want.items()}
            assert {j: m for j, m in enumerate(got[i, n][f"c{k}"]) if m} == ids
    sparse = {(r.id, r.win_idx, r.kmer): r.n for r in S.window_kmer_counts(df, "seq", "id", 2, w, dw).collect()}
    assert sum(sparse.values()) == sum(sum(r.c2) for r in got.values()) and all(sparse.values())


def test_features_of_windows(spark):
    seq = random_bases(30, 300, "ACGTN")
    r = S.window_features(spark.createDataFrame([("s", seq)], "accession string, seq string"), "seq", "accession", 100, 100).where("win_idx = 1").first()
    part = seq[100:200]
    n = {b: part.count(b) for b in "ATCG"}
    assert r.gc == pytest.approx((n["G"] + n["C"]) / 100) and r.skew == pytest.approx((n["G"] - n["C"]) / (n["G"] + n["C"]))
    pairs = collections.Counter(s for _, s in plain_kmers(part, 2))
    bias = [pairs[x + y] / (math.sqrt(n[x]) * math.sqrt(n[y]) + 1e-6) for x in "ATCG" for y in "ATCG"]
    acids = collections.Counter(S.CODONS[s] for _, s in plain_kmers(part, 3))
    fours = collections.Counter(s for _, s in plain_kmers(part, 4))

    def entropy(values):
        return sum((v / sum(values) + 1) * math.log2(v / sum(values) + 1) for v in values)

    assert r.dinuc == pytest.approx(bias) and r.aa == [acids[a] for a in sorted(set(S.AMINO_ACIDS))] and sum(r.tetra) == sum(fours.values())
    assert (r.h_dinuc, r.h_aa, r.h_tetra) == (pytest.approx(entropy(bias)), pytest.approx(entropy(list(acids.values()))), pytest.approx(entropy(list(fours.values()))))


def test_features_of_ambiguous_windows(spark):
    r = S.window_features(spark.createDataFrame([("s", "N" * 50)], "accession string, seq string"), "seq", "accession", 20, 20).first()
    assert (r.gc, r.skew, r.h_dinuc, r.h_aa, r.h_tetra) == (0, 0, 0, 0, 0)


def test_one_sequence_of_fifty_million(spark):
    """Made by Spark as one row; counted over chunks."""
    unit = "ACGTTGCA" * 1000
    df = spark.range(1).select(F.repeat(F.lit(unit), 6250).alias("seq"))
    got = {r.kmer: r.n for r in S.kmer_counts(df, "seq", 2).collect()}
    each = collections.Counter(s for _, s in plain_kmers(unit + "A", 2))
    assert sum(got.values()) == 50_000_000 - 1
    assert all(got[s] in (6250 * n, 6250 * n - 1) for s, n in each.items())


def test_composition_distances(spark):
    p = spark.createDataFrame([("u", "AA", 0.75), ("u", "AC", 0.25), ("v", "AC", 0.5), ("v", "GG", 0.5)], "name string, kmer string, f double")
    r = S.profile_distances(p, "u", "v").first()
    assert r.euclidean == pytest.approx(math.sqrt(0.75**2 + 0.25**2 + 0.5**2)) and r.manhattan == pytest.approx(1.5)
    assert r.cosine == pytest.approx(1 - 0.125 / (math.sqrt(0.625) * math.sqrt(0.5)))
    n = spark.createDataFrame([("u", 1, 1, 1, 1), ("u", 3, 1, 0, 0), ("v", 0, 0, 2, 1)], "name string, A long, T long, C long, G long")
    assert S.gc_difference(n, "u", "v").first()[0] == pytest.approx(0.75)


def test_texts_of_a_batch_become_strings_a_slice_at_a_time(spark):
    """Python holds the strings of a slice, not of the whole Arrow batch."""
    rows = spark.createDataFrame([], "k long, s string")
    text = random_bases(1, 20_000) + "\U0001f9ec"  # four bytes a character as a string
    batch = pa.RecordBatch.from_pydict({"k": list(range(400)), "s": [text] * 400})

    class Rows:
        schema = rows.schema

        def where(self, _):
            return self

        def mapInArrow(self, over, _):
            return over(iter([batch]))

    seen = []

    def run(columns, texts):
        seen.extend(zip(columns["k"].to_pylist(), map(len, texts), strict=True))
        return np.arange(len(texts)), {"n": pa.array(list(map(len, texts)))}

    tracemalloc.start()
    got = [b.num_rows for b in S._in_batches(Rows(), "s", ["k"], "n long", run)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got) == 400 and seen == [(i, len(text)) for i in range(400)] and max(got) <= -(-S.AT_ONCE // len(text))
    assert peak < 8 * S.AT_ONCE < 400 * len(text)
