import collections
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import ranking

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, most):
    bags = [(i, collections.Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, b in bags:
            m, score = 10 + 90 * sum(b.values()) * n_docs // max(1, n_terms), 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if t in b:
                    df = sum(t in other for _, other in bags)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:most], 1)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("shard,step,short", [(200, 3, 0.2), (3000, 7, 0.05), (1 << 20, 512, 1 / 8), (1000, 4, 0), (1000, 4, 1)])
def test_ranking_equals_brute_force(spark, monkeypatch, shard, step, short):
    for k, v in (("SHARD", shard), ("STEP", step), ("SHORT", short), ("BATCH", 300)):
        monkeypatch.setattr(ranking, k, v)
    rng = random.Random(4)
    words = ["the", "Of", "and", *[f"w{i}" for i in range(60)], "Größe", "x²"]
    text = lambda n: rng.choice(" \t-\n_").join(rng.choices(words, [30, 20, 10, *[60 / (i + 1) for i in range(62)]], k=n))
    docs = [(rng.choice((i, i, i // 3)), text(rng.choice((1, 5, 30, 200)))) for i in range(150)]
    docs += [(None, "w59 w58 the"), (900, None), (901, ""), (902, "-- !"), (903, "w1 " * 5000), (None, "w59 w58 the")] + [(904, "w3 w4 w5 the")] * 12
    items = [(i, text(rng.choice((1, 4, 25)))) for i in range(25)] + [(30, "unseen zzz"), (31, None), (32, ""), (33, "THE the of"), (33, "THE the of"), (33, "w3 w4"), (None, "w59 w58")]
    got = ranking.rank_documents(ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert order(got.collect()) == order(brute(docs, items, 10))


def test_ranking_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, score string")
    items = spark.createDataFrame([(1, "a", 2)], "item_id long, text string, rank int")
    blank = spark.createDataFrame([(1, "--"), (2, None)], "doc_id long, text string")
    assert ranking.rank_documents(ranking.build_index(none), items).count() == 0
    assert ranking.rank_documents(ranking.build_index(blank), items).count() == 0
    some = ranking.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert ranking.rank_documents(some, items.limit(0)).count() == 0


def test_index_is_held_a_shard_at_a_time(spark):
    """A row group is held as a whole, by its writer and by a reader; it must not be all shards of a task."""
    docs = spark.range(0, 4, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('a b ', {ranking.SHARD // 4})").alias("text"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in ranking.build_index(docs).inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert [g.num_rows for g in groups] == [1] * 4
    assert not any(g.column(i).is_stats_set for g in groups for i in range(g.num_columns))
