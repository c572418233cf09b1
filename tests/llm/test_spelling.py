import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n, out = brute_words(docs), {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = best if best is not None and n[best] >= 5 * n[w] else None, n[w], len(near)
    rows = []
    for w, (form, k, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, k, near, n[form] if form else None))
    return sorted(rows, key=str)


def corpus():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice((6, 7, 9, 12)))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "Straße" + "n" * 3, "ÀÖ×÷ÿß" + "x"]
    vocabulary = []
    for w in base:
        vocabulary += [w] * rng.choice((5, 30, 200))
        for _ in range(6):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcé")
            vocabulary += [rng.choice((w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]))] * rng.choice((1, 5, 6, 40))
    rng.shuffle(vocabulary)
    docs, at = [], 0
    while at < len(vocabulary):
        k = rng.choice((1, 20, 300))
        docs.append((rng.randrange(60), rng.choice((" ", "-", "1", "\n")).join(w.upper() if rng.random() < 0.2 else w for w in vocabulary[at : at + k])))
        at += k
    return docs


def test_spelling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPAN", 50)
    monkeypatch.setattr(spelling, "HELD", 10)
    docs = [*corpus(), (70, "plannetz " * 5 + "plannet " * 30 + "planet " * 200), (None, None), (None, "whithout " * 5), (1, ""), (None, "without " * 60), (3, "Þþ naïveté " * 9)]
    long = "ab" * 3000
    docs += [(50 + i, f"{long} {long}c {long[:4000]}x{long[4000:]}") for i in range(6)]
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(want) > 150 and sum(r[2] != r[1] and r[1] is not None for r in want) > 0 and sum(r[4] > 1 for r in want) > 50


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short few"), (2, None)], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rest,label,want", [("abc", "abc", [("", 0)]), ("abcd", "ab", [("cd", 0)]), ("abd", "abc", [("d", 1), ("", 1)]), ("ab", "abc", [("", 1)]), ("bcd", "abc", [("d", 1)]), ("xabcd", "abc", [("d", 1)]), ("", "c", [("", 1)]), ("", "cd", [])])
def test_moves_over_an_edge(rest, label, want):
    assert list(spelling.moves(rest, label)) == want
