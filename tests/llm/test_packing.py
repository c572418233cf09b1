import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_of_spans_are_the_tokenizers_own(encode, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 40)
    ids = packing.Ids(*packing.vocabulary_50k())
    texts = ["", " ", "a", "Hello  world\n\n  new line \t tab\t\tx", "it's we'll  \n", " wide　space   x", "!\x1c y ?\x1c\x1c z", "x" * 500, "naïve Straße 12345 日本語 \U0001f600 ", "<|endoftext|> a<|endoftext|>", "a\r\n b \x0b c", " lead and trail  " * 20]
    for text in (*texts, None):
        assert ids.of(text).tolist() == [*encode(text or ""), packing.END], text


def test_ids_of_documents_are_the_tokenizers_own(spark, encode):
    ids = packing.Ids(*packing.vocabulary_50k())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert ids.of(r.text).tolist() == [*encode(r.text or ""), packing.END]


def packed(docs, length):
    rows = packing.pack_documents(docs, packing.vocabulary_50k(), length).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
    sizes = [sum(n for _, n in own) for own in by.values()]
    assert sorted(by) == list(range(len(by))) and max(sizes, default=0) <= length
    return rows, sizes


def of_documents(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append((r.start, np.frombuffer(r.ids, np.uint32).tolist(), r.doc_tokens))
    return out


@pytest.mark.parametrize("length", [64, 1024])
def test_packing_round_trip_and_padding(spark, encode, length):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "be ta", "12", "Zürich", "x\n"], int(n))) for n in rng.integers(0, 400, 300)] + ["tie tie"] * 40 + ["long " * 9000]
    rows, sizes = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), length)
    for i, own in of_documents(rows).items():
        whole = [*encode(texts[i]), 0]
        assert [x for _, ids, _ in sorted(own) for x in ids] == whole and {n for *_, n in own} == {len(whole)}
        assert [s for s, *_ in sorted(own)] == [0, *np.cumsum([len(ids) for _, ids, _ in sorted(own)])[:-1].tolist()]
    assert len({r.doc_id for r in rows}) == len(texts)
    assert sum(length - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes) + packing.PADDING * len(sizes) * (length == 64)


def test_packing_of_hard_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "same", "y"), (2, "same", "y"), (None, "same", None)]
    got, sizes = packed(spark.createDataFrame(rows, "doc_id long, text string, length string"), 1024)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in got) == [(False, 1, 1), (False, 2, 2), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    assert sum(sizes) == 8 and all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), packing.vocabulary_50k()).count() == 0


def test_column_generation_reaches_the_programs_value():
    # by hand: 3 of 4 and 3 of 6 into 10: three pairs; 7 leaves 3, which nothing fills
    demand = np.zeros(11, np.int64)
    demand[[4, 6, 7]] = 300, 300, 50
    _, times, bound = packing.column_generation(demand, near=0)
    assert times.sum() == pytest.approx(350) and bound <= 350 + 1e-6
    for seed in range(4):
        rng = np.random.default_rng(seed)
        demand = np.zeros(257, np.int64)
        demand[rng.integers(50, 130, 10)] = rng.integers(100, 1000, 10)
        patterns, times, bound = packing.column_generation(demand, near=0)
        made = np.zeros(257)
        for p, t in zip(patterns, times, strict=True):
            assert sum(n * k for n, k in p.items()) <= 256
            for n, k in p.items():
                made[n] += k * t
        assert np.allclose(made, demand) and bound <= times.sum() + 1e-6 and times.sum() <= bound + 1 + 1e-6
        first = packing.column_generation(demand, near=1e9)[1].sum()
        assert times.sum() <= first


def test_knapsack_equals_brute_force():
    value = np.array([0, 0, 0, 2.5, 0, 4.9, 0, 6.0, 0, 0, 0, 0, 0])
    most, last = packing.knapsack(value)

    def brute(c):
        return max([0, *(value[n] + brute(c - n) for n in (3, 5, 7) if n <= c)])

    assert np.allclose(most, [brute(c) for c in range(13)])
    assert sum(value[n] * k for n, k in packing._taken(last, 12).items()) == pytest.approx(most[12])
