"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Documents become an index: each row is a shard of about ``SHARD`` characters
with the postings of all its terms, and with the largest frequency and the
shortest document of each list, which bound what the list can add to a score.
An item is searched in each shard by itself. The lists of few documents are
summed into accumulators first. Those, sorted by document and bounded by their
largest sum, are then one iterator among the long lists: documents are taken in
order, ``STEP`` at a time, from the iterators without which the least score of
the best found so far cannot be reached, and looked up in the others only while
their bounds still allow that score. A task carries an item's best documents
from shard to shard; those of all tasks are ranked at the end.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, table, trim
from strandline.llm.hashing import pieces, word_hashes

#: What parts terms; documents that an item is given.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Characters of a shard; documents taken at a time; a list with at most this share of a shard's documents is short;
#: characters of the items that are sent to tasks at once (further ones take another pass over the index).
SHARD, STEP, SHORT, BATCH = 1 << 23, 512, 1 / 8, 1 << 22

_GAPS = np.ones(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _GAPS[_low : _high + 1] = False

#: The writer holds a row group, a reader a batch of its rows, and neither looks at bytes before a hundred rows: a row group for each shard.
#: Without statistics, as those of a binary column keep its least and greatest value, a shard's, until the file is closed.
_ALONE = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}

_INDEX = "n_docs long, n_terms long, ids binary, no_id binary, sizes binary, terms binary, ends binary, docs binary, counts binary, most binary, least binary"


def terms_of(text: str | None) -> np.ndarray:
    """Hashes of a text's terms, sorted, once each."""
    return np.unique(word_hashes([text], _GAPS)[0])


def _shard(ids: list, texts: list) -> tuple:
    """A row of the index; the postings of a term stand together, by document."""
    h, at = word_hashes(texts, _GAPS)
    sizes = np.diff(at)
    order = np.argsort(h, kind="stable")
    term, doc = h[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[: len(term)])
    counts = np.diff(np.append(first, len(term))).astype(np.int32)
    term, doc = term[first], doc[first]
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
    bounds = [f(x, begin) if len(begin) else x for f, x in ((np.maximum.reduceat, counts), (np.minimum.reduceat, sizes[doc]))]
    arrays = (np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), sizes.astype(np.int64), term[begin], np.append(begin[1:], len(term))[: len(begin)].astype(np.int64), doc, counts, bounds[0].astype(np.int64), bounds[1].astype(np.int64))
    return int((sizes > 0).sum()), len(h), *(a.tobytes() for a in arrays)


def _build(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for low, high in pieces(texts, SHARD):
            row = _shard(ids[low:high], texts[low:high])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(row)], [c.split()[0] for c in _INDEX.split(", ")])
    trim()


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): every row with a text, whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return cut(rows.mapInArrow(_build, _INDEX), _ALONE)


def _frequencies(shared):
    def run(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, ends = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int64)
                where, n = _found(terms, wanted), np.diff(np.append(0, ends))
                total[where >= 0] += n[where[where >= 0]]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["term", "n"])

    return run


def _found(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted term is in the sorted ``terms``, or -1."""
    if not len(terms):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


class Best:
    """The best documents found for an item: scores, whether without id, ids."""

    def __init__(self, most: int):
        self.most, self.scores, self.no_id, self.ids = most, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a further document needs; ties are told by id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        scores, no_id, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.no_id, no_id), (self.ids, ids)))
        order = np.lexsort((ids, no_id, -scores))[: self.most]
        self.scores, self.no_id, self.ids = scores[order], no_id[order], ids[order]


class Shard:
    """A row of the index with the weights of the wanted terms: what each list adds to documents, exactly and at most."""

    def __init__(self, row: dict, wanted: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.no_id, sizes, self.docs, self.counts = get("ids", np.int64), get("no_id", bool), get("sizes", np.int64), get("docs", np.int32), get("counts", np.int32)
        self.length = lambda n: 10 + 90 * n * n_docs // n_terms
        self.m, self.weights = self.length(sizes), weights
        ends = get("ends", np.int64)
        where = _found(get("terms", np.uint64), wanted)
        self.end = np.where(where >= 0, ends[where], 0) if len(ends) else np.zeros(len(wanted), np.int64)
        self.begin = np.where(where > 0, ends[where - 1], 0) if len(ends) else self.end
        self.bound = np.where(where >= 0, self.adds(weights, get("most", np.int64)[where], self.length(get("least", np.int64)[where])), 0) if len(ends) else self.end
        self.whole: dict[int, np.ndarray] = {}

    @staticmethod
    def adds(weight, count, m):
        return weight * (1_000_000_000 * count // (1000 * count + 8 * m))

    def list_of(self, term: int) -> np.ndarray:
        return self.docs[self.begin[term] : self.end[term]]

    def scores(self, term: int, at=None) -> np.ndarray:
        """What ``term`` adds to the documents of its list, or of those at such places in it."""
        if at is None:
            if term not in self.whole:
                self.whole[term] = self.scores(term, slice(None))
            return self.whole[term]
        some = slice(self.begin[term], self.end[term])
        return self.adds(int(self.weights[term]), self.counts[some][at].astype(np.int64), self.m[self.docs[some][at]])

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds to ``best`` the documents that belong there."""
        there = [int(t) for t in terms if self.end[t] > self.begin[t] and self.weights[t] > 0]
        short = [t for t in there if self.end[t] - self.begin[t] <= SHORT * len(self.ids)]
        lists = [(int(self.bound[t]), self.list_of(t), t) for t in there if t not in short]
        if short:  # term at a time
            sums = np.zeros(len(self.ids), np.int64)
            for t in short:
                sums[self.list_of(t)] += self.scores(t)
            docs = np.flatnonzero(sums)
            held = sums[docs]
            lists.append((int(held.max()), docs, held))
        lists.sort(key=lambda x: x[0])
        most = np.cumsum([0, *(b for b, *_ in lists)])  # what the first ones add together, at most
        for low in range(0, len(self.ids), STEP):  # document at a time
            need = best.least
            if most[-1] < need:
                return
            first = int(np.searchsorted(most, need)) - 1  # the lists before it do not suffice alone
            parts = [(slice(*np.searchsorted(docs, (low, low + STEP))), docs, of) for _, docs, of in lists[first:]]
            docs = np.unique(np.concatenate([d[part] for part, d, _ in parts]))
            total = np.zeros(len(docs), np.int64)
            for part, d, of in parts:
                total[np.searchsorted(docs, d[part])] += of[part] if isinstance(of, np.ndarray) else self.scores(of, part)
            for i in range(first, 0, -1):
                stay = total + most[i] >= need
                docs, total = docs[stay], total[stay]
                if not len(docs):
                    break
                _, d, of = lists[i - 1]
                at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
                hit = d[at] == docs
                total[hit] += of[at[hit]] if isinstance(of, np.ndarray) else self.scores(of, at[hit])
            stay = total >= need
            if stay.any():
                best.add(total[stay], self.no_id[docs[stay]], self.ids[docs[stay]])


_FOUND = "item_id long, item_key long, doc_id long, score long"


def _search(shared):
    def run(batches):
        items, wanted, weights, n_docs, n_terms, most = shared.value
        best = [Best(most) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i].as_buffer() for c in batch.schema.names[2:]}, wanted, weights, n_docs, n_terms)
                for (_, _, terms), b in zip(items, best, strict=True):
                    shard.search(terms, b)
        rows = [(item, key, None if none else int(d), int(s)) for (item, key, _), b in zip(items, best, strict=True) for s, none, d in zip(b.scores, b.no_id, b.ids, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], [c.split()[0] for c in _FOUND.split(", ")])
        trim()

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(index: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` documents of ``index`` with the highest scores above 0 for each row of ``items`` (item_id, text).

    Equal scores stand by ascending doc_id, null last. Every row of the indexed
    documents is a document, repeated ids too; a null text has no terms. An item
    without terms finds nothing; a repeated row of ``items`` counts once, texts
    with the same id, null too, are items of their own. Empty tables give no rows.
    """
    spark = index.sparkSession
    context = spark.sparkContext
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    wanted = cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("item_key")).where("text is not null").distinct())
    batches = (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // BATCH + 1
    found = spark.createDataFrame([], _FOUND)
    for i in range(batches if n_docs else 0):
        rows = wanted.where(F.pmod("item_key", F.lit(batches)) == i).collect()
        own = [terms_of(r.text) for r in rows]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        shared = context.broadcast(terms)
        df = np.zeros(len(terms), np.int64)
        counts = index.select("terms", "ends").mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in counts.collect():  # a row for each term of the batch
            df[r.term] = r.n
        shared.destroy()
        weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
        packed = [(r.item_id, r.item_key, np.searchsorted(terms, t)) for r, t in zip(rows, own, strict=True)]
        shared = context.broadcast((packed, terms, weights, n_docs, n_terms, most))
        found = found.union(cut(index.mapInArrow(_search(shared), _FOUND)))
        shared.destroy()
    place = Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranking(spark, sf_dir):
    return rank_documents(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranking": op13_ranking}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op13_ranking": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
x AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= {BEST}
"""
}
