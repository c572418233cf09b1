"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3
characters) over all training texts. A text gets the language whose profile
its own most frequent n-grams are least out of place against: the sum of the
differences of rank, with the profile's length for an n-gram it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import lean, table

#: N-grams in a profile; the longest n-gram; characters of a text that are looked at together.
PROFILE, LONGEST, CHUNK = 400, 3, 1 << 18
#: Bits of a code point; an n-gram's code is its characters' code points, a space as 0, the last one lowest.
_BITS = 21
_is_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _is_letter[0]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts of several such pairs, or of none."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts; a run of characters other than letters, or an end, counts as one space.

    A long text is taken in chunks that hand on their last two characters, so
    that memory does not follow its length.
    """
    parts, last = [], np.zeros(1, np.int64)
    for low in range(0, len(text), CHUNK):
        points = np.frombuffer(text[low : low + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[points], points, 0).astype(np.int64)
        if low + CHUNK >= len(text):
            c = np.append(c, 0)
        c = np.concatenate([last, c[(c > 0) | (np.append(last[-1:], c[:-1]) > 0)]])
        new = len(last)  # what ends here or later was not counted yet
        two = (c[:-1] << _BITS) + c[1:]
        three = (two[:-1] << _BITS) + c[2:]
        # an n-gram of two or three characters that begins with a space is marked, so that none equals a shorter one
        one = c[new:][c[new:] > 0]
        two, three = two[new - 1 :], three[max(0, new - 2) :][c[max(0, new - 2) + 1 : -1] > 0]
        mark = lambda x, n: np.where(x >> (_BITS * (n - 1)) > 0, x, -1 - x)
        codes = np.concatenate([one, mark(two, 2), mark(three, 3) - np.where(three >> (2 * _BITS) > 0, 0, np.int64(1) << 62)])
        parts.append(np.unique(codes, return_counts=True))
        last = c[-2:]
    return _merged(parts) if len(parts) != 1 else parts[0]


@lean
def _counts(frames):
    """(lang, gram, n) of a task's texts, combined as they come."""
    held: dict = {}

    def flush():
        for lang, parts in held.items():
            grams, n = _merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
        held.clear()

    size = 0
    for f in frames:
        for lang, text in zip(f.lang, f.text, strict=True):
            held.setdefault(lang, []).append(got := ngrams(text))
            size += len(got[0])
            if size > 1 << 20:
                yield from flush()
                size = 0
    yield from flush()


def learn(train: DataFrame, length: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank) of the languages' profiles from all rows of ``train`` (lang, text).

    Counts are combined in each task and summed over all; the driver gets
    ``length`` rows for each language. Rows with a null in either column teach nothing.
    """
    rows = train.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInPandas(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return [tuple(r) for r in counts.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "gram", "rank").collect()]


class Profiles:
    """Learned profiles (lang, gram, rank) as one table of ranks, and the prediction of a text."""

    def __init__(self, profiles: list[tuple[str, int, int]], length: int):
        self.length, self.langs = length, sorted({lang for lang, _, _ in profiles})
        self.grams = np.unique(np.array([g for _, g, _ in profiles], np.int64))
        self.ranks = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, np.int64)
        for lang, g, r in profiles:
            self.ranks[np.searchsorted(self.grams, g), self.langs.index(lang)] = r - 1

    def predict(self, text) -> tuple[str, float, float]:
        found, n = ngrams(text) if self.langs and isinstance(text, str) and text else (np.zeros(0), np.zeros(0))
        if not len(found) or not (found > 0).any():  # no letter, so no n-gram of one
            return "und", 0.0, 0.0
        length = self.length
        if len(found) > length:  # what has more than the length-th count is in; ties by code
            keep = n >= np.partition(n, len(n) - length)[len(n) - length]
            found, n = found[keep], n[keep]
        found = found[np.lexsort((found, -n))][:length]
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        theirs = self.ranks[np.where(self.grams[at] == found, at, len(self.grams))]
        out = np.where(theirs < 0, length, np.abs(theirs - np.arange(len(found))[:, None])).sum(axis=0) / (length * len(found))
        best = int(np.argmin(out))
        rest = np.delete(out, best)
        return self.langs[best], float(1 - out[best]), float(rest.min() - out[best]) if len(rest) else 1.0


def identify(docs: DataFrame, profiles: list[tuple[str, int, int]], length: int = PROFILE, name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` of lang_pred, score and margin.

    ``lang_pred`` is a language of the profiles, or ``und`` with score 0 for a
    null text or one without a letter. ``score`` is 1 less the mean distance as
    a share of its maximum; ``margin`` is by how much the second language's
    distance is larger. Only the text is an input of the prediction. Repeated
    rows get equal predictions; of languages at the same distance the first by
    code point is predicted; an empty table gives no rows.
    """
    model = Profiles(profiles, length)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    # not deterministic for the optimizer only, so that a filter on the result does not have it made twice
    predict = F.pandas_udf(lean(run), "lang_pred string, score double, margin double").asNondeterministic()
    return docs.withColumn(name, predict(F.col("text").cast("string")))


def is_held_out(doc_id):
    """True where crc32 of the id as text leaves 2 divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_of(docs: DataFrame, name: str = "language") -> DataFrame:
    """:func:`identify` with profiles learned from the rows of ``docs`` that are not held out and have an id."""
    train = docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    return identify(docs, learn(train), name=name)


def op8_language(spark, sf_dir):
    docs = language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
