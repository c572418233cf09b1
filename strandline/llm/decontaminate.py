"""Benchmark decontamination by latent semantic retrieval.

Passages (runs of ``BLOCK`` words, ``BLOCKS`` of them, one block apart) become
TF-IDF vectors over hashed words. A distributed randomised SVD gives a latent
space; passages whose cosine with a benchmark item in that space is high are
candidates, and a candidate is a hit if the longest common subsequence of the
item's words and the words around the passage covers the item, and words of its
answer are there. A paraphrase, whose words are partly others, passes with less
of the item in common if it lies very near to the item in the latent space.

A space of fixed rank cannot hold any number of items, and one that holds them
may lose a short item among heavier words. Its rank grows with the items, and an
inverted index of each item's heaviest words, with ``KEYED`` of its square, gives
candidates as well, passages that have ``HIT`` of it. As a passage with
``VERY_NEAR`` of an item's square has at least ``VERY_NEAR`` + ``KEYED`` - 1 of
it in those words, none is lost.

Documents' hashed words, two bytes each, are written once. Document frequencies
cover all documents. For each batch of about ``BATCH`` items, the SVD runs over
the passages of all its items and of all documents, in all hashed words; both
parts count alike. Every passage of every document is searched. Only the basis
and the frequencies (bounded sizes) and the batch are sent to tasks and released
after its passes over the documents; the driver holds one batch at a time. An
item of more than ``LONG`` words is sought by its parts, as long as a passage and
half overlapping, and compared as a whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, lean, table, trim
from strandline.llm.hashing import pieces, word_hashes

#: Hashed words, words in a block, blocks in a passage; latent dimensions, at least, at most, and items for each one.
WORDS, BLOCK, BLOCKS, RANK, MOST_RANK, EACH = 1 << 14, 16, 3, 96, 384, 16
PASSAGE = BLOCK * BLOCKS
#: Words from which on an item is sought by its parts; items in a batch.
LONG, BATCH = 2 * PASSAGE, 16_384
#: Rounds of the SVD's iteration; blocks of a word from which on they are summed by a product.
ROUNDS, OFTEN = 2, 24
#: Nothing reads this: the basis is fitted on all documents. A test of the time of its sample sets it.
SAMPLE = 0
#: Least latent cosine of a candidate, and least share of the passage's length that points to the item, for an item of a
#: passage's length (that of a shorter one, or one of lighter words than documents have on average, is lower).
COSINE, SHARE = 0.4, 0.2
#: Least share of an item in the common subsequence, for any candidate and for one of at least the cosine ``VERY_NEAR``.
COVERED, PARAPHRASED, VERY_NEAR = 0.8, 0.55, 0.5
#: Shares of an item's square: in its heaviest words, and of that in a candidate.
KEYED, HIT = 0.9, 0.25
#: Least share of its answer's words, and words of an item that stand for its answer where it has none: the rarest that documents have.
ANSWERED, KEY_WORDS = 1 / 3, 6
#: Parts that passages are held against at once; words of the items' vocabulary, times candidates, that are looked up at once.
STRIPE, SEEN = 2048, 1 << 22


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The hashed word of each hash; those that are such already, of 16 bits, stay."""
    return (hashes if hashes.dtype == np.int16 else hashes >> np.uint64(50)).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort, which is several times faster than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _word_lists(f: pd.DataFrame, most: int = 1 << 17):
    """Words of ``f``'s texts and where each text's begin, a piece at a time; ``f`` has texts, or what :func:`_hashed` made of them."""
    if "words" in f:
        yield from ((np.frombuffer(words, np.int16), np.frombuffer(at, np.int64)) for words, at in zip(f.words, f.starts, strict=True))
        return
    texts = f.text.tolist()
    yield from (word_hashes(texts[low:high]) for low, high in pieces(texts, most))


_HASHED = "words binary, starts binary, is_item boolean"


@lean
def _hashed(frames):
    for f in frames:
        for h, at in _word_lists(f):
            yield pd.DataFrame({"words": [buckets(h).astype(np.int16).tobytes()], "starts": [at.astype(np.int64).tobytes()], "is_item": False})


@lean
def _frequencies(frames):
    df, n = np.zeros(WORDS, np.int64), 0
    for f in frames:
        for h, at in _word_lists(f):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            df += np.bincount(_distinct(row * WORDS + buckets(h)) % WORDS, minlength=WORDS)
            n += len(at) - 1
    used = np.flatnonzero(df)
    yield pd.DataFrame({"word": np.append(used, -1), "n": np.append(df[used], n)})


def document_frequencies(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each hashed word, and all documents, from what :func:`_hashed` made of their texts."""
    rows = hashed.mapInPandas(_frequencies, "word int, n int")
    got = rows.groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(WORDS, np.int64)
    real = got.word >= 0
    df[got.word[real].to_numpy(np.int64)] = got.n[real]
    return df, int(got.n[~real].sum())


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smooth inverse document frequencies: 1 for a word of all documents, so that no word weighs nothing."""
    return (1 + np.log((1 + n) / (1 + df))).astype(np.float32)


def usual_square(df: np.ndarray, idf: np.ndarray) -> float:
    """Mean squared weight of a document's words."""
    return float((df * idf.astype(np.float64) ** 2).sum() / df.sum()) if df.any() else 1.0


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the blocks of all texts begin, their texts, and their first words within those."""
    sizes = np.diff(at)
    n = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
    return at[text] + first, text, first


def _runs(of_block: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What ``BLOCKS`` blocks in a row sum to, from each block on, within its text."""
    out = of_block.copy()
    for j in range(1, BLOCKS):
        same = text[j:] == text[:-j]
        out[: len(out) - j][same] += of_block[j:][same]
    return out


def padded(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with a row of zeros at its end, which stands for no word."""
    return vectors if len(vectors) > WORDS else np.append(vectors, np.zeros((1, vectors.shape[1]), np.float32), axis=0)


class Passages:
    """All passages of some texts: their latent ``sums`` and TF-IDF ``length``, ``text`` and ``first`` word. A word counts once in a block.

    ``vectors`` has a row for each hashed word, times its weight, and may have one of zeros for no word (:func:`padded`).
    """

    def __init__(self, h: np.ndarray, at: np.ndarray, idf: np.ndarray, vectors: np.ndarray):
        self.begin, self.text, self.first = _blocks(at)
        nth = np.arange(BLOCK)
        self.words = np.append(buckets(h), WORDS).astype(np.int16)[np.minimum(self.begin[:, None] + nth, len(h))]  # a row for each block; WORDS stands for no word
        self.words[nth >= np.diff(np.append(self.begin, at[-1]))[:, None]] = WORDS
        self.words.sort(axis=1)
        self.words[:, 1:][self.words[:, 1:] == self.words[:, :-1]] = WORDS
        vectors, squares = padded(vectors), np.append(idf**2, np.float32(0))
        sums, square = (np.zeros((len(self.begin), *x.shape[1:]), np.float32) for x in (vectors, squares))
        taken = np.empty_like(sums)
        for word in np.ascontiguousarray(self.words.T, np.intp):
            sums += np.take(vectors, word, axis=0, out=taken, mode="clip")
            square += squares[word]
        self.sums, self.length = _runs(sums, self.text), np.sqrt(_runs(square, self.text))

    def gram(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, rows): what the passages that ``whole`` marks, with unit length, add to A'(A basis) before weights."""
        each = np.where(whole[:, None], self.sums / np.maximum(self.length, 1e-9)[:, None] ** 2, 0)
        of_block = each.copy()
        for j in range(1, BLOCKS):
            same = self.text[j:] == self.text[:-j]
            of_block[j:][same] += each[: len(each) - j][same]
        block, nth = np.nonzero(self.words < WORDS)
        word = self.words[block, nth]
        order = np.argsort(word, kind="stable")
        word, block = word[order], block[order]
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        n = np.diff(np.append(start, len(word)))
        by = np.argsort(-n, kind="stable")
        n, first = n[by], start[by]
        often = int(np.searchsorted(-n, -OFTEN, "right"))  # words of many blocks are summed by one product, the others a block of each at a time
        marks = np.zeros((often, len(of_block)), np.float32)
        row, at = _spread(first[:often], first[:often] + n[:often])
        marks[row, block[at]] = 1
        rest, seldom, left = of_block[block[first[often:]]], first[often:], n[often:]
        taken = np.empty_like(rest)
        for j in range(1, int(left[0]) if len(left) else 0):
            k = int(np.searchsorted(-left, -j))  # words of more than j blocks
            rest[:k] += np.take(of_block, block[seldom[:k] + j], axis=0, out=taken[:k], mode="clip")
        out = np.empty((len(by), of_block.shape[1]), np.float32)
        out[by[:often]], out[by[often:]] = marks @ of_block, rest
        return word[start], out


def _gram(shared):
    """Rows of A'(A basis), A the TF-IDF passages of a task's texts with unit length; documents and items apart."""

    def run(frames):
        idf, q = shared.value
        vectors, totals = padded(q * idf[:, None]), {}
        for f in frames:
            for is_item, g in f.groupby("is_item"):
                total = totals.setdefault(bool(is_item), np.zeros_like(q))
                for h, at in _word_lists(g, (1 << 17) * RANK // max(RANK, q.shape[1])):
                    if len(h):
                        p = Passages(h, at, idf, vectors)
                        word, rows = p.gram((p.first == 0) | (p.first + PASSAGE <= np.diff(at)[p.text]))
                        total[word] += rows
        for is_item, total in totals.items():
            total *= idf[:, None]
            used = np.flatnonzero(np.abs(total).max(axis=1))
            for i in range(0, WORDS, 256):
                some = used[(used >= i) & (used < i + 256)]
                if len(some):
                    yield pd.DataFrame({"is_item": [is_item], "block": [i // 256], "words": [some.astype(np.int32).tobytes()], "blob": [total[some].tobytes()]})

    return lean(run)


_BLOBS = "is_item boolean, block int, words binary, blob binary"


@lean
def _added(frames):
    """The sums of such rows by ``is_item`` and ``block``, from rows in that order: one sum is held at a time, however many tasks they come from."""

    def done():
        used = np.flatnonzero(np.abs(total).max(axis=1))
        return pd.DataFrame({"is_item": [key[0]], "block": [key[1]], "words": [(used + key[1] * 256).astype(np.int32).tobytes()], "blob": [total[used].tobytes()]})

    key = total = None
    for f in frames:
        for *at, words, blob in zip(f.is_item, f.block, f.words, f.blob, strict=True):
            word = np.frombuffer(words, np.int32)
            rows = np.frombuffer(blob, np.float32).reshape(len(word), -1)
            if key != at:
                if key:
                    yield done()
                key, total = at, np.zeros((256, rows.shape[1]), np.float32)
            total[word - at[1] * 256] += rows
    if key:
        yield done()


def latent_basis(texts: DataFrame, idf: np.ndarray, rank: int = RANK, hashed: DataFrame | None = None, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors (a row for each hashed word) of the TF-IDF passages of all ``texts`` (text, is_item)
    and of all that ``hashed`` has of others.

    Randomised range finding: random directions go through A'A a few times,
    summed over tasks. The parts of documents and of items are scaled to the
    same spectral norm, so that items show however few they are.
    """
    context = texts.sparkSession.sparkContext
    q = _orthonormal(np.random.default_rng(seed).standard_normal((WORDS, rank), np.float32))
    for _ in range(ROUNDS):
        shared = context.broadcast((idf, q))
        rows = texts.mapInPandas(_gram(shared), _BLOBS)
        rows = rows.union(hashed.mapInPandas(_gram(shared), _BLOBS)) if hashed else rows
        rows = rows.withColumn("task", F.spark_partition_id()).repartition("is_item", "block").sortWithinPartitions("is_item", "block", "task")
        got = rows.drop("task").mapInPandas(_added, _BLOBS)
        parts = {}
        for r in got.toLocalIterator():
            part = parts.setdefault(r.is_item, np.zeros((WORDS, rank), np.float32))
            part[np.frombuffer(r.words, np.int32)] = np.frombuffer(r.blob, np.float32).reshape(-1, rank)
        if not parts:  # no words at all
            return np.zeros((WORDS, rank), np.float32)
        q = _orthonormal(sum(p / max(1e-12, float(np.sqrt(np.linalg.eigvalsh(p.T @ p)[-1]))) for p in parts.values()))
        shared.destroy()
    trim()
    return q


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``z``, by way of their products, twice."""
    for _ in range(2):
        g = sum(z[i : i + 4096].astype(np.float64).T @ z[i : i + 4096] for i in range(0, len(z), 4096))
        values, v = np.linalg.eigh(g)
        z = z @ (v / np.sqrt(np.maximum(values, 1e-12 * max(values[-1], 1e-30)))).astype(np.float32)
    return z


def common_subsequence(item: list, words: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(item)) - 1
    for w in words:
        if m := places.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


def _laid(vocabulary: np.ndarray, own: list) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``vocabulary`` of all words of ``own``, one list after the other, and where each list begins (one more entry than lists)."""
    return np.searchsorted(vocabulary, np.array([w for x in own for w in x], np.uint64)), np.cumsum([0, *map(len, own)])


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges: which range, and the place."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def parts_of(words: list) -> list[list]:
    """An item's words, or if they are many, its runs of a passage's length, each half a passage on, the last at its end."""
    n = PASSAGE
    if len(words) <= LONG:
        return [words]
    return [words[i : i + n] for i in [*range(0, len(words) - n, n // 2), len(words) - n]]


class Items:
    """A batch of items: ids, hashed words and the words of their answers (``known``: the hashed words of documents); of their parts, latent unit vectors, the share to ask of a passage, and items."""

    def __init__(self, rows: list, idf: np.ndarray, usual: float, vectors: np.ndarray, known: np.ndarray | None = None):
        known = np.ones(WORDS, bool) if known is None else known
        self.ids, self.words, self.keys, parts, shares, items = [], [], [], [], [], []
        self.idf, heavy = idf, []  # word, its share of the part's square, part
        for i, r in enumerate(rows):
            w, answer = (word_hashes([x])[0].tolist() for x in (r[1], r[2] if len(r) > 2 else None))
            self.ids.append(r[0])
            self.words.append(w)
            self.keys.append(set(answer or sorted(set(w), key=lambda x: (not known[x >> 50], -idf[x >> 50], x))[:KEY_WORDS]))
            for p in parts_of(w):
                b = np.unique(buckets(np.array(p, np.uint64)))
                z = vectors[b].sum(axis=0)
                heavy += [(w, share, len(parts)) for w, share in self.heaviest(p)]
                parts.append(z / max(1e-9, float(np.linalg.norm(z))))
                # an item of light words (those of a large group of copies) is a small part of a passage's vector even verbatim
                shares.append(np.sqrt(min(1.0, len(p) / PASSAGE, float((idf[b] ** 2).sum()) / (PASSAGE * usual))))
                items.append(i)
        self.latent, self.share, self.item = np.array(parts, np.float32), np.array(shares, np.float32), np.array(items)
        heavy.sort()
        word = np.array([x[0] for x in heavy], np.uint64)
        self.heavy, first = np.unique(word, return_index=True)
        self.first, self.of_part = np.append(first, len(heavy)), np.array([x[2] for x in heavy], np.int64)
        self.square = np.array([x[1] for x in heavy], np.float32)
        self.vocabulary = np.unique(np.array([w for own in (*self.words, *self.keys) for w in own], np.uint64))
        self.marked = np.zeros(1 << 20, bool)
        self.marked[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.heavy_of = np.full(len(self.vocabulary) + 1, -1)  # of a word of the vocabulary, its place among the heavy ones
        self.heavy_of[np.searchsorted(self.vocabulary, self.heavy)] = np.arange(len(self.heavy))
        self.own_words, self.own_keys = (_laid(self.vocabulary, own) for own in (self.words, self.keys))

    def squares(self, words: list) -> dict:
        """Each word's share of the squared length of such words."""
        own = {w: float(self.idf[w >> 50]) ** 2 for w in words}
        total = sum(own.values())
        return {w: x / total for w, x in own.items()}

    def heaviest(self, words: list):
        """(word, share) of the heaviest words, until they hold ``KEYED``."""
        had = 0.0
        for w, x in sorted(self.squares(words).items(), key=lambda p: (-p[1], p[0])):
            if had >= KEYED:
                return
            had += x
            yield w, x

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary of all items, or its size for a word of none."""
        out = np.full(len(h), len(self.vocabulary), np.int32)
        at = np.flatnonzero(self.marked[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == h[at]
        out[at[same]] = place[same]
        return out

    def outside(self, places: np.ndarray, begin: np.ndarray, text: np.ndarray) -> set:
        """(passage, item) of passages that have ``HIT`` of the heaviest words of an item's part; ``begin`` and ``text`` of their blocks."""
        if not len(self.heavy):
            return set()
        key = self.heavy_of[places]
        at = np.flatnonzero(key >= 0)
        each = _distinct((np.searchsorted(begin, at, "right") - 1) * len(self.heavy) + key[at])
        block, key = each // len(self.heavy), each % len(self.heavy)
        n = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        code, mass, n_parts = np.repeat(block, n) * len(self.item) + self.of_part[entry], self.square[entry], len(self.item)
        code, where = np.unique(code, return_inverse=True)
        mass, block, part = np.bincount(where, mass), code // n_parts, code % n_parts
        first = np.concatenate([block - j for j in range(BLOCKS)])  # passages that the block is in
        same = (first >= 0) & (text[np.maximum(first, 0)] == np.tile(text[block], BLOCKS))
        code, where = np.unique(first[same] * n_parts + np.tile(part, BLOCKS)[same], return_inverse=True)
        code = code[np.bincount(where, np.tile(mass, BLOCKS)[same], len(code)) >= HIT]
        return set(zip((code // n_parts).tolist(), self.item[code % n_parts].tolist()))

    def candidates(self, sums: np.ndarray, length: np.ndarray):
        """(passage, item, cosine) of passages that lie near to an item's part, a stripe of parts at a time."""
        norm = np.maximum(np.linalg.norm(sums, axis=1), 1e-9)
        for low in range(0, len(self.item), STRIPE):
            part = slice(low, low + STRIPE)
            product = sums @ self.latent[part].T
            p, r = np.divmod(np.flatnonzero(product >= COSINE * norm[:, None]), product.shape[1])
            points = product[p, r] >= SHARE * self.share[part][r] * length[p]
            p, r = p[points], r[points]
            yield p, self.item[low + r], product[p, r] / norm[p]

    def having(self, places: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range of ``places`` how many words of its ``item`` are there, and how many of the words that answer it."""
        words, answers = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        size = len(self.vocabulary) + 1
        many = max(1, SEEN // max(size, int((high - low).max(initial=0))))
        for i in range(0, len(item), many):
            some = slice(i, i + many)
            n = len(item[some])
            seen = np.zeros(n * size, bool)
            each, at = _spread(low[some], high[some])
            seen[each * size + places[at]] = True
            seen[size - 1 :: size] = False
            for out, (own, start) in ((words, self.own_words), (answers, self.own_keys)):
                each, at = _spread(start[item[some]], start[item[some] + 1])
                out[some] = np.bincount(each[seen[each * size + own[at]]], minlength=n)
        return words, answers

    def found(self, h: np.ndarray, at: np.ndarray, idf: np.ndarray, vectors: np.ndarray) -> dict:
        """(text, item) -> (words in common, first word of the passage, cosine)."""
        near, places = Passages(h, at, idf, vectors), self.places(h)
        text, first, best = near.text, near.first, {}
        sizes, n_keys = (np.diff(start) for _, start in (self.own_words, self.own_keys))
        by_words = np.array(sorted(self.outside(places, near.begin, text)), np.int64).reshape(-1, 2)
        for p, i, cosine in itertools.chain(self.candidates(near.sums, near.length), [(*by_words.T, np.full(len(by_words), np.nan))]):
            # the words around, as far as the item is long; what lacks the item's words or its answer's is in no hit
            low, high = np.maximum(at[text[p]], near.begin[p] - sizes[i]), np.minimum(at[text[p] + 1], near.begin[p] + PASSAGE + sizes[i])
            words, answers = self.having(places, low, high, i)
            ok = (answers >= ANSWERED * n_keys[i]) & (words >= np.where(cosine >= VERY_NEAR, PARAPHRASED, np.where(np.isnan(cosine), PARAPHRASED, COVERED)) * sizes[i])
            found = zip(*(x[ok].tolist() for x in (p, i, cosine, low, high, words)), strict=True)
            for p, i, cosine, low, high, words in sorted(found, key=lambda c: (0 if c[2] != c[2] else -c[2], c[0])):
                t, item = int(text[p]), self.words[i]
                m, had = len(item), best.get((t, i), (0,))[0]
                if had == m:
                    continue
                around = h[low:high].tolist()
                if cosine != cosine:
                    have = set(around)
                    cosine = sum(x for w, x in self.squares(item).items() if w in have)
                least = (PARAPHRASED if cosine >= VERY_NEAR else COVERED) * m
                if words < max(least, had + 1):
                    continue
                n = common_subsequence(item, around)
                if n >= least and n > had:
                    best[t, i] = n, int(first[p]), cosine
        return best


def _search(shared):
    def run(frames):
        idf, q, items = shared.value
        vectors = padded(q * idf[:, None])
        for f in frames:
            ids, out = f.row_key.tolist(), []
            for low, high in pieces(f.text.tolist(), (1 << 18) * RANK // max(RANK, q.shape[1])):
                h, at = word_hashes(f.text.iloc[low:high].tolist())
                out += [(ids[low + t], items.ids[i], n, len(items.words[i]), w, c) for (t, i), (n, w, c) in items.found(h, at, idf, vectors).items()]
            if out:
                yield pd.DataFrame(out, columns=["row_key", "item_id", "common", "item_words", "near_word", "cosine"])

    return lean(run)


def _batches(wanted: DataFrame):
    """The rows of ``wanted``, a batch of about ``BATCH`` at a time by the hash of their ids."""
    n = wanted.count() // BATCH + 1
    for i in range(n):
        yield [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, item_id, common, item_words, near_word, cosine: the items found in each row of ``docs`` (``key``, a long or a string, and text).

    ``common``: words of the item in order around the passage that starts at
    word ``near_word``; ``cosine``: that passage's with the item in the latent
    space, or if it was found by the item's heaviest words, the share of the
    item's square that is there. A row without key, text or words, and an item without id or words,
    is in no hit; repeated rows give repeated hits; an empty table gives none.
    ``benchmark`` has item_id and text, and may have answer. Case does not count.
    """
    spark = docs.sparkSession
    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"
    schema = f"row_key {kind}, item_id long, common int, item_words int, near_word int, cosine double"
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"), *([F.lower("answer").alias("answer")] if "answer" in benchmark.columns else [])).where(r"item_id is not null and text rlike '[^\\x20\\x09-\\x0D]'")
    wanted = cut(wanted.dropDuplicates())
    docs = docs.select(F.col(key).cast(kind).alias("row_key"), F.lower(F.col("text").cast("string")).alias("text")).where("row_key is not null and text is not null")
    hashed = cut(docs.select("text").mapInPandas(_hashed, _HASHED))
    df, n = document_frequencies(hashed)
    idf = weights(df, n)
    found = spark.createDataFrame([], schema)
    for rows in _batches(wanted) if n else ():
        if rows:
            batch = cut(spark.createDataFrame([(r[1], True) for r in rows], "text string, is_item boolean").repartition(2))
            q = latent_basis(batch, idf, min(MOST_RANK, max(RANK, len(rows) // EACH)), hashed)
            shared = spark.sparkContext.broadcast((idf, q, Items(rows, idf, usual_square(df, idf), q * idf[:, None], df > 0)))
            found = found.union(cut(docs.mapInPandas(_search(shared), schema)))
            shared.destroy()
    return found.withColumnRenamed("row_key", key)


def op2_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("cosine")


QUERIES = {"op2_leaks": op2_leaks}
ORACLES: dict[str, str] = {}
