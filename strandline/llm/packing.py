"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document's ids (its tokens, then the id 0) fill whole sequences first; the
rest is a piece of 1 to ``LENGTH`` - 1 ids. Only the histogram of the pieces'
lengths reaches the driver. There a linear program chooses how often each
pattern of lengths is cut from a sequence: a knapsack over lengths, by dynamic
programming, prices new patterns against the program's duals until the value is
within ``NEAR`` of its lower bound. Whole parts of the solution are taken, the
rest is rounded up where pieces last. Pieces are ranked among those of their
length on the executors, and a pattern's copies take ranges of ranks. Pieces
beyond all patterns are laid end to end and cut at the sequences' ends.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, table, trim
from strandline.llm.hashing import pieces

#: Ids in a sequence; the id that ends a document.
LENGTH, END = 1024, 0
#: How near the program comes to its lower bound; most columns that it generates (its patterns are right at any time);
#: most ids of padding in a pattern that is used.
NEAR, COLUMNS, PADDING = 5e-4, 1000, 10
#: Characters of a text that are encoded at once.
SPAN = 1 << 20

_GAP = re.compile(r"(?<=\S)(?=[ \n])")


def spans(text: str):
    """Runs of ``text`` of about ``SPAN`` characters. They end before a space or line end that follows a visible character: no token of a byte-level vocabulary reaches over that."""
    low = 0
    while len(text) - low > SPAN and (m := _GAP.search(text, low + SPAN)):
        yield text[low : m.start()]
        low = m.start()
    yield text[low:]


class Ids:
    """Ids of texts by the vocabulary of a rank file; the string of its special token stands for that, as in the vocabulary's own tokenizer."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        from tiktoken import Encoding

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str | None) -> np.ndarray:
        """The ids of a text and the end id."""
        return np.concatenate([*(self.encoding.encode_to_numpy(s, allowed_special="all") for s in spans(text or "")), np.array([END], np.uint32)]).astype("<u4", copy=False)


_PIECES = "part int, nth long, doc_id long, start long, length int, doc_tokens long, ids binary"
_ARROW = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _cut_up(vocabulary: tuple, length: int):
    def run(batches):
        from pyspark import TaskContext

        part, ids, seen = TaskContext.get().partitionId(), Ids(*vocabulary), [0] * (length + 1)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in pieces(texts):
                rows = []
                for doc, text in zip(docs[low:high], texts[low:high], strict=True):
                    own = ids.of(text)
                    for start in range(0, len(own), length):
                        piece = own[start : start + length]
                        rows.append((part, seen[len(piece)], doc, start, len(piece), len(own), piece.tobytes()))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
        trim()

    return run


def token_pieces(docs: DataFrame, vocabulary: tuple, length: int = LENGTH) -> DataFrame:
    """Written pieces of all documents, numbered (``nth``) among those of their length in their ``part``; ids are 32-bit, little-endian."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_cut_up(vocabulary, length), _PIECES))


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most value that fits into each capacity, and the last length taken for it (0: none); ``value`` by length, 0 where none may be taken."""
    most, last = np.zeros(len(value)), np.zeros(len(value), np.int64)
    for c in range(1, len(value)):
        of = value[1 : c + 1] + most[c - 1 :: -1][:c]
        i = int(of.argmax())
        most[c], last[c] = (of[i], i + 1) if of[i] > most[c - 1] + 1e-12 else (most[c - 1], 0)
    return most, last


def _taken(last: np.ndarray, capacity: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while capacity > 0:
        if n := int(last[capacity]):
            out[n] = out.get(n, 0) + 1
        capacity -= n or 1
    return out


def first_patterns(demand: np.ndarray) -> tuple[list[dict[int, int]], list[int]]:
    """Patterns that use up the demand, and the length that each one ends: a basis of the program.

    The longest piece left is filled up by a knapsack over what is left. If
    several lengths end at once, those without a pattern get one of their own.
    """
    size = len(demand) - 1
    left, patterns, ended = demand.astype(float), [], []
    while left.any():
        there = np.flatnonzero(left)
        top, value = int(there[-1]), np.zeros(size + 1)
        value[there] = (there / size) ** 1.05  # a little more for the long ones
        pattern = _taken(knapsack(value[: size - top + 1])[1], size - top)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[n] / k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= times * k
        out = [n for n in pattern if left[n] <= 1e-9]
        left[out] = 0
        patterns += [pattern] + [{n: size // n} for n in out[1:]]
        ended += out
    return patterns, ended


def _inverse(columns: list[dict[int, int]], last: list[int]) -> np.ndarray:
    """Inverse of the matrix of such columns, by substitution: row ``last[j]`` is 0 in all columns after ``j``."""
    order, rows = {r: i for i, r in enumerate(last)}, [[] for _ in last]
    for j, column in enumerate(columns):
        for r, k in column.items():
            rows[order[r]].append((j, k))
    out = np.zeros((len(last), len(last)))
    for i, row in enumerate(rows):
        out[i, last[i]] = 1
        for j, k in row[:-1]:
            out[i] -= k * out[j]
        out[i] /= row[-1][1]
    return out


def column_generation(demand: np.ndarray, near: float = NEAR, most: int = COLUMNS) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Patterns, how often to cut each (fractions), and a lower bound of their sum; ``demand``: pieces by length, from 0 to a sequence's."""
    size = len(demand) - 1
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return [], np.zeros(0), 0.0
    place = {int(n): i for i, n in enumerate(lengths)}
    need = demand[lengths].astype(float)
    patterns, ended = first_patterns(demand)
    inverse = _inverse([{place[n]: k for n, k in p.items()} for p in patterns], [place[n] for n in ended])
    bound = float(need @ lengths) / size
    for step in range(most + 1):
        times, dual = np.maximum(np.einsum("ij,j->i", inverse, need), 0) if step % 500 == 0 else times, inverse.sum(axis=0)
        if times.sum() <= bound * (1 + near) + 1 or step == most:  # less than one sequence to gain
            break
        value = np.zeros(size + 1)
        value[lengths] = np.maximum(dual, 0)
        best, last = knapsack(value)
        bound = max(bound, float(need @ value[lengths]) / best[-1])
        if best[-1] <= 1 + 1e-9:
            break
        pattern = _taken(last, size)
        column = np.zeros(len(lengths))
        for n, k in pattern.items():
            column[place[n]] = k
        way = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(way > 1e-9, times / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        times = np.maximum(times - ratio[out] * way, 0)
        times[out], row = ratio[out], inverse[out] / way[out]
        inverse -= way[:, None] * row
        inverse[out], patterns[out] = row, pattern
    return patterns, times, bound


def whole_patterns(demand: np.ndarray, patterns: list[dict[int, int]], times: np.ndarray, padding: int = PADDING) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies) in whole numbers that the demand has, without patterns of much padding."""
    size, left, copies = len(demand) - 1, demand.copy(), [0] * len(patterns)
    tight = [j for j, p in enumerate(patterns) if sum(n * k for n, k in p.items()) >= size - padding]
    whole = np.floor(times + 1e-9).astype(np.int64)
    for most in (lambda j: int(whole[j]), lambda j: 1):  # whole parts, then fractions from the largest on
        for j in sorted(tight, key=lambda j: (whole[j] - times[j], j)):
            n = min([most(j), *(int(left[n]) // k for n, k in patterns[j].items())])
            copies[j] += n
            for length, k in patterns[j].items():
                left[length] -= n * k
    return [(patterns[j], copies[j]) for j in tight if copies[j]]


def places(demand: np.ndarray) -> tuple[pd.DataFrame, list[tuple[int, int, int]]]:
    """Where ranked pieces go, and the ends of the line: at most a row for each pattern and length in it.

    Pieces of ``size`` with ranks ``low`` to ``high`` - 1 go to sequences from
    ``sequence`` on, ``each`` to one, from ``offset`` on. With ``each`` 0 they lie
    on a line of ids from ``offset`` on, which is cut into sequences; its last
    ids go to sequences (number, first, end) whose lengths are powers of two.
    """
    length = len(demand) - 1
    rows, used, sequence = [], np.zeros(length + 1, np.int64), 0
    if demand[length]:
        rows.append((length, 0, int(demand[length]), 1, 0, 0))
        used[length] = sequence = int(demand[length])
    rest = demand.copy()
    rest[[0, length]] = 0
    patterns, times, _ = column_generation(rest)
    for pattern, copies in whole_patterns(rest, patterns, times):
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, int(used[n]), int(used[n]) + copies * k, k, sequence, offset))
            used[n] += copies * k
            offset += n * k
        sequence += copies
    line = 0
    for n in np.flatnonzero(demand - used):
        rows.append((int(n), int(used[n]), int(demand[n]), 0, sequence, line))
        line += int(n) * int(demand[n] - used[n])
    at, ends = line - line % length, []
    for i in reversed(range(length.bit_length())):
        if (line - at) >> i & 1:
            ends.append((sequence + line // length + len(ends), at, at + (1 << i)))
            at += 1 << i
    return pd.DataFrame(rows, columns=["size", "low", "high", "each", "sequence", "offset"]), ends


def pack_documents(docs: DataFrame, vocabulary: tuple, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece of every document.

    ``ids`` are the piece's ids, 32-bit and little-endian; the pieces of a
    document, by ``start``, give all its ids. A null or empty text is the end id
    alone; rows without doc_id and repeated rows are documents of their own; an
    empty table gives no rows. ``vocabulary``: the path of a rank file, on every
    executor, the pattern that splits texts, and the ids of special tokens, which
    their strings in a text become. Sequences are numbered from 0 without gaps.
    """
    spark = docs.sparkSession
    rows = token_pieces(docs, vocabulary, length)
    each = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    demand = np.zeros(length + 1, np.int64)
    for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        demand[r.length] = r.n
    where, ends = places(demand)
    where = spark.createDataFrame(where, "size int, low long, high long, each int, sequence long, offset long")
    ranked = rows.join(base.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # of bounded size: patterns are at most as many as lengths, and a pattern has no more than the square root of 2 * length different ones
    held = ranked.join(F.broadcast(where), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    held = held.withColumn("at", F.expr("offset + (rank - low) * size"))
    whole = F.struct(F.expr("sequence + (rank - low) div each").alias("sequence_id"), F.expr("offset + (rank - low) % each * size").alias("offset"), F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    at = F.col("at")
    line_end = ends[0][1] if ends else None

    def on_line(number, first, end):
        return F.struct(number.cast("long").alias("sequence_id"), (F.greatest(first, at) - first).cast("long").alias("offset"), (F.greatest(first, at) - at).cast("long").alias("a"), (F.least(end, at + F.col("size")) - at).cast("long").alias("b"))

    cuts = F.transform(F.expr(f"sequence(at div {length}, (at + size - 1) div {length})"), lambda s: on_line(F.col("sequence") + s, s * length, (s + 1) * length))
    if ends:
        cuts = F.concat(F.filter(cuts, lambda s: s["sequence_id"] - F.col("sequence") < line_end // length), F.array(*[on_line(F.lit(n), F.lit(a), F.lit(b)) for n, a, b in ends]))
    cuts = F.filter(cuts, lambda s: s["a"] < s["b"])
    out = held.select("doc_id", F.col("start").alias("begin"), "doc_tokens", "ids", F.inline(F.when(F.col("each") > 0, F.array(whole)).otherwise(cuts)))
    bytes_ = F.substring("ids", (F.col("a") * 4 + 1).cast("int"), ((F.col("b") - F.col("a")) * 4).cast("int"))
    return out.select("doc_id", (F.col("begin") + F.col("a")).alias("start"), (F.col("b") - F.col("a")).alias("length"), bytes_.alias("ids"), "doc_tokens", "sequence_id", "offset")


def vocabulary_50k() -> tuple:
    """The ranks of ``byte_bpe_50k.json``: the same ids (a test holds them against each other), several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def op12_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary_50k())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
ORACLES: dict[str, str] = {}
