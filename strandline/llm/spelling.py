"""Grouping of spelling variants by a frontier of states in a relational trie.

The words' trie is a table of edges (node, label, child). A state is (word, what
is left of it from its position on, node, edits). Level by level the states are
joined with the edges out of their nodes; a state without an edit may take one
where word and label part (a code point replaced, deleted or inserted), one with
an edit must match. A state with one edit that ends with its word at the end of
another has found a neighbour.

Two words that are one edit apart agree in the first or in the last half of
either. So each word is walked twice, forwards and backwards, from the node of
its own first half on, and tries (one for each way) hold second halves only.
Nodes in which nothing branches, begins or ends are passed over, so that there
are as many levels as branchings, however long the words are. Nodes are 64-bit
hashes of what leads to them; neighbours are compared at the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import counted, cut, keyed, table, trim
from strandline.llm.hashing import mix

#: Code points and occurrences of a word at least; a run whose checksum this divides loses a code point;
#: how many times as often a form stands in the corpus.
LETTERS, OCCURRENCES, ALTERED, OFTEN = 6, 5, 199, 5
#: Bytes of a text that are split at once; distinct runs that a task counts before it sends them.
SPAN, HELD = 1 << 20, 1 << 18

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A-Z are lower-cased before; C3 begins the code points C0 to FF
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_STEP, _ODD = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)


def _spans(data: bytes):
    low = 0
    while len(data) - low > SPAN and (m := _BREAK.search(data, low + SPAN)):
        yield data[low : m.start()]
        low = m.start()
    yield data[low:]


def runs_of(doc_id: int | None, text: str) -> Counter:
    """Occurrences of a document's runs, altered where their checksum says so, as UTF-8."""
    head, out = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id), Counter()
    for span in _spans(text.encode("utf-8", "surrogatepass").lower()):
        for run, n in Counter(_RUN.findall(span)).items():
            h = zlib.crc32(run, head)
            if h % ALTERED == 0:
                s = run.decode()
                run = (s[: h % len(s)] + s[h % len(s) + 1 :]).encode()
            out[run] += n
    return out


def _count(batches):
    held: Counter = Counter()

    def rows():
        kept = [(w.decode(), n) for w, n in held.items() if len(w) >= LETTERS]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.update(runs_of(doc_id, text))
            if len(held) > HELD:
                yield rows()
    yield rows()
    trim()


def corpus_words(docs: DataFrame) -> DataFrame:
    """word, n: words of all texts of ``docs`` (doc_id, text) that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = rows.mapInArrow(_count, "word string, n long").where(F.length("word") >= LETTERS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def nodes_of(points: np.ndarray, way: int) -> np.ndarray:
    """The node that each prefix (from none to all) of some code points leads to; ``way`` 0 forwards, 1 backwards."""
    power = np.full(len(points) + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.append(np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64))
    return mix(total + (np.arange(len(total), dtype=np.uint64) * np.uint64(2) + np.uint64(way)) * _ODD).view(np.int64)


def _paths(batches):
    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(word)
            points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
            for way in (0, 1):
                own = points[::-1] if way else points
                low, begin = (n - 1) // 2, n // 2 if way == 0 else n - n // 2  # words one shorter or longer begin from ``low`` on
                at = np.arange(low, n + 1)
                after = np.append(own[low:].astype(np.int32), -1)
                columns = (np.full(len(at), number), np.full(len(at), way), at, nodes_of(own, way)[low:], after, (at == begin) | (at == n))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))], ["word_id", "way", "at", "node", "after", "stop"])


def _whole_batches(run, most: int = 1 << 16):
    """``run`` with its small batches put together."""

    def together(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return together


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (node, label, first, child, end, end_n, nexts) of the tries of ``words`` (word_id, word, n), and each word's first states.

    ``first``: the label's first code point; ``end``: the word that ends in
    ``child``, and its ``n``; ``nexts``: the first code points of the edges out of ``child``.
    """
    paths = cut(words.select("word_id", "word").mapInArrow(_whole_batches(_paths), "word_id long, way int, at int, node long, after int, stop boolean"))
    after = F.when(F.col("after") >= 0, F.col("after"))
    kept = paths.groupBy("node").agg(F.bool_or("stop").alias("stop"), (F.min(after) < F.max(after)).alias("branches")).where("stop or branches").select("node")
    marks = paths.join(kept, "node").groupBy("word_id", "way").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("marks"))
    own = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    marks = cut(marks.join(words, "word_id").withColumn("word", own))
    n = F.length("word")
    follows = F.zip_with(F.slice("marks", 1, F.size("marks") - 1), F.slice("marks", 2, F.size("marks")), lambda a, b: F.struct(a["node"].alias("node"), F.substr("word", a["at"] + 1, b["at"] - a["at"]).alias("label"), b["node"].alias("child"), (b["at"] == n).alias("ends")))
    edges = marks.where(F.size("marks") > 1).select("word", "way", "n", F.inline(follows))
    end = F.when(F.col("ends"), F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")))
    edges = edges.groupBy("node", "label", "child").agg(F.max(end).alias("end"), F.max(F.when(F.col("ends"), F.col("n"))).alias("end_n"))
    edges = cut(edges.withColumn("first", F.substring("label", 1, 1)))
    nexts = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("nexts"))  # as many as letters
    edges = edges.join(nexts, "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit("")))
    begin = F.when(F.col("way") == 0, F.floor(n / 2)).otherwise(n - F.floor(n / 2)).cast("int")
    states = marks.select("word_id", F.substr("word", begin + 1, n).alias("rest"), F.filter("marks", lambda m: m["at"] == begin)[0]["node"].alias("node"), F.lit(0).alias("edits"))
    return cut(edges), states


def moves(rest: str, label: str):
    """(what is then left of a word, edits) for every way to pass an edge with ``label`` by one edit at most, made where the two part."""
    i, most = 0, min(len(rest), len(label))
    while i < most and rest[i] == label[i]:
        i += 1
    if i == len(label):
        yield rest[i:], 0
        return
    if rest.startswith(label[i + 1 :], i):  # inserted
        yield rest[len(label) - 1 :], 1
    if i < len(rest):
        if rest.startswith(label[i + 1 :], i + 1):  # replaced
            yield rest[len(label) :], 1
        if rest.startswith(label[i:], i + 1):  # deleted
            yield rest[len(label) + 1 :], 1


_LEVEL = "word_id long, rest string, node long, edits int, near string, near_n long"


def _may_go_on(rest, nexts):
    """Whether an edge out of a node with ``nexts`` begins as ``rest`` does."""
    return F.instr(nexts, F.substring(rest, 1, 1)) > 0


def _fits(edge_first, rest, label, nexts):
    """Whether a state without an edit may pass an edge: one that begins as it does, or by an edit at once (see :func:`moves`)."""
    n, tail, after = F.length(label), F.substr(label, F.lit(2)), F.substr(rest, F.lit(2))
    left = lambda k: F.substr(rest, n + k)
    goes_on = lambda x: (x == "") | _may_go_on(x, nexts)
    inserted, replaced = F.startswith(rest, tail) & goes_on(left(0)), F.startswith(after, tail) & goes_on(left(1))
    return (edge_first == F.substring(rest, 1, 1)) | inserted | replaced | (F.startswith(after, label) & goes_on(left(2)))


def _part(batches):
    """States without an edit at all edges out of their nodes: the word's own goes on, at others it may take its edit."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
    for batch in batches:
        out = []
        for word_id, rest, label, child, end, end_n, nexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for left, made in moves(rest, label):
                if end is not None and (made and not left or not made and len(left) == 1):  # the last one left is deleted
                    out.append((word_id, None, None, None, end, end_n))
                if not made or left and left[0] in nexts:
                    out.append((word_id, left, child, made, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], [c.split()[0] for c in _LEVEL.split(", ")])


def _match(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States with an edit at the one edge that begins as they do: on, or at their word's end to a neighbour."""
    level = states.withColumn("first", F.substring("rest", 1, 1)).join(edges, ["node", "first"]).where(F.startswith("rest", "label"))
    left = F.substr("rest", F.length("label") + 1)
    level = level.select("word_id", left.alias("rest"), F.col("child").alias("node"), "edits", "end", "end_n", "nexts")
    over = F.col("rest") == ""
    level = level.where(F.when(over, F.col("end").isNotNull()).otherwise(_may_go_on("rest", "nexts")))
    return level.select("word_id", "rest", "node", "edits", F.when(over, F.col("end")).alias("near"), F.when(over, F.col("end_n")).alias("near_n"))


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, near, near_n: every word of ``words`` (word_id, word, n) that is one edit from another, for both."""
    edges, states = trie(words)
    found, (states, size) = [], counted(states)
    while size:
        own = states.where("edits = 0").join(edges, "node").where(_fits(F.col("first"), F.col("rest"), F.col("label"), F.col("nexts"))).select("word_id", "rest", "label", "child", "end", "end_n", "nexts")
        level = cut(own.mapInArrow(_part, _LEVEL).union(_match(states.where("edits = 1"), edges)))
        found.append(level.where("near is not null").select("word_id", "near", "near_n"))
        states = level.where("near is null").select("word_id", "rest", "node", "edits")
        size = states.count()
    if not found:
        return states.select("word_id", F.col("rest").alias("near"), F.col("word_id").alias("near_n"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    out = out.distinct().join(words.select("word_id", "word"), "word_id")
    return out.where(F.levenshtein("word", "near", 1) == 1).drop("word")


def spelling_variants(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    ``form``: the neighbour with the most occurrences (of several the first in
    code-point order), if it has ``often`` times the word's, else null; ``root``:
    where the forms of forms end. A null or empty text has no words; a null
    doc_id counts as an empty one; repeated rows count again; an empty table gives no rows.
    """
    words = keyed(corpus_words(docs), "word_id")
    near = neighbours(words).groupBy("word_id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("first"))
    rows = words.join(near, "word_id", "left")
    is_form = -F.col("first.less") >= often * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("first.word")).alias("form"), F.when(is_form, -F.col("first.less")).alias("form_n")))
    to = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the forms that are followed; occurrences grow with every form, so there is an end
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to, left = cut(to.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))), None
        left = to.where("moved").limit(1).count()
        to = to.drop("moved")
        if not left:
            break
    return rows.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling": op11_spelling}
ORACLES: dict[str, str] = {}
