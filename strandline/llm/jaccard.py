"""Exact n-gram Jaccard join in a metric space, and the near-duplicate groups it gives.

Jaccard distance is a metric, so pivots part the documents into regions and the
triangle inequality says which documents near a border must stand in more than
one. The join runs on distinct shingle sets (copies are one class):

1. *Reach.* A document can only have a neighbour within the distance if enough
   of the shingles that come first in hash order are found elsewhere. Shingles
   of a task's own documents are combined before the shuffle, so a shingle of
   a third of all documents is one row for each task. Documents out of reach of
   all others are done.
2. *Pivots.* Two neighbours share a shingle among each one's rarest (prefix
   principle). Each such shingle names as pivot the least document that has it,
   and a document stands in the regions of all pivots that its rarest shingles
   name, so any two neighbours meet in a region. The distance to each of these
   pivots is counted exactly. No region is a document's one home: nearly all
   pivots are at distance 1 in this space, so that nearest pivots alone, with
   windows of twice the threshold, would hold all documents everywhere; and as
   pivots are named by rare shingles only, a neighbour need not stand in the
   nearest one's region, so that further ones cannot be left out.
3. *Regions.* What lies within the threshold of a pivot is linked to it. Members
   outside the pivot's component become the pivots of the next level. They stand
   in cells by their distance, and a member goes to the cells that its
   triangle-inequality window reaches and that hold pivots of other components;
   only then are shingles sent. This recurs until every region is out of pivots,
   so no link between components is lost, and copies are never paired.

Links are contracted after each level: the next one knows components only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import counted, cut, few, lean, table
from strandline.llm.components import connected_components
from strandline.llm.hashing import mix, pieces, shingle_sets

#: Shingles of documents that are combined at once in a task before they are shuffled.
COMBINE = 1 << 21
#: Shingles that one slice of a cell's members holds on average.
SLICE = 100_000
#: Pivots of a region at its second level on average, and how many times more at each level below.
PIVOTS, DEEPER = 256, 8
#: Shingles that the pivots of one block of a cell hold, about.
BLOCK = 1 << 20
#: Hash values that decide when a member becomes a pivot.
TURNS = 1 << 30
#: Bits of the filter that says which documents are still of interest; a fixed size, however large the input.
FILTER_BITS = 1 << 24


def _prefix(n, percent: int, rest: int):
    """Length of a prefix by hash order and the shingles that neighbours share in it; n: array of set sizes."""
    enough = (percent * n + 99) // 100
    shared = np.maximum(1, n // rest)
    least = np.maximum(1, ((percent * n + 99) // 100) // rest)  # a neighbour may be smaller
    return np.minimum(n, n - enough + shared), least


def _signature(s: np.ndarray) -> int:
    return int(mix(mix(s.view(np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _sizes(k: int):
    def run(frames):
        for f in frames:
            for low, high in pieces(f.text.tolist()):
                sets = shingle_sets(f.text.iloc[low:high].tolist(), k)
                yield pd.DataFrame({"doc_id": f.doc_id.iloc[low:high].to_numpy(), "n_shingles": [len(s) for s in sets], "sig": [_signature(s) for s in sets]})

    return lean(run)


def _first_shingles(k: int, percent: int, rest: int):
    """Rows (token, sig, w) of a task's prefixes; w: 0 a shingle of one set here, -1 of several, else a set's number of those of several."""

    def flush(sets: dict):
        sigs = np.fromiter(sets, np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        who = np.repeat(sigs, [len(t) for t in sets.values()])
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        same = np.zeros(len(tokens) + 1, bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        several = same[1:] | same[:-1]
        one = ~several
        yield pd.DataFrame({"token": tokens[one], "sig": who[one], "w": 0})
        known = np.unique(tokens[several])
        yield pd.DataFrame({"token": known, "sig": np.zeros(len(known), np.int64), "w": -1})
        s, n = np.unique(who[several], return_counts=True)
        yield pd.DataFrame({"token": s, "sig": s, "w": n})

    def run(frames):
        sets, held = {}, 0
        for f in frames:
            for low, high in pieces(f.text.tolist()):
                for s in shingle_sets(f.text.iloc[low:high].tolist(), k):
                    if len(s) and (sig := _signature(s)) not in sets:
                        sets[sig] = s[: int(_prefix(np.array([len(s)]), percent, rest)[0][0])].copy()
                        held += len(sets[sig])
                if held >= COMBINE:
                    yield from flush(sets)
                    sets, held = {}, 0
        if sets:
            yield from flush(sets)

    return lean(run)


def _kept_sets(k: int, bits):
    def run(frames):
        held = bits.value
        for f in frames:
            ids = f.doc_id.to_numpy(np.int64)
            at = (mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            f = f[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            for low, high in pieces(f.text.tolist(), 1 << 18):
                sets = [s for s in shingle_sets(f.text.iloc[low:high].tolist(), k) if len(s)]
                yield pd.DataFrame({"sig": [_signature(s) for s in sets], "n": [len(s) for s in sets], "tokens": sets})

    return lean(run)


@lean
def _marked(ids):
    """The filter's bytes that a partition's ids set, as (byte, value)."""
    held = np.zeros(FILTER_BITS >> 3, np.uint8)
    for f in ids:
        at = (mix(f.id.to_numpy(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
        np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    used = np.flatnonzero(held)
    yield pd.DataFrame({"byte": used, "value": held[used].astype(np.int64)})


def _filter(ids: DataFrame):
    rows = ids.select(F.col(ids.columns[0]).alias("id")).mapInPandas(_marked, "byte long, value long")
    rows = rows.groupBy("byte").agg(F.bit_or("value").alias("value")).toPandas()
    held = np.zeros(FILTER_BITS >> 3, np.uint8)
    held[rows.byte.to_numpy(np.int64)] = rows.value.to_numpy(np.uint8)
    return ids.sparkSession.sparkContext.broadcast(held)


_CELL = ["region", "cell", "part", "block"]
_ROW = [*_CELL, "kind", "n", "d", "comp", "tokens"]


def _compare(percent: int):
    """Links (a, b) of components, from members against the pivots of their block; rows come sorted, a block's pivots first."""

    def index(pivots: list):
        tokens = np.concatenate([p[3] for p in pivots])
        who = np.repeat(np.arange(len(pivots)), [len(p[3]) for p in pivots])
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        distinct, first = np.unique(tokens, return_index=True)
        return distinct, np.append(first, len(tokens)), who

    def shared(look, tokens, n):
        distinct, first, who = look
        at = np.searchsorted(distinct, tokens)
        at = at[: np.searchsorted(at, len(distinct))]
        hit = at[distinct[at] == tokens[: len(at)]]
        counts = first[hit + 1] - first[hit]
        flat = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(who[flat], minlength=n)

    def run(frames):
        key, pivots, look, found = None, [], None, set()
        for f in frames:
            for *at, kind, n, d, comp, tokens in zip(*[f[c] for c in _ROW], strict=True):
                if key != at:
                    key, pivots, look = at, [], None
                if kind == 0:
                    pivots.append((n, d, comp, np.asarray(tokens)))
                    continue
                if not pivots:
                    continue
                if look is None:
                    look, (sizes, ds, comps) = index(pivots), (np.array([p[i] for p in pivots]) for i in range(3))
                maybe = (comps != comp) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (np.abs(ds - d) <= 1 - percent / 100 + 1e-9)
                if not maybe.any():
                    continue
                both = shared(look, np.asarray(tokens), len(pivots))
                near = maybe & (100 * both >= percent * (sizes + n - both))
                found.update((comp, int(c)) for c in np.unique(comps[near]))
            if len(found) > COMBINE >> 4:
                yield pd.DataFrame(sorted(found), columns=["a", "b"])
                found = set()
        if found:
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    return lean(run)


def _places(sets: DataFrame, percent: int, rest: int) -> DataFrame:
    """(region, sig, n): the pivots that each set's rarest shared shingles name, from those that come first in hash order."""
    n = F.col("n").cast("long")
    enough = F.expr(f"({percent} * cast(n as bigint) + 99) div 100")
    shared = F.greatest(F.lit(1), F.expr(f"cast(n as bigint) div {rest}"))
    least = F.greatest(F.lit(1), F.floor(enough / rest))
    sized = sets.select("sig", "n", "tokens", F.least(n, n - enough + shared).cast("int").alias("taken"), least.alias("least"))
    rows = sized.select("sig", "n", "taken", "least", F.explode(F.slice("tokens", F.lit(1), F.col("taken"))).alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("sig").alias("region")).where("df > 1")
    common = rows.join(counts, "token")
    by = Window.partitionBy("sig").orderBy("df", "token")
    whole = Window.partitionBy("sig")
    common = common.withColumns({"rank": F.row_number().over(by), "alone": F.col("taken") - F.count("*").over(whole)})
    return common.where("alone + rank <= taken - least + 1 and sig <> region").select("region", "sig", "n").distinct()


def _with_tokens(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the shingles of their ``sig``. A set stands in a few regions' slices and blocks, so no key of this join is hot."""
    return rows.repartition("sig").join(sets.select("sig", "tokens").repartition("sig"), "sig")


def _distances(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``places`` with ``d``, the distance to the region's pivot, and ``near``; a region's members are dealt into slices, each with the pivot."""
    sizes = places.groupBy("region").agg((F.floor(F.sum("n") / SLICE) + 1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), "sig"), F.col("parts")).cast("int").alias("part")
    members = places.join(sizes, "region").select("region", part, F.lit(1).alias("kind"), "sig")
    heads = sizes.select("region", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("kind"), F.col("region").alias("sig"))
    pivot = F.first("tokens").over(Window.partitionBy("region", "part").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = _with_tokens(members.union(heads), sets).repartition("region", "part").withColumn("pivot", pivot).where("kind = 1")
    rows = rows.select("region", "sig", F.size("tokens").alias("n"), F.size("pivot").alias("pn"), F.size(F.array_intersect("tokens", "pivot")).alias("both"))
    union = F.col("n") + F.col("pn") - F.col("both")
    return rows.select("region", "sig", "n", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= percent * union).alias("near"))


def _open_cells(known: DataFrame, most: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of regions with members outside their pivot's component: members with ``turn`` (the region's pivots have hashes from ``done`` on below it), and cells."""
    waits = known.where("comp <> head and h >= done")
    turn = F.when(F.col("left") <= most, TURNS).otherwise(F.col("done") + F.ceil((TURNS - F.col("done")) * (most / F.col("left"))))
    turns = few(waits.groupBy("region", "done").agg(F.count("*").alias("left")), rows).select("region", turn.cast("long").alias("turn"))
    now = cut(few(known.join(turns, "region").withColumn("pivot", F.expr("comp <> head and h >= done and h < turn")), rows))
    of = F.when(F.col("pivot"), F.col("comp"))
    totals = now.groupBy("region", "cell").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pivot"), F.col("n")).otherwise(0)).alias("pivots"), F.min(of).alias("low"), F.max(of).alias("high"))
    near = few(totals, rows).select("region", F.explode(F.expr("sequence(cell - 1, cell + 1)")).alias("at"), "cell", "n", "pivots", "low", "high")
    own = lambda c: F.max(F.when(F.col("at") == F.col("cell"), F.col(c))).alias(c)
    cells = near.groupBy("region", "at").agg(F.sum("n").alias("n"), own("pivots"), own("low"), own("high"))
    cells = cells.where("pivots > 0").select("region", F.col("at").alias("cell"), "low", "high", F.ceil(F.col("pivots") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / SLICE).cast("int").alias("parts"))
    return now, cut(few(cells, rows))


def _links(now: DataFrame, cells: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links of components between the pivots of ``now`` and the members in their windows."""
    number = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "sig"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    slim = [c for c in _ROW if c != "tokens"]
    pivots = now.where("pivot").join(cells, ["region", "cell"]).withColumns({"block": number("block", "blocks"), "part": every("parts"), "kind": F.lit(0)})
    reached = cells.withColumn("at", F.explode(F.expr("sequence(cell - 1, cell + 1)"))).withColumnRenamed("cell", "of")
    # what is of the component of all of a cell's pivots has no link to find there
    members = now.join(reached, (now.region == reached.region) & (now.cell == reached["at"])).where("comp <> low or comp <> high").select(now.region, F.col("of").alias("cell"), "sig", "n", "d", "comp", number("part", "parts").alias("part"), "blocks")
    members = members.withColumns({"block": every("blocks"), "kind": F.lit(1)})
    rows_ = _with_tokens(few(members.select("sig", *slim).union(pivots.select("sig", *slim)), rows), sets)
    rows_ = few(rows_.select(*_ROW), rows).repartition(*_CELL).sortWithinPartitions(*_CELL, "kind")
    return rows_.mapInPandas(_compare(percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``k``-word shingles; ``component_id`` is the smallest doc_id that
    links reach. A null, empty or blank text has an empty set and links with
    nothing; so does a row without doc_id, whose component is null. Repeated
    rows are copies. Columns beside the two are not read.
    """
    rest = 10
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(docs.mapInPandas(_sizes(k), "doc_id long, n_shingles int, sig long"))
    some = docs.where("doc_id is not null and text is not null")

    first = some.select("text").mapInPandas(_first_shingles(k, percent, rest), "token long, sig long, w int")
    at = Window.partitionBy("token")
    single = F.when(F.col("w") == 0, F.col("sig"))
    found = first.withColumn("several", (F.min("w").over(at) < 0) | (F.min(single).over(at) != F.max(single).over(at)))
    hits = found.where("w > 0 or (w = 0 and several)").groupBy("sig").agg(F.sum(F.when(F.col("w") == 0, 1).otherwise(F.col("w"))).alias("hits"))
    classes = base.where("doc_id is not null and n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.expr(f"(cast({percent} as bigint) * n + 99) div 100") / rest))
    near = cut(classes.join(hits, "sig").where(F.col("hits") >= least).select("doc"))

    sets = cut(some.mapInPandas(_kept_sets(k, _filter(near)), "sig long, n int, tokens array<long>").dropDuplicates(["sig"]))
    places = cut(_places(sets, percent, rest))
    placed, rows = counted(_distances(places, sets, percent))

    comps = connected_components(few(placed.where("near").select(F.col("sig").alias("a"), F.col("region").alias("b")), rows), rows)
    # the pivots' own rows, too; cells are as wide as the window
    width = 1 - percent / 100 + 1e-9
    at_pivot = few(placed.groupBy("region").agg(F.max("n").alias("n")), rows).join(sets.select(F.col("sig").alias("region"), F.col("n").alias("pn")), "region")
    known = placed.select("region", "sig", "n", "d").union(at_pivot.select("region", F.col("region").alias("sig"), F.col("pn").alias("n"), F.lit(0.0).alias("d")))
    own, lead = (comps.select(F.col("node").alias(c), F.col("component").alias(n)) for c, n in (("sig", "comp"), ("region", "head")))
    known = few(few(known, rows).join(own, "sig", "left"), rows).join(lead, "region", "left").withColumns({"comp": F.coalesce("comp", "sig"), "head": F.coalesce("head", "region")})
    turn = F.pmod(F.xxhash64(F.lit("turn"), "sig"), F.lit(TURNS))
    known = cut(few(known.withColumns({"h": turn, "done": F.lit(0).cast("long"), "cell": F.floor(F.col("d") / width).cast("int")}), rows))

    most = PIVOTS
    while True:
        now, cells = _open_cells(known, most, rows)
        if cells.isEmpty():
            break
        links, n_links = counted(_links(now, cells, sets, percent, rows))
        left = now.withColumn("done", F.col("turn")).drop("turn", "pivot")
        if n_links:
            joined = connected_components(links, n_links)
            comps = cut(few(_relabelled(comps, joined, "component").union(_new_nodes(comps, joined)), rows))
            left = _relabelled(_relabelled(left, joined, "comp"), joined, "head")
        # regions that had no pivot left are closed
        known, rows = counted(few(left.where(F.col("done") < TURNS), rows))
        if not rows:
            break
        most *= DEEPER

    named = classes.join(comps, classes.sig == comps.node, "left").select("sig", "doc", F.coalesce("component", "sig").alias("component"))
    names = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    names = named.join(names, "component").select(F.col("sig").alias("of"), "component_id")
    linked = base.join(names, (F.col("sig") == F.col("of")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return linked.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _relabelled(rows: DataFrame, joined: DataFrame, column: str) -> DataFrame:
    to = joined.select(F.col("node").alias(column), F.col("component").alias("to_"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to_", column)).drop("to_").select(*rows.columns)


def _new_nodes(comps: DataFrame, joined: DataFrame) -> DataFrame:
    """Those of ``joined`` that no link had reached before."""
    return joined.join(comps.select("node"), "node", "left_anti").select("node", "component")


def op7_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES: dict[str, str] = {}
