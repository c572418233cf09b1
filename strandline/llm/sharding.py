"""Minimax contiguous sharding of groups that must stay whole.

Groups stand in the order of their least id. The smallest feasible shard
capacity is found by binary search; a capacity is checked by filling shards
greedily along the prefix sums of the group sizes. The prefix sums stay on the
executors. The driver holds a bounded list of them: at first every so many
groups, then, around each cut that is still open, finer ones, until the least
capacity and its cuts are exact.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, ranged, running

#: Prefix sums that the driver gets at first, and again for each open cut.
COARSE, FINE = 1 << 14, 1 << 10


class _Track:
    """Known prefix sums, by rank of their group; between two that are not neighbours others are hidden.

    ``open`` gathers the gaps that an answer depends on.
    """

    def __init__(self, known: list[tuple[int, int]]):
        known = sorted(set(known))
        self.at, self.rank = [p for p, _ in known], [r for _, r in known]
        self.open: set[tuple[int, int]] = set()

    def _gap(self, i: int) -> bool:
        hidden = 0 <= i < len(self.at) - 1 and self.rank[i + 1] - self.rank[i] > 1
        if hidden:
            self.open.add((self.rank[i], self.rank[i + 1]))
        return hidden

    def most(self, limit: int, hidden: bool = False) -> int:
        """The largest prefix sum of at most ``limit``; with ``hidden``, ``limit`` itself if one may hide there."""
        i = bisect.bisect_right(self.at, limit) - 1
        return limit if self.at[i] < limit and self._gap(i) and hidden else self.at[i]

    def least_from(self, limit: int) -> int:
        """The smallest prefix sum of at least ``limit``."""
        i = bisect.bisect_left(self.at, limit)
        if self.at[i] > limit:
            self._gap(i - 1)
        return self.at[i]

    def fits(self, capacity: int, shards: int, hidden: bool) -> bool:
        now = 0
        for _ in range(shards):
            now = self.most(now + capacity, hidden)
        return now >= self.at[-1]

    def capacity(self, low: int, high: int, shards: int, hidden: bool) -> int:
        """The least capacity from ``low`` to ``high`` that fits; ``high`` must."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, hidden) else (middle + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of the shards: within the capacity, each as near below an even share as the rest allows."""
        total = self.at[-1]
        need = [total]
        for _ in range(shards - 1):  # the least end of each shard, from the last one back
            need.append(self.least_from(max(0, need[-1] - capacity)))
        need.reverse()
        now, out = 0, []
        for i, least in enumerate(need, 1):
            now = self.most(min(now + capacity, max(total * i // shards, least)))
            out.append(now)
        return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(least capacity, prefix sum at each shard's end) of groups with columns size, rank (from 1) and total (prefix sum)."""
    n, total, most = groups.agg(F.max("rank"), F.max("total"), F.max("size")).first()
    if not n:
        return 0, [0] * shards
    step = max(1, n // COARSE)

    def get(which) -> list[tuple[int, int]]:
        return [(r.total, r.rank) for r in groups.where(which).select("rank", "total").toLocalIterator()]

    known = [(0, 0), *get((F.col("rank") % step == 0) | (F.col("rank") == n))]
    floor, ceiling = max(most, -(-total // shards)), -(-total // shards) + most
    while True:
        track = _Track(known)
        floor = track.capacity(floor, ceiling, shards, True)
        if track.fits(ceiling, shards, False):
            ceiling = track.capacity(floor, ceiling, shards, False)
        track.open.clear()
        track.fits(floor, shards, True)
        track.fits(ceiling, shards, False)
        ends = track.cuts(ceiling, shards) if floor == ceiling else []
        if not track.open:
            return ceiling, ends
        want = F.lit(False)
        for a, b in track.open:
            want |= (F.col("rank") > a) & (F.col("rank") < b) & ((F.col("rank") - a) % max(1, (b - a) // FINE) == 0)
        known += get(want)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The columns doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: rows with equal texts are one group, groups stand in the
    order of their least doc_id (null first), and the largest shard is as small
    as a contiguous split of the groups allows. Size: UTF-8 bytes of the text
    plus 8; a null text has none, is a group of its own with the other null
    texts, and has the checksum 0. ``slot`` counts a shard's rows from 0 without
    gaps; repeated rows get slots of their own. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(1), text).alias("h1"),
        F.xxhash64(F.lit(2), text, F.length(text)).alias("h2"),
    )
    rows = cut(rows)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id"))
    groups = rows.groupBy("h1", "h2").agg(first.alias("first"), F.sum("size").alias("group_size"), F.count("*").alias("n"))
    groups = groups.select("h1", "h2", F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("place"), "group_size", "n")
    order = ["place", "h1", "h2"]
    line = ranged(groups, order)
    line = running(line.withColumn("one", F.lit(1).cast("long")), [], order, {"total": "group_size", "rank": "one", "rows_to": "n"})
    line = cut(line.select(*order, F.col("group_size").alias("size"), "total", "rank", "rows_to"))
    _, ends = minimax_cuts(line, shards)
    # the first row number of each shard: rows up to the group that ends the shard before
    at = line.where(F.col("total").isin(sorted(set(ends)))).select("total", "rows_to").collect()
    rows_to = {0: 0} | {r.total: r.rows_to for r in at}
    begin = [0] + [rows_to[e] for e in ends[:-1]]
    shard = F.lit(0)
    for i, e in enumerate(ends[:-1], 1):
        shard = F.when(F.col("total") > e, F.lit(i)).otherwise(shard)
    placed = rows.join(line.select("h1", "h2", "place", shard.cast("int").alias("shard")), ["h1", "h2"])
    line = ["place", "h1", "h2", "doc_id", "size", "text_crc32"]
    placed = ranged(placed, line).withColumn("one", F.lit(1).cast("long"))
    placed = running(placed, [], line, {"number": "one"})
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in begin]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - 1 - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_shards(spark, sf_dir):
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)


QUERIES = {"op1_shards": op1_shards}
ORACLES: dict[str, str] = {}
