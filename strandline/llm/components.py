"""Connected components by contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import counted, cut, few


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b, both long); ``component`` is a node of it. ``rows``: edges at most, if known.

    In each round every node joins the least of its neighbours and itself, and
    the edges between joined nodes go on to the next round: a star round its
    least node is done in one. Largest nodes vanish in every round, and if node
    numbers are hashes, a constant share of all that are left does. The edges
    never leave the executors; rounds are written to the shared folder.
    """
    between = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    size = rows if rows is not None else 1 << 62
    now, size = counted(few(edges.where("a <> b").select(*between("a", "b")).distinct(), size))
    rounds = []
    while size:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), 2 * size))
        rounds.append(least)
        rest = few(now.join(least, "u").select(F.col("v").alias("u"), F.col("to").alias("a")), size).join(least, "u").where(F.col("a") != F.col("to"))
        now, size = counted(few(few(rest.select(*between("a", "to")), size).distinct(), size))
    if not rounds:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = rounds.pop()
    while rounds:
        of = found.select(F.col("u").alias("to"), F.col("to").alias("end"))
        found = cut(rounds.pop().join(of, "to", "left").select("u", F.coalesce("end", "to").alias("to")))
    return found.select(F.col("u").alias("node"), F.col("to").alias("component"))
