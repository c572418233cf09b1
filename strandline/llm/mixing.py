"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. A budget of at least the source's size is
met by complete epochs first; what is left is filled from the rows in the order
of their exponential keys, scaled by quality weights, up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, ranged, running, table

#: Fixed values of the mix: weights of the sources in their order, repeating; the share of all sizes; the most epochs.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def budgets(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, its budget.

    The budgets sum to ``share`` of all sizes, in proportion to the weights;
    none is above ``epochs`` times its source's size, and the excess goes to
    the others by weight until none is above. Sorted by the level at which they
    fill up, the sources that are full are the first ones, so running sums
    over the table (a row for each source, in ranges) find the level.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    rows = sources.withColumns({"cap": cap, "fills_at": cap / F.col("weight")})
    order = ["fills_at", "source"]
    rows = running(ranged(rows, order), [], order, {"caps_to": "cap", "weights_to": "weight"}).drop("_part")
    whole = sources.agg((F.sum("source_size") * F.lit(float(share))).alias("all"), F.sum("weight").alias("weights"))
    rows = rows.join(F.broadcast(whole), F.lit(True))  # one row
    level = F.greatest((F.col("all") - (F.col("caps_to") - F.col("cap"))) / (F.col("weights") - F.col("weights_to") + F.col("weight")), F.lit(0.0))
    # the first source that does not fill up gives the level of all after it; taken for later ones, the level is lower
    rows = cut(rows.withColumn("level", F.when(level <= F.col("fills_at"), level)))
    rows = rows.drop("level").join(F.broadcast(rows.agg(F.max("level").alias("level"))), F.lit(True))  # one row
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("level", F.col("fills_at")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def exponential_key(weight: Column, seed: int, *ids: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from the row's ids: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def mix(rows: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """``rows`` (doc_id, source, size, tie, quality weight w > 0) with the budget's columns and ``taken`` words.

    Each row is taken once for every complete epoch in its source's budget, and
    once more if the middle of its span in the sampled order lies within the
    budget's rest; so a source misses its budget by half a row at most. Rows of
    a hot source are sorted in many ranges.
    """
    rows = rows.withColumn("key", exponential_key(F.col("w"), seed, "doc_id", "size", "tie"))
    order = [F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")]
    rows = running(ranged(rows, order), ["source"], ["key", "doc_id", "size", "tie"], {"upto": "size"})
    t = target.select(F.col("source").alias("t_source"), "source_size", "target")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    rest = F.col("target") - epochs * size
    more = (F.col("upto") - F.col("size") / 2 <= rest) & (rest > 0)
    copies = epochs + F.when(more, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("t_source", "upto", "key", "_part")


def mix_documents(docs: DataFrame, labels: DataFrame | None, *keep: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, and the columns ``keep``, for every row of ``docs``.

    Size: words of the text, none for null. Sources stand by code point, null
    last, as a source of its own. The quality weight is 2 for a row labelled
    good, 1/2 for one labelled bad and 1 without a label. Repeated rows are
    each a row; of rows that agree in id and text any may be the one taken; an
    empty table gives no rows; a source without words has the budget 0.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
        *keep,
    )
    if labels is not None:
        good = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("good"))
        rows = rows.join(good, rows.doc_id == good.l_id, "left").withColumn("w", F.when(F.col("good") > 0, 2.0).when(F.col("good") == 0, 0.5).otherwise(1.0)).drop("l_id", "good")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = cut(rows)
    sizes = ranged(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()])
    place = running(sizes, [], [F.col("source").asc_nulls_last()], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = cut(place.select("source", "source_size", weight.alias("weight")))
    return mix(rows, cut(budgets(sources))).drop("tie", "w")


def op6_mix(spark, sf_dir):
    mixed = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mix": op6_mix}
ORACLES: dict[str, str] = {}
