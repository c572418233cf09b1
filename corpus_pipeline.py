"""A corpus pipeline in five stages, each on all that the one before it kept.

Every stage but the last returns the columns of ``documents``, whatever they
are and are called. Stages decide on rows, not on ids: null and repeated ids
are rows like any other. ``run`` writes each stage's rows as Parquet in the
shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut, free_name, keyed, table
from strandline.llm.decontaminate import leaks
from strandline.llm.jaccard import jaccard_components
from strandline.llm.language import language_of
from strandline.llm.mixing import mix_documents
from strandline.llm.sharding import shard_documents

#: Least score of a document whose language counts as known.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: no null texts, no texts without letters."""
    name = free_name(docs, "language")
    found = language_of(docs, name)
    return found.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= LEAST_SCORE)).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group (null last, of equal ids any one); what is in no group stays."""
    key = free_name(docs, "row_key")
    rows = keyed(docs, key)
    found = cut(jaccard_components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("component_id").alias("group_")))
    ids = rows.select(F.col(key), F.col("doc_id").cast("long").alias("id_")).join(found, key)
    first = F.struct(F.col("id_").isNull().alias("none"), "id_", F.col(key).alias("key"))
    stays = ids.groupBy("group_").agg(F.min(first).alias("first")).select(F.col("first.key").alias(key))
    return rows.join(stays, key, "left_semi").drop(key)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. A text says all, so its digest stands for the row, and nothing is written for it."""
    key = free_name(docs, "text_key")
    rows = docs.withColumn(key, F.md5(F.col("text").cast("string")))
    items = table(spark, sf_dir, "benchmark").withColumn("item_id", F.xxhash64("text"))  # items without id, too
    out = cut(leaks(rows.select(key, "text"), items, key).select(key).distinct())
    return rows.join(out, key, "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    key, copies, nth = (free_name(docs, n) for n in ("row_key", "taken_copies", "nth_copy"))
    rows = keyed(docs, key)
    mixed = mix_documents(rows.select("doc_id", "text", "source", key), table(spark, sf_dir, "labels"), key)
    taken = rows.join(mixed.where("copies > 0").select(key, F.col("copies").cast("int").alias(copies)), key)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies, nth)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; see :func:`strandline.llm.sharding.shard_documents`."""
    return shard_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Rank-order profiles, component search and latent retrieval are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
