"""Results kept by configuration and series, so that a run which was broken off goes on where it stood.

``path``/results has a folder for each configuration's digest and run;
``path``/attempted has a row for each series and configuration that a run has
finished, with the run and its number of rows, written after the results. What
no attempt names, as of a run that was broken off, is not read. Runs only add.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandline.plans import configs as plans
from strandline.sources.genomes import last_of
from strandline.sources.staging import cut

_ATTEMPTED = "config string, accession string, rows long, run string, at double"


def attempted(spark: SparkSession, path: str) -> DataFrame:
    """(config, accession, rows, run, at): the last finished attempt of each pair; none where nothing is kept yet."""
    try:
        rows = spark.read.schema(_ATTEMPTED).parquet(f"{path}/attempted")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _ATTEMPTED)
    return last_of(rows, ["config", "accession"], ["at"])


def put(results: DataFrame, keys: DataFrame, path: str) -> None:
    """Adds ``results`` (config, accession, ...) of the pairs ``keys`` (config, accession); a pair without rows is attempted too."""
    run = uuid.uuid4().hex
    held = cut(results)
    held.withColumn("run", F.lit(run)).write.mode("append").partitionBy("config", "run").parquet(f"{path}/results")
    counts = held.groupBy("config", "accession").agg(F.count("*").alias("rows"))
    done = keys.select("config", "accession").distinct().join(counts, ["config", "accession"], "left")
    done = done.select("config", "accession", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(run).alias("run"), F.lit(time.time()).alias("at"))
    done.write.mode("append").parquet(f"{path}/attempted")


def results(spark: SparkSession, path: str) -> DataFrame:
    """(config, accession, ...) of the last finished attempt of each pair."""
    kept = spark.read.option("basePath", f"{path}/results").parquet(f"{path}/results")
    return kept.join(attempted(spark, path).select("config", "accession", "run"), ["config", "accession", "run"]).drop("run")


def resume(configs: DataFrame, genomes: DataFrame, path: str, run: Callable[[Row, DataFrame], DataFrame]) -> int:
    """Runs each of ``configs`` over the series of ``genomes`` (accession) that it has not been run over; the number of runs.

    ``run`` gets a configuration's row and its series (accession) and returns
    rows with accession. Each configuration is kept as soon as it is done.
    ``configs`` is a registry from the driver (see :func:`strandline.plans.configs.methods`).
    """
    spark = genomes.sparkSession
    todo = cut(plans.to_run(configs, genomes, attempted(spark, path)))
    runs = 0
    for config in configs.collect():
        own = todo.where(F.col("config") == config.config).select("accession")
        if own.limit(1).count():
            named = lambda df: df.withColumn("config", F.lit(config.config))  # noqa: B023, E731
            put(named(run(config, own)), named(own), path)
            runs += 1
    return runs
