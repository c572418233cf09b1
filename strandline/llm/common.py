"""Shared folder handling, word splitting and prefix sums for corpus operators."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources.staging import cut, shared_dir  # noqa: F401

#: What separates words: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows."""
    out = cut(df)
    return out, out.count()


def few(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in no more partitions than they are worth; nothing is shuffled for it."""
    n = rows // each + 1
    return df.coalesce(n) if n < n_partitions(df.sparkSession) else df


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        give(0)


def lean(run):
    """``run``, for mapInPandas, that gives freed memory back to the system at a task's end.

    Spark keeps Python workers for later tasks, and their allocators would keep
    the most that any task before has held.
    """

    @functools.wraps(run)
    def to_end(frames):
        try:
            yield from run(frames)
        finally:
            trim()

    return to_end


def words(text: Column) -> Column:
    """The words of a text as an array; null for null."""
    return F.array_remove(F.split(text, SPACE), "")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a number of its own for every row, equal rows too, in column ``name``."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def ranged(df: DataFrame, order: list, name: str = "_part") -> DataFrame:
    """``df`` written in ranges of ``order``, each numbered in column ``name``.

    The ranges are as many as the session's shuffle partitions. Rows with the
    same key can be parted if ``order`` goes on after the key, so that a hot
    key does not land in one task.
    """
    n = n_partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list, sums: dict[str, str], part: str = "_part") -> DataFrame:
    """Running sums within ``group`` along ``order``, for rows made by :func:`ranged`.

    Each range is summed alone; what the ranges before hold of the same group
    is added from a table of one row for each range and group. ``sums`` gives
    the new column for each summed one (the row itself included).
    """
    totals = df.groupBy(part, *group).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums.values()])
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(
        F.col(part).alias("_p"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums.values()],
    )
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"_r_{c}": F.sum(c).over(inside) for c in sums.values()})
    match = F.col(part) == F.col("_p")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(ahead, match, "left")
    out = out.withColumns({new: F.col(f"_r_{c}") + F.col(f"_b_{c}") for new, c in sums.items()})
    return out.drop("_p", *[f"_g_{g}" for g in group], *[f"_b_{c}" for c in sums.values()], *[f"_r_{c}" for c in sums.values()])
