"""Readers of sequence and annotation files, and the sinks of results.

Each parser takes a DataFrame and can be fed from any source; the ``read_*``
functions feed it from files. A file is one row only where its lines' order
counts and its size has a bound (a chromosome, an annotation table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import scans
from strandline.operators.vectors import l2

#: File name without folders and without what follows its last dot.
STEM = r"([^/]+?)(?:\.[^./]*)?$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(accession, content) of whole text files; the accession is the file's stem."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), STEM, 1).alias("accession"), F.col("value").alias("content"))


def lines(contents: DataFrame) -> DataFrame:
    """(accession, line_no, line) of (accession, content)."""
    return contents.select("accession", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))


def fasta_sequence(content: Column) -> Column:
    """All records of a FASTA text as one upper-case sequence."""
    body = F.filter(F.split(content, "\n"), lambda x: ~x.startswith(">"))
    return F.upper(F.array_join(F.transform(body, lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), ""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, seq), a row for each file."""
    return files(spark, path).select("accession", fasta_sequence(F.col("content")).alias("seq"))


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(accession, offset, seq): the lines of FASTA files with their places in the files' sequences (see :func:`read_fasta`).

    Files are read in byte ranges. The bases of a range are counted where it is
    read; what the ranges before it hold is added from a table of a row for each range.
    """
    found = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), STEM, 1).alias("accession"), F.col("_metadata.file_block_start").alias("piece_"), F.monotonically_increasing_id().alias("nth_"), "value")
    seq = F.upper(F.regexp_replace("value", r"^[ \t\r\f]+|[ \t\r\f]+$", ""))
    found = found.where(~F.col("value").startswith(">")).select("accession", "piece_", "nth_", seq.alias("seq")).where("seq <> ''")
    placed = scans.scanned(found.withColumn("n_", F.length("seq").cast("long")), ["accession"], "piece_", ["nth_"], {"before_": ("sum", "n_", 1)})
    return placed.select("accession", F.coalesce("before_", F.lit(0).cast("long")).alias("offset"), "seq")


def read_fasta_chunks(spark: SparkSession, path: str, size: int, overlap: int = 0) -> DataFrame:
    """(accession, offset, seq) in chunks of ``size`` bases and the next ``overlap`` ones, as :func:`strandline.functions.sequence.chunked` makes them of whole sequences."""
    lines_ = read_fasta_lines(spark, path)
    first, last = F.greatest(F.lit(0), F.floor((F.col("offset") - overlap) / size)), F.floor((F.col("offset") + F.length("seq") - 1) / size)
    rows = lines_.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.lit(0), F.col("chunk") * size - F.col("offset"))
    high = F.least(F.length("seq"), (F.col("chunk") + 1) * size + overlap - F.col("offset"))
    rows = rows.select("accession", "chunk", "offset", F.substr("seq", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "part")))  # a chunk's bases
    return rows.groupBy("accession", "chunk").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("seq")).select("accession", (F.col("chunk") * size).cast("long").alias("offset"), "seq")


def feature_table(rows: DataFrame) -> DataFrame:
    """(accession, start, end, product) of the coding sequences of feature tables (accession, line_no, line).

    A line of two positions and a kind opens a record; of the product lines
    that follow in it the last one counts, and without any it is empty.
    """
    head = r"^[<>]?(\d+)\t[<>]?(\d+)\t(\w+)"
    at = lambda i: F.regexp_extract("line", head, i)
    opens = F.col("line").rlike(head)
    product = F.when(F.col("line").startswith("\t\t\t"), F.regexp_extract("line", r"^\t\t\tproduct\t(.*)$", 1))
    named = F.when(F.col("line").rlike(r"^\t\t\tproduct\t"), product)
    line = Window.partitionBy("accession").orderBy("line_no")
    head_of = F.when(opens, F.struct(at(1).cast("long").alias("a"), at(2).cast("long").alias("b"), (at(3) == "CDS").alias("is_cds")))
    # only lines that open a record or name a product decide; a record's product is in the last of them
    cut = rows.where(opens | named.isNotNull()).select("accession", "line_no", head_of.alias("head"), named.alias("product"))
    ends = cut.withColumns({"of": F.last("head", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "more": F.lead(F.col("head").isNull()).over(line)})
    a, b = F.col("of.a"), F.col("of.b")
    found = ends.where("not coalesce(more, false) and of.is_cds")
    return found.select("accession", F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.coalesce("product", F.lit("")).alias("product"))


def protein_table(rows: DataFrame) -> DataFrame:
    """(accession, start, end, gene, product) of protein tables (accession, line_no, line): what follows the header line."""
    head = F.min(F.when(F.col("line").startswith("Location"), F.col("line_no"))).over(Window.partitionBy("accession"))
    part = F.split("line", "\t")
    at = lambda i: F.regexp_extract(F.get(part, F.lit(0)), r"^(\d+)\.\.(\d+)", i)
    body = rows.withColumn("head", head).where(F.col("line_no") > F.col("head")).where((F.size(part) >= 9) & (at(1) != ""))
    return body.select("accession", at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), F.get(part, F.lit(4)).alias("gene"), F.get(part, F.lit(8)).alias("product"))


def region_sections(rows: DataFrame, kind: str) -> DataFrame:
    """Regions of a sheet (file, row_no, cells array<string>) with section headers ``accession , description``."""
    first = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    header = r"^(N[CZ]_\d+\.\d+|AC_\d+\.\d+)\s*,\s*(.*)$"
    line = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("file", "row_no", "cells", first.alias("first"))
    is_head = F.col("first").rlike(header)
    filled = seen.withColumns({n: F.last(F.when(is_head, F.trim(F.regexp_extract("first", header, i))), ignorenulls=True).over(line) for i, n in ((1, "accession"), (2, "organism"))})
    a, b = (F.get("cells", F.lit(i)).try_cast("double").cast("long") for i in (1, 2))
    kept = filled.where(~is_head & (F.col("first") != "") & ~F.lower("first").rlike("^(total|additional|region_id)"))
    out = kept.withColumns({"a": a, "b": b}).where("accession is not null and a is not null and b is not null")
    start, end = F.least("a", "b"), F.greatest("a", "b")
    return out.select("accession", "organism", F.col("first").alias("region_id"), start.alias("start"), end.alias("end"), (end - start + 1).alias("length"), F.lit(kind).alias("kind"))


#: Columns of the accuracy sheet and their names here (fixed values).
ACCURACY = {"Tool": "tool", "Accession": "accession", "Description": "organism", "True Positives": "TP", "False Positives": "FP", "True Negative": "TN", "False Negative": "FN"}


def accuracy_sheet(rows: DataFrame, without: tuple[str, ...] = ("literature",)) -> DataFrame:
    """Counts of each tool (but ``without``) and sequence of a sheet (file, row_no, cells array<string>); numbers that are none become null."""
    line = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    is_head = cell(0) == "Tool"
    head = F.last(F.when(is_head, F.transform("cells", lambda c: F.trim(c))), ignorenulls=True).over(line)
    body = rows.withColumn("head", head).where(~is_head & F.col("head").isNotNull() & (cell(0) != "") & ~cell(1).isin("", "Total"))
    value = lambda name: F.get("cells", (F.array_position("head", name) - 1).cast("int"))
    out = body.select(*[(value(k).try_cast("double") if v.isupper() else value(k)).alias(v) for k, v in ACCURACY.items()])
    return out.where(F.lower(F.trim("tool")).isin(*without) == F.lit(False)) if without else out


def available(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """(accession) of the files of more than ``least`` bytes."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") > least)
    return found.select(F.regexp_extract("path", STEM, 1).alias("accession")).distinct()


def write_results(results: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each table under its name in ``path``, as Parquet or as CSV with a header; what is there is replaced."""
    for name, table in results.items():
        writer = table.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{path}/{name}")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the largest by ``order`` and the other columns: what later sources say counts."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("best_")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best_.{c}").alias(c) for c in rest])


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the last value that is not null at or before each row of its key."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(accession, method, start, end) of a CSV, 1-based inclusive there, 0-based here."""
    rows = spark.read.csv(path, header=True, schema="accession string, method string, start long, end long")
    return rows.withColumns({"start": F.col("start") - 1, "end": F.col("end") - 1})


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(accession, length) of a JSON object whose keys are the accessions."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("accession", "length"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile vectors (model, tile, kind, accession, tile_idx, vec) as Parquet, a folder for each model and tile length.

    Folders that ``tiles`` has no rows for stay as they are.
    """
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "tile").parquet(path)


def best_kind(tiles: DataFrame, prefer_full: bool = False) -> DataFrame:
    """The rows of each archive (model, tile, accession) in one ``kind``: reduced (``pcs``) before full (``emb``), or the reverse."""
    wanted = "emb" if prefer_full else "pcs"
    has = F.max(F.col("kind") == wanted).over(Window.partitionBy("model", "tile", "accession"))
    return tiles.withColumn("has_", has).where((F.col("kind") == wanted) | ~F.col("has_")).drop("has_")


def read_tiles(spark: SparkSession, path: str, prefer_full: bool = False, unit: bool = False) -> DataFrame:
    """The archives of ``path`` in one kind each, the full vectors among them with length 1 if ``unit``."""
    rows = best_kind(spark.read.parquet(path), prefer_full)
    return rows.withColumn("vec", F.when(F.col("kind") == "emb", l2(F.col("vec"))).otherwise(F.col("vec"))) if unit else rows


def config_digest(config: Column) -> Column:
    """Ten hex digits that name a configuration (a struct or map column)."""
    return F.substring(F.sha1(F.to_json(config)), 1, 10)


def missing(wanted: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``wanted`` was not attempted yet."""
    return wanted.join(attempted.select(*keys).distinct(), keys, "left_anti")
