"""Sequences with planted inserts: placement, splicing, coordinates, tiles and regions that hold no insert.

``offsets`` are (accession, k, offset): before position ``offset`` of the host
the insert ``k`` (from 0, in order of offsets) of ``length`` positions goes in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import intervals

KEYS = ["accession"]


def candidates(hosts: DataFrame, tile: int, edge: int, avoid: DataFrame | None = None, margin: int = 25_000) -> DataFrame:
    """(accession, offset): tile-aligned places of (accession, length) away from the edges and from the intervals ``avoid``."""
    last = F.floor((F.col("length") - edge) / tile) - 1
    first = edge // tile
    rows = hosts.where(last >= first).select("accession", F.lit(first * tile).cast("long").alias("start"), (last * tile).cast("long").alias("end"))
    if avoid is not None:  # intervals are cut, and places made of what is left
        rows = intervals.subtract(rows, avoid.select("accession", (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end")))
    low, high = F.ceil(F.col("start") / tile), F.floor(F.col("end") / tile)
    return rows.where(low <= high).select("accession", F.explode(F.transform(F.sequence(low, high), lambda i: i * tile)).alias("offset"))


def place(places: DataFrame, n: int, separation: int, seed: int = 0, tile: int = 1) -> DataFrame:
    """``offsets`` of up to ``n`` candidates a host, in hash order, each at least ``separation`` from those before it.

    Candidates are multiples of ``tile``. A chosen one rules out a bounded number
    of places, itself among them, so the first few of the hash order hold all
    that can be chosen; only those come together, in one row of a host.
    """
    most = (n - 1) * (2 * (-(-separation // tile)) - 1) + 1
    hashed = places.select("accession", "offset", F.xxhash64(F.lit(seed), "accession", "offset").alias("h"))
    nth = F.dense_rank().over(Window.partitionBy("accession").orderBy("h", "offset"))
    first = hashed.withColumn("nth_", nth).where(F.col("nth_") <= most)
    own = first.groupBy("accession").agg(F.array_sort(F.collect_set(F.struct("h", "offset"))).alias("all_"))
    free = lambda got, c: (F.size(got) < n) & ~F.exists(got, lambda p: F.abs(c["offset"] - p) < separation)
    none = F.array().cast(f"array<{places.schema['offset'].dataType.simpleString()}>")
    chosen = F.aggregate("all_", none, lambda got, c: F.when(free(got, c), F.concat(got, F.array(c["offset"]))).otherwise(got))
    return own.select("accession", F.posexplode(F.array_sort(chosen)).alias("k", "offset")).select("accession", F.col("k").cast("long").alias("k"), F.col("offset").cast("long").alias("offset"))


def donor_slots(donors: DataFrame, n: int, need: int, seed: int = 0) -> DataFrame:
    """(accession, k, first_tile): ``n`` distinct first tiles of (accession, tiles) in hash order; the blocks may overlap."""
    rows = donors.where(F.col("tiles") > need).select("accession", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - need - 1)).alias("first_tile"))
    line = Window.partitionBy("accession").orderBy(F.xxhash64(F.lit(seed), "accession", "first_tile"), "first_tile")
    return rows.withColumn("k", (F.row_number().over(line) - 1).cast("long")).where(F.col("k") < n).select("accession", "k", "first_tile")


def inserts(offsets: DataFrame, length: int) -> DataFrame:
    """(accession, k, start, end) of the inserts in the new sequence."""
    start = F.col("offset") + F.col("k") * length
    return offsets.select("accession", "k", start.alias("start"), (start + length - 1).alias("end"))


def splice(hosts: DataFrame, blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """(accession, seq): (accession, seq) with the blocks (accession, k, block) put in; a host without offsets stays as it is."""
    after = F.lead("offset").over(Window.partitionBy("accession").orderBy("k"))
    cuts = offsets.withColumn("next", after).join(blocks, ["accession", "k"])
    rows = cuts.groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("k", "offset", "next", "block"))).alias("cuts"))  # a few inserts
    found = hosts.join(rows, "accession", "left")
    whole = F.length("seq")
    part = lambda c: F.concat(c.block, F.substring("seq", (c.offset + 1).cast("int"), (F.coalesce(c.next, whole) - c.offset).cast("int")))
    head = F.substring("seq", F.lit(1), F.get("cuts", F.lit(0))["offset"].cast("int"))
    return found.select("accession", F.when(F.col("cuts").isNull(), F.col("seq")).otherwise(F.concat(head, F.array_join(F.transform("cuts", part), ""))).alias("seq"))


def inserts_before(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """``points`` (accession, pos, ...) with ``before``: how many offsets are at or before the position. One window, no range join."""
    extra = [c for c in points.columns if c not in ("accession", "pos")]
    rows = points.select("accession", "pos", *extra, F.lit(0).alias("is_offset_"))
    marks = offsets.select("accession", F.col("offset").alias("pos"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], F.lit(1).alias("is_offset_"))
    line = Window.partitionBy("accession").orderBy("pos", F.col("is_offset_").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.unionByName(marks).withColumn("before", F.sum("is_offset_").over(line))
    return counted.where("is_offset_ = 0").drop("is_offset_")


def shifted(found: DataFrame, offsets: DataFrame, length: int) -> DataFrame:
    """Intervals (accession, start, end) of the host in the new sequence's positions."""
    ends = found.select("accession", F.xxhash64("start", "end").alias("id"), F.inline(F.array(*[F.struct(F.lit(i).alias("edge"), F.col(c).alias("pos")) for i, c in ((0, "start"), (1, "end"))])))
    moved = inserts_before(ends.distinct(), offsets).withColumn("to", F.col("pos") + F.col("before") * length)
    edge = lambda i: F.max(F.when(F.col("edge") == i, F.col("to")))
    return moved.groupBy("accession", "id").agg(edge(0).alias("start"), edge(1).alias("end")).select("accession", "start", "end")


def assemble_tiles(host: DataFrame, donor: DataFrame, offsets: DataFrame, tile: int, need: int, tiles: DataFrame) -> DataFrame:
    """(accession, tile_idx, vec) of the new sequences from the host's tiles and the donors' (accession, k, nth, vec).

    ``tiles`` (accession, tiles) says where to end. Both sides must be in one
    basis; rows reduced within their own sequence (``kind`` pcs) are refused.
    """
    for side in (host, donor):
        if "kind" in side.columns:
            raise ValueError("tiles with a kind: take full vectors with best_kind, and drop the column")
    moved = inserts_before(host.select("accession", (F.col("tile_idx") * tile).alias("pos"), "tile_idx", "vec"), offsets)
    old = moved.select("accession", (F.col("tile_idx") + F.col("before") * need).alias("tile_idx"), "vec")
    put = donor.join(offsets, ["accession", "k"])
    new = put.select("accession", (F.floor(F.col("offset") / tile) + F.col("k") * need + F.col("nth")).alias("tile_idx"), "vec")
    return old.unionByName(new).join(tiles, "accession").where("tile_idx < tiles").drop("tiles")


def chimeras(tiles: DataFrame, grid: DataFrame, tile: int, need: int, n: int, edge: int, separation: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles, inserts, lengths) of new series: into each host of ``grid`` (accession, host, donor) ``n`` blocks of ``need`` tiles of its donor.

    ``tiles`` (accession, tile_idx, vec) holds hosts and donors in one basis.
    Places and blocks follow the hash of the new series' name, so a name with a
    seed in it draws anew.
    """
    sizes = tiles.groupBy("accession").agg(F.count("*").alias("tiles"))
    of = lambda side: grid.select("accession", F.col(side).alias("from_")).join(sizes.withColumnRenamed("accession", "from_"), "from_")
    hosts, donors = of("host"), of("donor")
    offsets = place(candidates(hosts.select("accession", (F.col("tiles") * tile).alias("length")), tile, edge), n, separation, tile=tile)
    slots = donor_slots(donors.select("accession", "tiles"), n, need)
    own = lambda side: grid.select("accession", F.col(side).alias("from_")).join(tiles.withColumnRenamed("accession", "from_"), "from_").select("accession", "tile_idx", "vec")
    wanted = slots.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(need - 1).cast("long")))).select("accession", "k", "nth", (F.col("first_tile") + F.col("nth")).alias("tile_idx"))
    donor = wanted.join(own("donor"), ["accession", "tile_idx"]).select("accession", "k", "nth", "vec")
    lengths = hosts.join(offsets.groupBy("accession").agg(F.count("*").alias("put")), "accession").select("accession", (F.col("tiles") + F.col("put") * need).alias("tiles"))
    made = assemble_tiles(own("host"), donor, offsets, tile, need, lengths)
    return made, inserts(offsets, need * tile), lengths.select("accession", (F.col("tiles") * tile).alias("length"))


def negative_regions(put: DataFrame, islands: DataFrame, lengths: DataFrame, flank: int) -> DataFrame:
    """What of each new sequence (accession, length) is neither near an insert nor in a shifted island of the host."""
    wide = put.select("accession", (F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"))
    return intervals.complement(wide.union(islands.select("accession", "start", "end")), lengths)


def conditions(hosts: DataFrame, donors: DataFrame, lengths: list[int], seeds: list[int]) -> DataFrame:
    """(host, donor, insert_len, seed): every condition of a sweep over two short lists of accessions."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("insert_len"), F.lit(s).alias("seed")) for n in lengths for s in seeds]))
    pairs = hosts.select(F.col("accession").alias("host")).crossJoin(donors.select(F.col("accession").alias("donor"))).where("host <> donor")
    return pairs.select("host", "donor", grid.alias("g")).select("host", "donor", "g.insert_len", "g.seed")
