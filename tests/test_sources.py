import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import synthetic
from strandline.plans import configs
from strandline.sources import genomes


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fasta_files(spark, tmp_path):
    (tmp_path / "NC_1.2.fna").write_text(">a\nacgt \nNN\n>b\r\n\n tt\n")
    assert rows(genomes.read_fasta(spark, str(tmp_path)), "accession") == [("NC_1.2", "ACGTNNTT")]


def test_feature_table(spark):
    text = "head\n<9\t>5\tCDS\n\t\t\tproduct\told\n\t\t\tproduct\tnew\n3\t4\tgene\n\t\t\tproduct\tno\n20\t30\tCDS\n"
    got = genomes.feature_table(genomes.lines(spark.createDataFrame([("a", text)], "accession string, content string")))
    assert rows(got, "start") == [("a", 5, 9, "new"), ("a", 20, 30, "")]


def test_protein_table(spark):
    text = "title\n1..2\t+\t1\t1\tx\tx\tx\tx\tbefore\nLocation\tStrand\n5..9\t+\t1\t1\tg1\ts\tc\tc\tp1\nbad\t+\t1\t1\tg\ts\tc\tc\tp\n7..8\tshort\n"
    got = genomes.protein_table(genomes.lines(spark.createDataFrame([("a", text)], "accession string, content string")))
    assert rows(got, "start") == [("a", 5, 9, "g1", "p1")]


def test_sheets(spark):
    cells = [["r0", "1", "2"], ["NC_1.1 , One", "", ""], ["region_id", "start", "end"], ["r1", "9.0", "4"], ["", "", ""], ["r2", "x", "3"], ["Total", "1", "2"], ["AC_2.1, Two", "", ""], ["r3", "1", "2"]]
    sheet = spark.createDataFrame([("f", i, c) for i, c in enumerate(cells)], "file string, row_no int, cells array<string>")
    assert rows(genomes.region_sections(sheet, "island"), "region_id") == [("NC_1.1", "One", "r1", 4, 9, 6, "island"), ("AC_2.1", "Two", "r3", 1, 2, 2, "island")]
    head = ["Tool", "Accession", "Description", "True Positives", "False Positives", "True Negative", "False Negative"]
    cells = [["title"], head, ["t", "NC_1.1", "One", "1", "2.5", "?", "4"], ["t", "Total", "", "1", "1", "1", "1"], ["", "", "", "", "", "", ""]]
    sheet = spark.createDataFrame([("f", i, c) for i, c in enumerate(cells)], "file string, row_no int, cells array<string>")
    assert rows(genomes.accuracy_sheet(sheet), "tool") == [("t", "NC_1.1", "One", 1.0, 2.5, None, 4.0)]


def test_tables_and_archives(spark, tmp_path):
    (tmp_path / "i.csv").write_text("accession,method,start,end\na,m,1,10\n")
    assert rows(genomes.read_intervals(spark, str(tmp_path / "i.csv")), "start") == [("a", "m", 0, 9)]
    (tmp_path / "l.json").write_text('{"a": 5,\n "b": 7}')
    assert rows(genomes.read_lengths(spark, str(tmp_path / "l.json")), "accession") == [("a", 5), ("b", 7)]
    schema = "model string, tile int, kind string, accession string, tile_idx long, vec array<double>"
    tiles = spark.createDataFrame([("m", 10, k, a, 0, [1.0]) for a, k in (("a", "emb"), ("a", "pcs"), ("b", "emb"))], schema)
    genomes.write_tiles(tiles, str(tmp_path / "t"))
    genomes.write_tiles(tiles.withColumn("model", F.lit("n")), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 6
    kinds = lambda full: [r[:2] for r in rows(genomes.best_kind(back.where("model = 'm'"), full).select("accession", "kind"), "accession")]
    assert kinds(False) == [("a", "pcs"), ("b", "emb")] and kinds(True) == [("a", "emb"), ("b", "emb")]


def test_archives_with_unit_vectors(spark, tmp_path):
    schema = "model string, tile int, kind string, accession string, tile_idx long, vec array<double>"
    tiles = spark.createDataFrame([("m", 10, "emb", "a", 0, [3.0, 4.0]), ("m", 10, "pcs", "b", 0, [3.0, 4.0])], schema)
    genomes.write_tiles(tiles, str(tmp_path / "t"))
    got = {r.accession: r.vec for r in genomes.read_tiles(spark, str(tmp_path / "t"), unit=True).collect()}
    assert got == {"a": [pytest.approx(0.6), pytest.approx(0.8)], "b": [3.0, 4.0]}


def test_available_files_and_results(spark, tmp_path):
    for name, n in (("NC_7.1.fna", 1001), ("NC_8.2.fna", 1000), ("x.fna", 5000)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("A" * n)
    assert rows(genomes.available(spark, str(tmp_path / "in")), "accession") == [("NC_7.1",), ("x",)]
    table = spark.createDataFrame([(1, "u"), (2, None)], "k int, v string")
    for kind in ("csv", "parquet"):
        for _ in range(2):
            genomes.write_results({"one": table, "two": table.limit(1)}, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet" / "one")).count() == 2
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv" / "one")), "k") == [("1", "u"), ("2", None)]


def test_last_of_and_carried(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 3, None), ("a", 3, 4), ("b", 2, None)], "k string, o int, v int")
    assert rows(genomes.last_of(df, ["k"], ["o"]), "k") == [("a", 3, 4), ("b", 2, None)]
    line = spark.createDataFrame([("a", i, v) for i, v in enumerate((None, 5, None, 7, None))], "k string, o int, v int")
    assert [r.held for r in genomes.carried(line, "k", "o", F.col("v"), "held").orderBy("o").collect()] == [None, 5, 5, 7, 7]


def test_sheet_without_a_tool(spark):
    head = ["Tool", "Accession", "True Positives"]
    cells = [head, ["Literature", "NC_1.1", "1"], ["t", "NC_1.1", "2"]]
    sheet = spark.createDataFrame([("f", i, c) for i, c in enumerate(cells)], "file string, row_no int, cells array<string>")
    assert [r.tool for r in genomes.accuracy_sheet(sheet).collect()] == ["t"] and genomes.accuracy_sheet(sheet, ()).count() == 2


def test_chimeras_hold_their_blocks(spark):
    tiles = spark.createDataFrame([(a, i, [float(100 * n + i)]) for n, a in enumerate("hd") for i in range(40)], "accession string, tile_idx long, vec array<double>")
    grid = spark.createDataFrame([("h|d|0", "h", "d"), ("h|d|1", "h", "d")], "accession string, host string, donor string")
    made, put, lengths = synthetic.chimeras(tiles, grid, 10, 3, 2, 50, 80)
    assert rows(lengths, "accession") == [("h|d|0", 460), ("h|d|1", 460)]
    lines = {a: [r.vec[0] for r in made.where(F.col("accession") == a).orderBy("tile_idx").collect()] for a in ("h|d|0", "h|d|1")}
    assert lines["h|d|0"] != lines["h|d|1"]
    spots = rows(put, "accession", "k")
    for a, line in lines.items():
        inside = {i for n, _, s, e in spots if n == a for i in range(s // 10, e // 10 + 1)}
        assert len(line) == 46 and len(inside) == 6 and [v for i, v in enumerate(line) if i not in inside] == [float(i) for i in range(40)]
        assert all(line[i] >= 100 for i in inside) and all(line[s // 10 + j] == line[s // 10] + j for n, _, s, _ in spots if n == a for j in range(3))


def test_configurations(spark):
    assert configs.tuning_grid(spark).select("config").distinct().count() == 108
    found = configs.methods(spark, {"one": {}, "same": {}, "comp": {"embedding": None, "use_embedding": False}, "other": {"embedding": "E"}})
    assert found.select("config").distinct().count() == 3
    ready = configs.runnable(found, spark.createDataFrame([("E",)], "embedding string"))
    assert rows(ready.select("method"), "method") == [("comp",), ("other",)]
    done = ready.where("method = 'comp'").select(F.lit("a").alias("accession"), "config")
    left = configs.to_run(ready, spark.createDataFrame([("a",), ("b",)], "accession string"), done)
    assert rows(left.select("accession", "method"), "accession", "method") == [("a", "other"), ("b", "comp"), ("b", "other")]
    with pytest.raises(ValueError):
        configs.methods(spark, {"bad": {"typo": 1}})


def test_placement_keeps_its_distances(spark):
    hosts = spark.createDataFrame([("a", 3000), ("b", 50)], "accession string, length long")
    avoid = spark.createDataFrame([("a", 1000, 1400)], "accession string, start long, end long")
    got = rows(synthetic.place(synthetic.candidates(hosts, 10, 100, avoid, 50), 4, 300, 7), "k")
    offsets = [r[2] for r in got]
    assert [r[1] for r in got] == [0, 1, 2, 3] and offsets == sorted(offsets)
    assert all(b - a >= 300 for a, b in zip(offsets, offsets[1:], strict=False))
    assert all(x % 10 == 0 and 100 <= x < 2900 and not 950 <= x <= 1450 for x in offsets)
    slots = rows(synthetic.donor_slots(spark.createDataFrame([("d", 20), ("e", 3)], "accession string, tiles long"), 4, 3), "k")
    assert len({s[2] for s in slots}) == 4 and all(s[0] == "d" and 0 <= s[2] < 17 for s in slots)


def test_chimera_matches_plain_python(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ATCG") for _ in range(400))
    blocks, at, n = ["a" * 20, "b" * 20, "c" * 20], [50, 200, 390], 20
    offsets = spark.createDataFrame([("h", k, o) for k, o in enumerate(at)], "accession string, k long, offset long")
    put = spark.createDataFrame([("h", k, b) for k, b in enumerate(blocks)], "accession string, k long, block string")
    hosts = spark.createDataFrame([("h", seq), ("plain", "ATC")], "accession string, seq string")
    want = seq[:50] + blocks[0] + seq[50:200] + blocks[1] + seq[200:390] + blocks[2] + seq[390:]
    assert rows(synthetic.splice(hosts, put, offsets), "accession") == [("h", want), ("plain", "ATC")]
    for _, k, s, e in rows(synthetic.inserts(offsets, n), "k"):
        assert want[s : e + 1] == blocks[k]
    islands = spark.createDataFrame([("h", 49, 50), ("h", 100, 300)], "accession string, start long, end long")
    moved = synthetic.shifted(islands, offsets, n)
    assert rows(moved, "start") == [("h", 49, 70), ("h", 120, 340)]
    lengths = spark.createDataFrame([("h", len(want))], "accession string, length long")
    free = set(range(len(want))) - {p for _, _, s, e in rows(synthetic.inserts(offsets, n), "k") for p in range(s - 5, e + 6)} - {p for _, s, e in rows(moved, "start") for p in range(s, e + 1)}
    got = rows(synthetic.negative_regions(synthetic.inserts(offsets, n), moved, lengths, 5), "start")
    assert {p for _, s, e in got for p in range(s, e + 1)} == free
    tiles = spark.createDataFrame([("h", i, [float(i)]) for i in range(40)], "accession string, tile_idx long, vec array<double>")
    donor = spark.createDataFrame([("h", k, j, [1000.0 + 2 * k + j]) for k in range(3) for j in range(2)], "accession string, k long, nth long, vec array<double>")
    made = rows(synthetic.assemble_tiles(tiles, donor, offsets, 10, 2, spark.createDataFrame([("h", 46)], "accession string, tiles long")), "tile_idx")
    line = [*range(5), 1000, 1001, *range(5, 20), 1002, 1003, *range(20, 39), 1004, 1005, 39]
    assert [r[1:] for r in made] == [(i, [float(x)]) for i, x in enumerate(line)]
    with pytest.raises(ValueError):
        synthetic.assemble_tiles(tiles.withColumn("kind", F.lit("pcs")), donor, offsets, 10, 2, lengths)
    grid = synthetic.conditions(spark.createDataFrame([("a",), ("b",)], "accession string"), spark.createDataFrame([("b",), ("c",)], "accession string"), [5, 10], [0, 1])
    assert grid.count() == 3 * 4


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_in_byte_ranges(spark, tmp_path, end):
    """Ranges of a few hundred bytes: their borders fall into headers, lines and line ends."""
    import random

    rng = random.Random(len(end))
    for name, n in (("NC_1.2", 9000), ("NC_7", 40), ("NC_8", 0)):
        text, left = [">one record " + "x" * 300], n
        while left > 0:
            k = min(left, rng.choice((1, 60, 61, 200)))
            text.append("".join(rng.choice("acgtN") for _ in range(k)) + rng.choice(("", " ", "\t")))
            left -= k
            if rng.random() < 0.05:
                text += [">another", ""]
        (tmp_path / f"{name}.fna").write_bytes(end.join(text).encode())
    whole = {r.accession: r.seq for r in genomes.read_fasta(spark, str(tmp_path)).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = sorted(genomes.read_fasta_lines(spark, str(tmp_path)).collect())
        chunks = sorted(genomes.read_fasta_chunks(spark, str(tmp_path), 100, 7).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for a, seq in whole.items():
        own = [r for r in rows if r.accession == a]
        assert "".join(r.seq for r in own) == seq and all(seq.startswith(r.seq, r.offset) for r in own)
        assert [(r.offset, r.seq) for r in chunks if r.accession == a] == [(i, seq[i : i + 107]) for i in range(0, len(seq), 100)]


def test_placement_takes_a_bounded_number_of_candidates(spark):
    """The choice equals a plain one over all candidates of a host, in hash order, and no Python sees a host's candidates."""
    hosts = spark.createDataFrame([("a", 3000), ("b", 900), ("b", 900), (None, 500), ("c", 40)], "accession string, length long")
    avoid = spark.createDataFrame([("a", 1000, 1400), ("b", 0, 5000)], "accession string, start long, end long")
    for places in (synthetic.candidates(hosts, 10, 100), synthetic.candidates(hosts, 10, 100, avoid, 50)):
        got = synthetic.place(places, 4, 70, 7, tile=10)
        assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for a, o, _ in sorted(places.select("accession", "offset", F.xxhash64(F.lit(7), "accession", "offset").alias("h")).collect(), key=lambda r: (r.h, r.offset)):
            own = want.setdefault(a, [])
            if len(own) < 4 and all(abs(o - p) >= 70 for p in own):
                own.append(o)
        assert {tuple(r) for r in got.collect()} == {(a, k, o) for a, own in want.items() for k, o in enumerate(sorted(own))}


def test_feature_table_sorts_once(spark):
    text = "\t\t\tproduct\tbefore\n1\t2\tCDS\n3\t4\tCDS\nnote\n\t\t\tproduct\tx\nnote\n9\t8\tgene\n\t\t\tproduct\tno\n5\t6\tCDS\n\t\t\tproduct\t\n"
    got = genomes.feature_table(genomes.lines(spark.createDataFrame([("a", text)], "accession string, content string")))
    assert rows(got, "start") == [("a", 1, 2, ""), ("a", 3, 4, "x"), ("a", 5, 6, "")]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
