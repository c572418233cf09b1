import pytest
from pyspark.sql import functions as F

from strandline.plans import configs
from strandline.sources import store


def test_a_run_that_was_broken_off_goes_on(spark, tmp_path):
    path = str(tmp_path / "kept")
    registry = configs.methods(spark, {"one": {}, "two": {"smoothing": 7} if "smoothing" in configs.BASE else {list(configs.BASE)[0]: list(configs.BASE.values())[0]}, "three": {"contamination_model1": 0.2}})
    registry = registry.dropDuplicates(["config"])
    names = [r.method for r in registry.collect()]
    genomes = spark.createDataFrame([("a",), ("b",), ("empty",)], "accession string")
    ran = []

    def run(config, own):
        ran.append((config.method, sorted(r.accession for r in own.collect())))
        if len(ran) == 2 and broken:
            raise RuntimeError("broken off")
        return own.where("accession <> 'empty'").select("accession", F.lit(config.method).alias("by"), F.lit(len(ran)).alias("nth"))

    broken = True
    assert store.attempted(spark, path).count() == 0
    with pytest.raises(RuntimeError):
        store.resume(registry, genomes, path, run)
    assert {r.accession for r in store.attempted(spark, path).collect()} == {"a", "b", "empty"}
    broken = False
    assert store.resume(registry, genomes, path, run) == len(names) - 1
    assert [m for m, _ in ran].count(ran[0][0]) == 1
    got = store.results(spark, path).collect()
    assert sorted((r.by, r.accession) for r in got) == sorted((m, a) for m in names for a in "ab")
    assert store.resume(registry, genomes, path, run) == 0
    more = genomes.union(spark.createDataFrame([("c",)], "accession string"))
    before = len(ran)
    assert store.resume(registry, more, path, run) == len(names) and all(own == ["c"] for _, own in ran[before:])


def test_the_last_attempt_counts_and_an_unfinished_one_does_not(spark, tmp_path):
    path = str(tmp_path / "kept")
    row = lambda n: spark.createDataFrame([("x", "a", n)], "config string, accession string, n int")
    keys = row(0).select("config", "accession")
    store.put(row(1), keys, path)
    row(2).withColumn("run", F.lit("unfinished")).write.mode("append").partitionBy("config", "run").parquet(f"{path}/results")
    assert [r.n for r in store.results(spark, path).collect()] == [1]
    store.put(row(3), keys, path)
    assert [r.n for r in store.results(spark, path).collect()] == [3]
    store.put(row(4).limit(0), keys, path)
    assert store.results(spark, path).count() == 0 and store.attempted(spark, path).first().rows == 0
