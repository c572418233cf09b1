"""Method configurations as data: the registry, the tuning grid, and what of them is to be run."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.genomes import config_digest, missing

#: The configuration that the others differ from (fixed values).
BASE = {
    "w": 10000, "dw": 100, "n_components": 24, "detrend_bp": 0, "contamination_model1": 0.15, "contamination_model2": 0.05,
    "median_filter_window_len": 400, "min_island_len": 10000, "merge_gap": 5000, "assign": "center", "refine": True,
    "fit_stride": 10, "embedding": "DNABERT-S_t1000", "use_embedding": True, "use_composition": True,
}
_SCHEMA = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in BASE.items())

#: Contamination pairs, filter lengths, least lengths and refinement of the tuning grid: 108 configurations (fixed values).
GRID = {
    "contamination": [(0.05, 0.05), (0.075, 0.075), (0.10, 0.05), (0.10, 0.10), (0.15, 0.05), (0.15, 0.10), (0.15, 0.20), (0.20, 0.10), (0.20, 0.25)],
    "median_filter_window_len": [200, 400, 600],
    "min_island_len": [8000, 10000],
    "refine": [False, True],
}


#: Patterns of product names by what they tell of (fixed values).
CATEGORIES = {
    "mobility": [
        r"\btransposase\b", r"\bintegrase\b", r"\brecombinase\b", r"\btransposon\b", r"\binsertion sequence\b", r"\bIS\d{2,4}\b", r"\bphage\b", r"\bprophage\b",
        r"\bconjugal\b", r"\bconjugative\b", r"\bplasmid\b", r"\brelaxase\b", r"\bmobilization\b", r"\bexcisionase\b", r"\bresolvase\b",
    ],
    "virulence": [
        r"\bvirulence\b", r"\bpathogenicity\b", r"\binvasin\b", r"\bhemolysin\b", r"\bhaemolysin\b", r"\btoxin\b", r"\badhesin\b", r"\bfimbria", r"\bpilus\b",
        r"\bpili\b", r"\bsecretion system\b", r"\bflagell", r"\binvasion protein\b", r"\beffector\b", r"\bVi polysaccharide\b",
    ],
    "resistance": [
        r"\bresistance\b", r"\bbeta-lactamase\b", r"\bantibiotic\b", r"\befflux\b", r"\bmultidrug\b", r"\bchloramphenicol\b", r"\btetracycline\b", r"\bstreptomycin\b",
        r"\bsulfonamide\b", r"\baminoglycoside\b",
    ],
}


def methods(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """(method, every field of BASE, config) of a registry of overrides; a field that BASE has not raises an error."""
    for name, over in registry.items():
        if unknown := set(over) - set(BASE):
            raise ValueError(f"{name}: unknown fields {sorted(unknown)}")
    rows = [(name, *(BASE | over).values()) for name, over in registry.items()]
    found = spark.createDataFrame(rows, f"method string, {_SCHEMA}")
    return found.withColumn("config", config_digest(F.struct(*BASE)))


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """The registry of a JSON file: an object of names to overrides."""
    text = spark.read.text(path, wholetext=True).first()
    return methods(spark, json.loads(text[0]))


def tuning_grid(spark: SparkSession) -> DataFrame:
    keys = [k for k in GRID if k != "contamination"]
    registry = {}
    for (a, b), *rest in itertools.product(GRID["contamination"], *[GRID[k] for k in keys]):
        registry["/".join(map(str, (a, b, *rest)))] = {"contamination_model1": a, "contamination_model2": b} | dict(zip(keys, rest, strict=True))
    return methods(spark, registry)


def runnable(configs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The configurations that use no embedding, or one of those at hand (embedding)."""
    at_hand = embeddings.select(F.col("embedding").alias("have")).distinct()
    free = configs.where("not use_embedding or embedding is null")
    return free.unionByName(configs.where("use_embedding and embedding is not null").join(at_hand, F.col("embedding") == F.col("have"), "left_semi"))


def to_run(configs: DataFrame, genomes: DataFrame, attempted: DataFrame) -> DataFrame:
    """(accession, method, config): every configuration for every sequence, but for those attempted (accession, config)."""
    # the registry comes from the driver (see methods), so its rows go into the plan as one array beside each sequence
    every = F.array(*[F.struct(F.lit(r.method).alias("method"), F.lit(r.config).alias("config")) for r in configs.select("method", "config").collect()])
    wanted = genomes.select("accession").distinct().select("accession", F.inline(every))
    return missing(wanted, attempted, ["accession", "config"])
