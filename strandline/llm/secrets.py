"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of key characters, and whatever follows an announcing word
and = or :. The forest sees a candidate's length, the share of places where the
class of character changes, the share of its letters that are in words of the
corpus's own dictionary (the words that the most documents have), whether it
stands in a path or address, and what announces, assigns or quotes it.

It is fitted on labelled findings. Where none are given, those candidates teach
whose own form says what they are: keys of public services, digests and long
mixed runs on one side, words, numbers and addresses on the other. The label
rule reads characters only, the forest no pattern of them; most of what is
announced is neither and is left to the forest.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, cut, keyed, table

#: A candidate: a run of key characters within a word.
RUN = r"[A-Za-z0-9+/_=.-]{12,}"
#: Words that announce a secret, and starts that public services give their keys.
NAMES = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer"
STARTS = "AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abp]-|AIza|eyJ|glpat-"
#: A name with what assigns to it; what a value is after that, quoted or not; words that a quoted value is looked for in.
GIVEN = rf"(?i)(?:{NAMES})[^\s=:]{{0,12}}\s*[=:]+\s*"
VALUES = [r"^\"([^\"]+)\"", r"^'([^']+)'", r"^`([^`]+)`", r"^[\"'`]?(\S*?)[\"'`,;.)\]}]*(?:\s|$)"]
VALUE_WORDS = 16
FEATURES = ["length", "transitions", "dictionary", "pathlike", "named", "assigned", "quoted"]
#: The dictionary: the words of the most documents, so many at most and in so many documents at least; letters of a word.
DICTIONARY, IN_DOCUMENTS, LETTERS = 50_000, 5, 3
#: Labelled findings of each label that the forest is fitted on, about, at most (by the hash of the finding); trees and their depth; least probability.
FITTED, TREES, DEPTH, LEAST = 10_000, 30, 6, 0.5


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, nth, part, before, found: every candidate of every text.

    ``nth`` is the place of its word in the text, ``part`` its place among that
    word's candidates; ``before`` the two words before and what stands before
    it in its own. Null and empty texts have none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), SPACE).alias("w"))
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    near = lambda i: F.concat_ws(" ", word(i - 2), word(i - 1), F.lit(""))
    has = lambda x: (F.length(x) >= 12) & x.rlike(RUN)
    given = lambda x, i: (x.rlike("[=:].") | word(i - 1).rlike("[=:]$")) & F.concat(near(i), x).rlike(f"(?i)({NAMES})")
    ahead = lambda x, i: F.when(given(x, i), F.array_join(F.slice("w", i + 1, VALUE_WORDS), " "))
    hits = F.transform("w", lambda x, i: F.when(has(x) | given(x, i), F.struct(i.alias("nth"), near(i).alias("near"), x.alias("word"), ahead(x, i).alias("ahead"))))
    rows = rows.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("doc_id", "h.*")
    # what of the word assigns: nothing, if the words before do, else its start
    own = F.regexp_extract("word", rf"^(\S*?{GIVEN})\S", 1)
    lead = F.when(F.col("near").rlike(GIVEN + "$"), "").when(own != "", own).when(F.col("near").rlike(rf"(?i)({NAMES})[^\s=:]{{0,12}}\s$"), F.nullif(F.regexp_extract("word", r"^([=:]+)\S", 1), F.lit("")))
    rows = rows.withColumn("lead", F.when(~F.col("word").rlike("^[=:]+$"), lead))
    rows = rows.withColumn("rest", F.expr("substring(ahead, length(lead) + 1)"))
    value = F.coalesce(*[F.nullif(F.regexp_extract("rest", v, 1), F.lit("")) for v in VALUES])
    rows = rows.withColumn("value", value).withColumns({"runs": F.regexp_extract_all("word", F.lit(f"({RUN})")), "gaps": F.split("word", RUN)})
    stands = F.concat("near", "lead", F.regexp_extract("rest", "^[\"'`]?", 0))
    # what stands before the k-th run in the word: gaps and runs in turn
    upto = lambda k: F.array_join(F.zip_with(F.slice("gaps", 1, k + 1), F.concat(F.slice("runs", 1, k), F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    found = F.transform("runs", lambda x, k: F.struct(k.alias("part"), x.alias("found"), F.concat("near", upto(k)).alias("before")))
    # a value that is a run is that run; any other is numbered after the word's runs
    new = F.when(F.col("value").isNotNull() & ~F.array_contains("runs", F.col("value")), F.array(F.struct(F.size("runs").alias("part"), F.col("value").alias("found"), stands.alias("before"))))
    rows = rows.select("doc_id", "nth", F.explode(F.concat(found, F.coalesce(new, F.slice(found, 1, 0)))).alias("f"))
    return rows.select("doc_id", "nth", "f.part", "f.before", "f.found")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word): the lower-case words of the most documents, at most ``DICTIONARY``, each in ``IN_DOCUMENTS`` or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= IN_DOCUMENTS)
    return cut(counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word"))


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (found, before, id) with ``FEATURES``; ``known``: the dictionary."""
    f, b = F.col("found"), F.col("before")
    n = F.length(f)
    changes = F.regexp_count(f, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"))
    runs = F.filter(F.regexp_extract_all(f, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0)), lambda x: F.length(x) >= LETTERS)
    parts = found.select("id", F.explode(runs).alias("part")).select("id", F.length("part").alias("letters"), F.lower("part").alias("word"))
    covered = parts.join(F.broadcast(known), "word").groupBy("id").agg(F.sum("letters").alias("covered"))  # a fixed number of words
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.join(covered, "id", "left").withColumns({
        "length": n.cast("double"),
        "transitions": changes / F.greatest(n, F.lit(1)),
        "dictionary": F.coalesce("covered", F.lit(0)) / F.greatest(n, F.lit(1)),
        "pathlike": flag(b.rlike(r"(://|www\.|[/\\@])\S*$") | f.rlike(r"/.*/")),
        "named": flag(b.rlike(f"(?i)({NAMES})")),
        "assigned": flag(b.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(b.rlike(r"[\"'`]$")),
    }).drop("covered")


def form(found: Column) -> Column:
    """1 for a value whose own characters say that it is a key, 0 for one that is words, a number or an address by them, else null."""
    key = found.rlike(f"^({STARTS})[A-Za-z0-9_-]{{12,}}$") | (found.rlike("^([0-9a-f]{32,}|[0-9A-F]{32,})$") & found.rlike("[A-Fa-f]") & found.rlike("[0-9]"))
    mixed = found.rlike("^[A-Za-z0-9+/_-]{24,}={0,2}$") & found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9].*[0-9].*[0-9]")
    plain = found.rlike("^[A-Za-z]+[.]*$") | found.rlike("^[0-9.+/=_-]+$") | found.rlike("^[A-Za-z]+([._/-][A-Za-z0-9]+)+$")
    return F.when(key | mixed, 1.0).when(plain, 0.0)


def weak_labels(found: DataFrame) -> DataFrame:
    """The findings that their own form labels, but for those that an announcing word assigns and that are no key by form, with ``label``."""
    given = F.col("before").rlike(GIVEN + "[\"'`]?$")
    label = form(F.col("found"))
    return found.withColumn("label", F.when((label == 1) | ~given, label)).where("label is not null")


def fit(labelled: DataFrame, seed: int = 3) -> PipelineModel | None:
    """A forest fitted on ``labelled`` (features and label), on about ``FITTED`` of each label; none without both labels."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, int(min(1.0, FITTED / n) * (1 << 30)))])
    some = labelled.where(F.pmod(F.xxhash64("found", "before"), F.lit(1 << 30)) < F.element_at(share, F.col("label")))
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep"), RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)]).fit(some)


def scored(found: DataFrame, model: PipelineModel) -> DataFrame:
    """``found`` (features) with ``score``, the forest's probability of a secret."""
    return model.transform(found).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, nth, part, found, score, is_secret for every candidate of ``docs``.

    ``labelled`` (found, before, label) are labelled findings; without it those
    candidates of ``docs`` teach that their form labels. Without both kinds of
    labels every score is null and ``is_secret`` says whether a candidate is a
    key by form. Repeated rows give repeated findings; rows without doc_id are
    scanned like others; other columns are not read.
    """
    rows = keyed(candidates(docs), "id")
    known = dictionary(docs)
    full = cut(features(rows, known))
    teach = weak_labels(full) if labelled is None else features(keyed(labelled.select("found", "before", "label"), "id"), known)
    model = fit(cut(teach.select("found", "before", "label", *FEATURES)))
    if model is None:
        return full.select("doc_id", "nth", "part", "found", F.lit(None).cast("double").alias("score"), F.coalesce(form(F.col("found")) == 1, F.lit(False)).alias("is_secret"))
    return scored(full, model).select("doc_id", "nth", "part", "found", F.round("score", 6).alias("score"), (F.col("score") >= LEAST).alias("is_secret"))


def op4_secrets(spark, sf_dir):
    """Findings of all documents; the secret itself is given as a digest."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", "part", F.sha2("found", 256).alias("found_sha256"), F.length("found").alias("found_chars"), "score", "is_secret")


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
