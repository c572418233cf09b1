"""Quality rules with adaptive thresholds from mergeable quantile sketches.

The metrics of each text are counted in its row. Each language and source has
KLL quantile sketches of its metrics, built in tasks from its distinct sets of
counts, so that copies count once, and merged. Merging those of a language's
sources gives the language's sketches, merging all languages' those of all rows.
The sketches' fences replace fixed cutoffs; a source with few rows takes its
language's fences, a language with few rows those of all rows, and no fence lies
further out than the next wider group's fence and its width once more, so that a
source that is mostly junk does not set the measure for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, cut, table, words

#: Fixed limits of the base rule: least words, and the largest share of repeated words in percent.
LEAST_WORDS, REPEATED = 50, 50
#: Width of the fences in interquartile ranges; distinct rows that a group needs for fences of its own; the sketches' size.
FENCE, LEAST_ROWS, SKETCH = 6.0, 100, 1000
#: Digits of the quartiles that count: sketches are random in the last ones.
DIGITS = 3
#: Metrics (per word or line) with the least range that counts as their interquartile range.
RANGES = {"symbols": 0.05, "dup_lines": 0.1, "repeats": 0.05, "word_length": 0.5}


#: Words from which on a window's hash and place are two numbers. Below, they are one: at least 52 bits are left for the hash.
LONG = 4096


def with_repeats(rows: DataFrame, w: str = "w") -> DataFrame:
    """``rows`` with n_repeat_words: words of the array ``w`` in 3-word windows that it has twice or more, the first included.

    Each window is its hash and its place: in a text of fewer than ``LONG``
    words one long with the hash above, in a longer one a pair with the whole
    64-bit hash. Sorted, equal windows are neighbours; their places, sorted
    again, are covered by runs of three words. Each step is a column of its own,
    so that no step is made again for every element.
    """
    bits = LONG.bit_length() - 1
    mask = LONG - 1
    rows = rows.withColumn("n_", F.size(w))
    place = F.sequence(F.lit(0), F.col("n_") - 3)
    hash_ = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    short, long = (F.col("n_") >= 4) & (F.col("n_") < LONG), F.col("n_") >= LONG
    one = F.transform(place, lambda i: F.shiftleft(hash_(i), bits).bitwiseOR(i.cast("long")))
    two = F.transform(place, lambda i: F.struct(hash_(i).alias("h"), i.cast("long").alias("i")))
    rows = rows.withColumns({"one_": F.when(short, F.sort_array(F.when(short, one))), "two_": F.when(long, F.sort_array(F.when(long, two)))})

    def repeated(line: str, hash_of, place_of):
        near = lambda x, i: F.coalesce(hash_of(F.get(line, i + 1)) == hash_of(x), F.lit(False)) | F.coalesce(hash_of(F.get(line, i - 1)) == hash_of(x), F.lit(False))
        return F.filter(F.transform(F.col(line), lambda x, i: F.when(near(x, i), place_of(x))), lambda x: x.isNotNull())

    places = F.coalesce(repeated("one_", lambda x: F.shiftright(x, bits), lambda x: x.bitwiseAND(F.lit(mask).cast("long"))), repeated("two_", lambda x: x["h"], lambda x: x["i"]))
    rows = rows.withColumn("twice_", F.sort_array(places))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).cast("long").alias("last"))
    covered = F.aggregate("twice_", none, lambda s, x: F.struct((s["n"] + F.least(F.lit(3).cast("long"), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("n_", "one_", "two_", "twice_")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of every row (0 for a null text) and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")),
        "n_symbols": F.length("text") - F.length(F.translate("text", "#*$%&|<>", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
    }
    rows = with_repeats(rows.select("doc_id", "lang", "source", "w", *[c.cast("long").alias(n) for n, c in counts.items()])).drop("w")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def sketches(rows: DataFrame) -> list[DataFrame]:
    """Sketches of the metrics by language and source, by language and over all, each merged from the ones before it, with ``n`` rows."""
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, SKETCH).alias(m) for m in RANGES])
    out = [cut(own)]
    for by in (["lang"], []):
        out.append(cut(out[-1].groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in RANGES])))
    return out


def fences(level: DataFrame) -> DataFrame:
    """``level`` with low, high and width of each metric in place of its sketch."""
    for m, least in RANGES.items():
        low, high = (F.when(F.col("n") > 0, F.round(F.kll_sketch_get_quantile_double(m, F.lit(q)), DIGITS)) for q in (0.25, 0.75))
        width = FENCE * F.greatest(high - low, F.lit(least))
        level = level.withColumn(m, F.struct((low - width).alias("low"), (high + width).alias("high"), width.alias("width")))
    return level


def judge(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with ``kept``: what does not fail the base rule and lies within its group's fences."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumns({
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    })
    rows = cut(rows)
    used = rows.where("not base_failed").select("lang", "source", "n_words", "n_lines", *RANGES).distinct()
    own, lang, all_ = (fences(level) for level in sketches(used))
    own, lang = own.where(F.col("n") >= LEAST_ROWS), lang.where(F.col("n") >= LEAST_ROWS)

    def named(level: DataFrame, i: int) -> DataFrame:
        return cut(level.select(*[F.col(c).alias(f"{c}_{i}") for c in ("lang", "source") if c in level.columns], F.struct(*RANGES).alias(f"fence_{i}")))

    own, lang, all_ = named(own, 0), named(lang, 1), named(all_, 2)
    held = rows.join(own, rows.lang.eqNullSafe(own.lang_0) & rows.source.eqNullSafe(own.source_0), "left")
    held = held.join(lang, held.lang.eqNullSafe(lang.lang_1), "left").join(F.broadcast(all_), F.lit(True), "left")  # one row
    inside = F.lit(True)
    for m in RANGES:
        low = high = None
        for i in (2, 1, 0):  # each group's fence, no further out than the wider group's and its width
            f = F.col(f"fence_{i}")[m]
            own_low = f["low"] if low is None else F.greatest(f["low"], low - wide)
            own_high = f["high"] if high is None else F.least(f["high"], high + wide)
            low, high = (own_low, own_high) if low is None else (F.when(f.isNull(), low).otherwise(own_low), F.when(f.isNull(), high).otherwise(own_high))
            wide = f["width"] if i == 2 else F.coalesce(f["width"], wide)
        inside &= F.col(m) <= high
        if m == "word_length":
            inside &= F.col(m) >= low
    return held.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def op10_quality(spark, sf_dir):
    """A null, empty or blank text has no words and fails; null languages and sources are groups of their own."""
    rows = judge(measured(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
