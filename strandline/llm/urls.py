"""URL filters: fixed rules by host and path, else association rules mined from labelled URLs.

FP-growth mines the token combinations of labelled URLs. Those that imply a
verdict, block or allow, with enough confidence, support and lift are kept,
without those that one with fewer tokens covers. They stand in an inverted index
under their rarest token; a URL is held against the combinations under its own
tokens only, and the surest one decides.

URLs are labelled by the fixed rule that fits them, else by the page's label.
Tokens that stand in the same URLs are one token to the miner, and tokens of all
URLs none, as each constant part of a URL would double the combinations.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, keyed, table

#: The rules of the query, as host/path, with their verdicts.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Least support of a combination, as a share and as a number of URLs, its least confidence and lift over the verdict's
#: share, and about how many labelled URLs it is fitted on at most (by the hash of their ids).
SUPPORT, LEAST, CONFIDENCE, LIFT, FITTED = 0.001, 10, 0.6, 1.2, 200_000
VERDICTS = ("allow", "block")


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_: Column, path_: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains whose path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        of, _, rest = rule.partition("/")
        fits = ((host_ == of) | host_.endswith("." + of)) & path_.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: parts of the host and their words, path parts (digits as one), query keys, fragment."""
    h, p = host(url), path(url)
    parts = F.filter(F.split(h, r"\."), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.*)", 1)
    found = F.concat(
        F.transform(parts, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.flatten(F.transform(parts, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>")))), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
        F.when(fragment != "", F.array(F.concat(F.lit("f:"), fragment))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def distinct_tokens(labelled: DataFrame) -> DataFrame:
    """``labelled`` (id, tokens, verdict) with one token for all that stand in the same rows, and none that stands in all."""
    held = labelled.select("id", F.explode("tokens").alias("token"))
    marks = held.groupBy("token").agg(F.count("*").alias("uses"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    leads = marks.groupBy("uses", "mark").agg(F.min("token").alias("token"))
    leads = leads.join(F.broadcast(labelled.agg(F.count("*").alias("all"))), F.col("uses") < F.col("all")).select("token")  # one row
    few_ = held.join(leads, "token").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("few"))  # of one URL's tokens
    return labelled.join(few_, "id", "left").select("id", F.coalesce("few", F.array().cast("array<string>")).alias("tokens"), "verdict")


def mine(labelled: DataFrame) -> DataFrame:
    """``labelled`` (id, tokens, verdict) to the combinations (combination array, verdict, confidence, support) that imply a verdict.

    The number of combinations grows with those that rows share; nothing bounds it but the least support.
    """
    rows = cut(distinct_tokens(labelled).select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    support = min(1.0, max(SUPPORT, LEAST / max(1, rows.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE).fit(rows)
    is_verdict = F.get("consequent", F.lit(0)).isin([f"={v}" for v in VERDICTS])
    found = model.associationRules.where(is_verdict & (F.col("lift") >= LIFT)).select(F.array_sort("antecedent").alias("combination"), F.substring(F.get("consequent", F.lit(0)), 2, 9).alias("verdict"), "confidence", "support")
    found = cut(found)
    # a combination goes if one with fewer tokens, all of them its own, implies the same at least as surely;
    # the shorter one is looked up under that of its tokens that the fewest combinations have
    parts = found.select("combination", F.explode("combination").alias("token"))
    seldom = parts.groupBy("token").agg(F.count("*").alias("in_"))
    nth = F.row_number().over(Window.partitionBy("combination", "verdict").orderBy("in_", "token"))
    short = found.select("*", F.explode("combination").alias("token")).join(seldom, "token").withColumn("nth", nth).where("nth = 1")
    short = short.select(F.col("combination").alias("less"), F.col("confidence").alias("less_confidence"), "verdict", "token")
    long = found.select("*", F.explode("combination").alias("token"))
    covered = long.join(short, ["token", "verdict"]).where((F.size("less") < F.size("combination")) & (F.size(F.array_except("less", "combination")) == 0) & (F.col("less_confidence") >= F.col("confidence")))
    return found.join(covered.select("combination", "verdict").distinct(), ["combination", "verdict"], "left_anti")


def decided(urls: DataFrame, combinations: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` (url, tokens) that hold a combination, with the verdict and confidence of the surest one.

    Of equally sure ones that with the larger support decides, of those a block.
    """
    uses = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    parts = combinations.select("*", F.explode("combination").alias("token")).join(uses, "token", "left")
    rarest = F.row_number().over(Window.partitionBy("combination", "verdict").orderBy(F.col("uses").asc_nulls_first(), "token"))
    index = cut(parts.withColumn("nth", rarest).where("nth = 1").select("token", "combination", "verdict", "confidence", "support"))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("combination", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best")).select("url", "best.verdict", "best.confidence")


def teaching(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(id, tokens, verdict) of the pages (id, page_id, host, path, tokens) that a fixed rule or a label says something of."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    verdict = F.coalesce(fixed_verdict(fixed_rule(F.col("host"), F.col("path"), rules), rules), F.when(F.col("bad"), "block").when(~F.col("bad"), "allow"))
    return pages.join(of, "page_id", "left").select("id", "tokens", verdict.alias("verdict")).where("verdict is not null")


def fixed_verdict(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules.items():
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def prepared(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, tokens, id) of ``pages``, written; ``id`` is a number of the row."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.cast("string").alias("url"))
    return keyed(rows.withColumns({"host": host(url), "path": path(url), "tokens": tokens(url)}), "id")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) label the page of the same id: bad if
    quality is 0 or toxic is 1. Without a fixed rule the verdict is that of the
    surest mined combination that fits, with its confidence, else allow. A null
    url, or one without ``://``, has an empty host and path and is allowed.
    Repeated rows get equal verdicts; an empty table gives no rows; without
    labelled pages no combination is mined. Other columns are not read.
    """
    rows = prepared(pages)
    labelled = cut(teaching(rows, labels, rules))
    share = min(1.0, FITTED / max(1, labelled.count()))
    combinations = mine(labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    free = rows.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    hits = decided(free.where("rule is null and url is not null").select("url", "tokens").dropDuplicates(["url"]), combinations)
    hits = cut(hits.select(F.col("url").alias("hit"), F.col("verdict").alias("mined"), "confidence"))
    out = free.join(hits, free.url == hits.hit, "left")
    verdict = F.coalesce(fixed_verdict(F.col("rule"), rules), F.when(F.col("rule").isNull(), F.col("mined")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def op9_urls(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_urls": op9_urls}
ORACLES: dict[str, str] = {}
