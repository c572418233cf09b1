"""Registered queries of the analytics engine and their SQL, on the driver's tables.

Roles of the tables: ``events`` are score tracks by event type, ``embeddings``
are tiles by label, ``lineitem`` are intervals by part (returned: predicted,
none: positive, accepted: negative), ``documents`` are sequences (letters onto
the four bases in turn, anything else ambiguous).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions import sql
from strandline.operators import detect, evaluate, intervals, predict, tracks, vectors
from strandline.plans import configs
from strandline.sources import genomes

LETTERS = string.ascii_lowercase + string.ascii_uppercase
ON_BASES = "".join(S.BASES[i % 26 % 4] for i in range(52))
LEVEL, WIDTH, GAP, LEAST = 35, 20, 2, 3
TILE = 10


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def track(spark, d) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    return read(spark, d, "events").select(F.col("event_type").alias("accession"), idx.cast("long").alias("idx"), (F.lit(float(LEVEL)) - F.col("value")).alias("score"))


def tiles(spark, d) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, d, "embeddings").select(F.col("label").cast("long").alias("accession"), idx.cast("long").alias("tile_idx"), F.col("embedding").cast("array<double>").alias("vec"))


def sequences(spark, d) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.translate("text", LETTERS, ON_BASES).alias("seq"))


def parts(spark, d) -> DataFrame:
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    role = F.create_map(*[F.lit(x) for x in ("R", "pred", "N", "pos", "A", "neg")])
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("accession"), F.element_at(role, F.col("l_returnflag")).alias("role"), start.alias("start"), F.col("l_quantity").cast("long").alias("n"))
    return rows.select("accession", "role", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def role(spark, d, name) -> DataFrame:
    return parts(spark, d).where(F.col("role") == name)


SPAN = 3000

_SEQ = f"seqs AS (SELECT doc_id, translate(text, '{LETTERS}', '{ON_BASES}') AS seq FROM documents WHERE text IS NOT NULL)"
_CH = _SEQ + ", chars AS (SELECT doc_id, string_split(seq, '') AS c, length(seq) AS len FROM seqs)"
_TRACK = f"""track AS (SELECT event_type AS accession, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
  {LEVEL}.0 - value AS score, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""
_SMOOTH = f"""{_TRACK}, sm AS (SELECT accession, idx, n, score, CASE WHEN idx < {WIDTH // 2} OR idx >= n - {WIDTH // 2} OR n <= {WIDTH} THEN score
  ELSE list_sort(list(score) OVER (PARTITION BY accession ORDER BY idx ROWS BETWEEN {WIDTH // 2} PRECEDING AND {WIDTH // 2 - 1} FOLLOWING))[{WIDTH // 2 + 1}] END AS smoothed FROM track)"""
_RUNS = f"""{_SMOOTH}, fl AS (SELECT accession, idx, idx - row_number() OVER (PARTITION BY accession ORDER BY idx) AS g FROM sm WHERE smoothed < 0),
runs AS (SELECT accession, min(idx) AS first, max(idx) AS last FROM fl GROUP BY accession, g)"""
_MERGED = f"""m1 AS (SELECT accession, first, last, CASE WHEN first - max(last) OVER (PARTITION BY accession ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {GAP} THEN 0 ELSE 1 END AS new FROM runs),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY accession ORDER BY first) AS g FROM m1),
merged AS (SELECT accession, min(first) AS start, max(last) AS "end" FROM m2 GROUP BY accession, g)"""
_PARTS = """parts AS (SELECT l_partkey AS accession, CASE l_returnflag WHEN 'R' THEN 'pred' WHEN 'N' THEN 'pos' ELSE 'neg' END AS role,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) - 1 AS e FROM lineitem),
bases AS (SELECT DISTINCT accession, role, unnest(range(s, e + 1)) AS p FROM parts)"""
_CELL = f"""{_PARTS}, cell AS (SELECT accession, p, max(role = 'pred') AS pr, max(role = 'pos') AS po, max(role = 'neg') AS ne FROM bases GROUP BY accession, p),
conf AS (SELECT accession, CAST(count(*) FILTER (WHERE pr AND po) AS BIGINT) AS "TP", CAST(count(*) FILTER (WHERE NOT pr AND po) AS BIGINT) AS "FN",
  CAST(count(*) FILTER (WHERE pr AND ne) AS BIGINT) AS "FP", CAST(count(*) FILTER (WHERE NOT pr AND ne) AS BIGINT) AS "TN" FROM cell GROUP BY accession)"""
_COALESCE = """SELECT accession, min(p) AS start, max(p) AS "end" FROM (SELECT accession, p, p - row_number() OVER (PARTITION BY accession ORDER BY p) AS g FROM {}) GROUP BY accession, g"""
_RATES = """round(100.0 * coalesce("TP" / nullif("TP" + "FP", 0), 0), 6) AS precision, round(100.0 * coalesce("TP" / nullif("TP" + "FN", 0), 0), 6) AS recall,
  round(coalesce(("TP" * "TN" - "FP" * "FN") / nullif(sqrt(CAST("TP" + "FP" AS DOUBLE) * ("TP" + "FN") * ("TN" + "FP") * ("TN" + "FN")), 0), 0), 6) AS mcc"""
_BEST = f"""{_PARTS}, t AS (SELECT DISTINCT accession, s, e FROM parts WHERE role = 'pos'), p AS (SELECT accession, s, e FROM parts WHERE role = 'pred'),
j AS (SELECT t.accession, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe, least(t.e, p.e) - greatest(t.s, p.s) + 1 AS ov FROM t LEFT JOIN p ON p.accession = t.accession AND p.s <= t.e AND p.e >= t.s),
best AS (SELECT *, CASE WHEN ps IS NULL THEN 0.0 ELSE ov / (greatest(te, pe) - least(ts, ps) + 1) END AS jac FROM j QUALIFY row_number() OVER (PARTITION BY accession, ts, te ORDER BY CASE WHEN ps IS NULL THEN 0 ELSE ov END DESC, ps, pe) = 1)"""
_TILES = "tiles AS (SELECT CAST(label AS BIGINT) AS accession, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS tile_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_LONG = _TILES + ", long AS (SELECT accession, tile_idx, unnest(range(0, len(vec))) AS dim, unnest(vec) AS v FROM tiles)"
_ROBUST = f"""{_LONG}, c AS (SELECT accession, dim, median(v) AS m FROM long GROUP BY ALL),
o AS (SELECT l.accession, tile_idx, dim, v - m AS d FROM long l JOIN c USING (accession, dim)), mad AS (SELECT accession, dim, median(abs(d)) * 1.4826 + 1e-8 AS mad FROM o GROUP BY ALL),
rd AS (SELECT o.accession, tile_idx AS idx, sqrt(sum((d / mad) ** 2)) AS score FROM o JOIN mad USING (accession, dim) GROUP BY ALL)"""

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("q_base_counts", f"WITH {_SEQ} SELECT doc_id, {', '.join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in 'ATCG')} FROM seqs")
def q_base_counts(spark, d):
    return sequences(spark, d).select("doc_id", *[c.alias(f"n_{b.lower()}") for b, c in S.base_counts(F.col("seq")).items()])


@query("q_encode", f"WITH {_SEQ} SELECT doc_id, CAST(list_sum(list_transform(string_split(seq, ''), lambda ch: instr('ATCG', ch) - 1)) AS BIGINT) AS code_sum FROM seqs WHERE seq <> ''")
def q_encode(spark, d):
    parts = S.chunked(sequences(spark, d).where("seq <> ''"), "seq", S.CHUNK, 0)
    return parts.groupBy("doc_id").agg(F.sum(F.aggregate(S.encode(F.col("seq")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("code_sum"))


_ONE = _CH + ", one AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS pos FROM chars)"


def _K(k: int) -> str:
    next_ = " || ".join(["ch", *(f"lead(ch, {i}) OVER w" for i in range(1, k))])
    return f"{_ONE}, km AS (SELECT doc_id, pos, {next_} AS kmer FROM one WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), ok AS (SELECT * FROM km WHERE regexp_full_match(kmer, '[ATCG]{{{k}}}'))"


@query("q_kmer_counts", f"WITH {_K(3)} SELECT kmer, count(*) AS n, CAST(16 * (instr('ATCG', kmer[1]) - 1) + 4 * (instr('ATCG', kmer[2]) - 1) + instr('ATCG', kmer[3]) - 1 AS BIGINT) AS kid FROM ok GROUP BY kmer")
def q_kmer_counts(spark, d):
    return S.kmer_counts(sequences(spark, d).select("seq"), "seq", 3).select("kmer", "n", S.kmer_id(F.col("kmer"), 3).alias("kid"))


@query("q_tetra_profile", f"WITH {_K(4)} SELECT kmer, round(count(*) / sum(count(*)) OVER (), 9) AS f FROM ok GROUP BY kmer")
def q_tetra_profile(spark, d):
    n = S.kmer_counts(sequences(spark, d).select("seq"), "seq", 4)
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("kmer", F.round(F.col("n") / F.col("all"), 9).alias("f"))  # one row


@query("q_gc_skew", f"WITH {_SEQ}, n AS (SELECT doc_id, length(seq) AS len, length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'C', '')) AS c FROM seqs) SELECT doc_id, round((g + c) / len, 6) AS gc, round(coalesce((g - c) / nullif(g + c, 0), 0), 6) AS skew FROM n WHERE len > 0")
def q_gc_skew(spark, d):
    n = S.base_counts(F.col("seq"))
    return sequences(spark, d).where("seq <> ''").select("doc_id", r6((n["G"] + n["C"]) / F.length("seq"), "gc"), r6(S.gc_skew(n["G"], n["C"]), "skew"))


@query("q_window_grid", f"WITH {_SEQ} SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(seq) - 200) / 50)) AS BIGINT))) AS win_idx FROM seqs")
def q_window_grid(spark, d):
    return S.starts(sequences(spark, d).select("doc_id", F.length("seq").alias("len")), S.n_windows(F.col("len"), 200, 50), 50).select("doc_id", "win_idx")


@query("q_window_base_counts", f"WITH {_SEQ}, w AS (SELECT doc_id, seq, unnest(range(0, CAST(greatest(0, ceil((length(seq) - 200) / 50)) AS BIGINT))) AS win_idx FROM seqs), s AS (SELECT doc_id, win_idx, substring(seq, win_idx * 50 + 1, 200) AS s FROM w) SELECT doc_id, win_idx, {', '.join(f"length(s) - length(replace(s, '{b}', '')) AS n_{b.lower()}" for b in 'ATCG')} FROM s")
def q_window_base_counts(spark, d):
    return S.window_base_counts(sequences(spark, d), "seq", "doc_id", 200, 50).select("doc_id", "win_idx", *[F.col(b).alias(f"n_{b.lower()}") for b in S.BASES])


@query("q_window_any_step", f"WITH b AS (SELECT item_id, translate(text, '{LETTERS}', '{ON_BASES}') AS seq FROM benchmark WHERE text IS NOT NULL), s AS (SELECT item_id, seq, unnest(range(0, CAST(greatest(0, ceil((length(seq) - 50) / 3.0)) AS BIGINT))) AS win_idx FROM b), m AS (SELECT item_id, win_idx, substring(seq, win_idx * 3 + 1 + p, 4) AS kmer FROM s, (SELECT unnest(range(0, 47)) AS p)) SELECT item_id, win_idx, kmer, count(*) AS n FROM m WHERE regexp_full_match(kmer, '[ATCG]{{4}}') GROUP BY ALL")
def q_window_any_step(spark, d):
    """Windows that are no multiple of the step, k-mers longer than it."""
    items = read(spark, d, "benchmark").where("text is not null").select("item_id", F.translate("text", LETTERS, ON_BASES).alias("seq"))
    return S.window_kmer_counts(items, "seq", "item_id", 4, 50, 3)


@query("q_window_kmer_counts", f"WITH {_K(2)}, n AS (SELECT doc_id, CAST(greatest(0, ceil((len - 400) / 200)) AS BIGINT) AS n FROM chars), x AS (SELECT doc_id, kmer, n.n, pos, pos // 200 - o AS win_idx FROM ok JOIN n USING (doc_id), (VALUES (0), (1), (2)) v(o)) SELECT doc_id, win_idx, kmer, count(*) AS n FROM x WHERE win_idx >= 0 AND win_idx < n AND pos + 2 <= win_idx * 200 + 400 GROUP BY ALL")
def q_window_kmer_counts(spark, d):
    return S.window_kmer_counts(sequences(spark, d), "seq", "doc_id", 2, 400, 200)


_DI = f"{_K(2)}, di AS (SELECT kmer, count(*) AS n FROM ok GROUP BY kmer), b AS (SELECT ch, count(*) AS m FROM (SELECT unnest(c) AS ch FROM chars) WHERE ch IN ('A', 'T', 'C', 'G') GROUP BY ch)"


@query("q_karlin", f"WITH {_DI} SELECT kmer, round(n / (sqrt(x.m) * sqrt(y.m) + 1e-6), 6) AS normalized, round(n / (CAST(x.m AS DOUBLE) * y.m + 1e-6), 12) AS original FROM di JOIN b x ON x.ch = kmer[1] JOIN b y ON y.ch = kmer[2]")
def q_karlin(spark, d):
    di = S.kmer_counts(sequences(spark, d).select("seq"), "seq", 2)
    one = S.kmer_counts(sequences(spark, d).select("seq"), "seq", 1)
    x, y = one.select(F.col("kmer").alias("a"), F.col("n").cast("double").alias("x")), one.select(F.col("kmer").alias("b"), F.col("n").cast("double").alias("y"))
    rows = di.join(x, F.substring("kmer", 1, 1) == x.a).join(y, F.substring("kmer", 2, 1) == y.b)
    return rows.select("kmer", r6(S.karlin(F.col("n"), F.col("x"), F.col("y")), "normalized"), F.round(S.karlin(F.col("n"), F.col("x"), F.col("y"), "original"), 12).alias("original"))


@query("q_offset_entropy", f"WITH {_SEQ}, n AS (SELECT doc_id, {', '.join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS DOUBLE) AS {b}" for b in 'ATCG')} FROM seqs), t AS (SELECT *, A + T + C + G AS s FROM n) SELECT doc_id, round(CASE WHEN s <= 1e-6 THEN 0 ELSE {' + '.join(f'({b} / s + 1) * log2({b} / s + 1)' for b in 'ATCG')} END, 6) AS h FROM t WHERE s > 0 UNION ALL SELECT doc_id, 0.0 FROM t WHERE s = 0")
def q_offset_entropy(spark, d):
    n = S.base_counts(F.col("seq"))
    return sequences(spark, d).select("doc_id", F.array(*[n[b].cast("double") for b in S.BASES]).alias("n")).select("doc_id", r6(F.when(F.aggregate("n", F.lit(0.0), lambda a, x: a + x) > 0, S.offset_entropy(F.col("n"))).otherwise(0.0), "h"))


@query("q_codon_usage", f"WITH {_K(3)}, aa(codon, aa) AS (VALUES {', '.join(str(x) for x in S.CODONS.items())}) SELECT aa, count(*) AS n FROM ok JOIN aa ON codon = kmer GROUP BY aa")
def q_codon_usage(spark, d):
    n = S.kmer_counts(sequences(spark, d).select("seq"), "seq", 3)
    return n.groupBy(S.amino_acid(F.col("kmer")).alias("aa")).agg(F.sum("n").alias("n"))


@query("q_tile_bounds", f"WITH {_SEQ} SELECT doc_id, unnest(range(0, CAST(greatest(0, floor((length(seq) - 500) / 500) + 1) AS BIGINT))) AS tile_idx FROM seqs")
def q_tile_bounds(spark, d):
    return S.starts(sequences(spark, d).select("doc_id", F.length("seq").alias("len")), S.n_tiles(F.col("len"), 500), 500, "tile_idx").select("doc_id", "tile_idx")


@query("q_l2", f"WITH {_LONG}, n AS (SELECT accession, tile_idx, greatest(sqrt(sum(v * v)), 1e-8) AS n FROM long GROUP BY ALL) SELECT accession, tile_idx, dim, round(v / n, 6) AS value FROM long JOIN n USING (accession, tile_idx)")
def q_l2(spark, d):
    return tiles(spark, d).select("accession", "tile_idx", F.posexplode(vectors.l2(F.col("vec"))).alias("dim", "v")).select("accession", "tile_idx", F.col("dim").cast("long").alias("dim"), r6(F.col("v"), "value"))


@query("q_pool_windows", f"WITH {_LONG}, n AS (SELECT accession, max(tile_idx) + 1 AS n FROM tiles GROUP BY 1), w AS (SELECT accession, unnest(range(0, CAST(greatest(0, ceil((n * {TILE} - 35) / 5)) AS BIGINT))) AS win_idx FROM n), j AS (SELECT w.accession, win_idx, dim, v, least(win_idx * 5 + 35, (tile_idx + 1) * {TILE}) - greatest(win_idx * 5, tile_idx * {TILE}) AS wt FROM w JOIN long USING (accession)) SELECT accession, win_idx, dim, round(sum(wt * v) / sum(wt), 6) + 0.0 AS value FROM j WHERE wt > 0 GROUP BY ALL")
def q_pool_windows(spark, d):
    t = tiles(spark, d)
    n = t.groupBy("accession").agg(((F.max("tile_idx") + 1) * TILE).alias("len"))
    windows = S.starts(n, S.n_windows(F.col("len"), 35, 5), 5).select("accession", "win_idx", "start")
    # + 0.0: no negative zero
    return vectors.pool_windows(t, windows, TILE, 35).select("accession", "win_idx", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("q_robust_stat", f"WITH {_ROBUST} SELECT accession, idx, round(score, 5) AS score FROM rd")
def q_robust_stat(spark, d):
    return vectors.robust_distance(tiles(spark, d)).select("accession", F.col("tile_idx").alias("idx"), F.round("distance", 5).alias("score"))


@query("q_prefix_sums", f"WITH {_TRACK} SELECT accession, idx, round(sum(score) OVER (PARTITION BY accession ORDER BY idx), 4) AS upto FROM track")
def q_prefix_sums(spark, d):
    return tracks.prefix_sums(track(spark, d)).select("accession", "idx", F.round("upto", 4).alias("upto"))


@query("q_smooth5", f"WITH {_TRACK}, f AS (SELECT a.accession, a.idx, b.score FROM track a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) JOIN track b ON b.accession = a.accession AND b.idx = greatest(0, least(a.n - 1, a.idx + o))) SELECT accession, idx, round(list_sort(list(score))[3], 6) AS smoothed FROM f GROUP BY ALL")
def q_smooth5(spark, d):
    return tracks.smooth5(track(spark, d)).select("accession", "idx", r6(F.col("smoothed"), "smoothed"))


@query("q_detrend", f"WITH {_TRACK}, f AS (SELECT a.accession, a.idx, a.score AS own, b.score FROM track a, (SELECT unnest(range(-7, 8)) AS o) JOIN track b ON b.accession = a.accession AND b.idx = greatest(0, least(a.n - 1, a.idx + o))) SELECT accession, idx, round(own - list_sort(list(score))[8], 6) AS detrended FROM f GROUP BY accession, idx, own")
def q_detrend(spark, d):
    return tracks.detrend(track(spark, d), 15).select("accession", "idx", r6(F.col("detrended"), "detrended"))


@query("q_smooth_median", f"WITH {_SMOOTH} SELECT accession, idx, round(smoothed, 6) AS smoothed FROM sm")
def q_smooth_median(spark, d):
    return tracks.smooth_median(track(spark, d), WIDTH).select("accession", "idx", r6(F.col("smoothed"), "smoothed"))


@query("q_smooth_wide", f"WITH {_TRACK}, f AS (SELECT accession, idx, score, n, list(score) OVER (PARTITION BY accession ORDER BY idx ROWS BETWEEN 200 PRECEDING AND 199 FOLLOWING) AS l FROM track) SELECT accession, idx, round(CASE WHEN idx < 200 OR idx >= n - 200 OR n <= 400 THEN score ELSE list_sort(l)[201] END, 6) AS smoothed FROM f")
def q_smooth_wide(spark, d):
    return tracks.smooth_median(track(spark, d), 400).select("accession", "idx", r6(F.col("smoothed"), "smoothed"))


@query("q_detrend_wide", f"WITH {_TRACK}, f AS (SELECT a.accession, a.idx, a.score AS own, b.score FROM track a, (SELECT unnest(range(-200, 200)) AS o) JOIN track b ON b.accession = a.accession AND b.idx = greatest(0, least(a.n - 1, a.idx + o))) SELECT accession, idx, round(own - list_sort(list(score))[201], 6) AS detrended FROM f GROUP BY accession, idx, own")
def q_detrend_wide(spark, d):
    return tracks.detrend(track(spark, d), 400).select("accession", "idx", r6(F.col("detrended"), "detrended"))


@query("q_alien_runs", f"WITH {_RUNS}, {_MERGED} SELECT accession, start, \"end\" FROM merged WHERE \"end\" - start + 1 >= {LEAST}")
def q_alien_runs(spark, d):
    found = tracks.runs(tracks.alien(track(spark, d), WIDTH)).select("accession", F.col("first").alias("start"), F.col("last").alias("end"))
    return intervals.drop_short(intervals.joined(found, gap=GAP), LEAST)


for _assign, _shift in (("start", 0), ("center", 4950)):

    @query(f"q_project_{_assign}", f"WITH {_RUNS} SELECT accession, first * 100 + {_shift} AS start, (last + 1) * 100 + {_shift} - 1 AS \"end\" FROM runs")
    def _project(spark, d, assign=_assign):
        return tracks.project(tracks.runs(tracks.alien(track(spark, d), WIDTH)), 10000, 100, assign)


@query("q_cusum", f"WITH {_TRACK}, c AS (SELECT accession, idx + 1 AS k, n, sum(score) OVER (PARTITION BY accession ORDER BY idx) AS sl, sum(score) OVER (PARTITION BY accession) AS s FROM track) SELECT accession, k, n FROM c WHERE k < n QUALIFY row_number() OVER (PARTITION BY accession ORDER BY round(sqrt(k * (n - k) / n) * abs(sl / k - (s - sl) / (n - k)), 9) DESC, k) = 1")
def q_cusum(spark, d):
    return tracks.cusum(track(spark, d), ["accession"], "idx", "score")


@query("q_interval_union", f"WITH {_PARTS} " + _COALESCE.format("(SELECT DISTINCT accession, p FROM bases)"))
def q_interval_union(spark, d):
    return intervals.union(parts(spark, d))


@query("q_subtract", f"WITH {_CELL} " + _COALESCE.format("(SELECT accession, p FROM cell WHERE po AND NOT pr)"))
def q_subtract(spark, d):
    return intervals.subtract(role(spark, d, "pos"), role(spark, d, "pred"))


@query("q_complement", f"WITH {_PARTS}, g AS (SELECT accession, unnest(range(0, {SPAN})) AS p FROM (SELECT DISTINCT accession FROM parts)) " + _COALESCE.format("(SELECT g.accession, g.p FROM g ANTI JOIN bases USING (accession, p))"))
def q_complement(spark, d):
    p = parts(spark, d)
    lengths = p.select("accession").distinct().withColumn("length", F.lit(SPAN).cast("long"))
    return intervals.complement(intervals.clip(p.join(lengths, "accession")), lengths)


@query("q_confusion", f"WITH {_CELL} SELECT * FROM conf")
def q_confusion(spark, d):
    return intervals.confusion(parts(spark, d))


@query("q_rates", f"WITH {_CELL} SELECT accession, {_RATES} FROM conf")
def q_rates(spark, d):
    return evaluate.rates(intervals.confusion(parts(spark, d))).select("accession", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("mcc"), "mcc"))


@query("q_macro", f"WITH {_CELL}, r AS (SELECT {_RATES} FROM conf) SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 4) AS f1_of_means FROM r")
def q_macro(spark, d):
    m = q_rates(spark, d).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    return m.select(F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 4).alias("f1_of_means"))


@query("q_genome_wide", f"WITH {_CELL} SELECT accession, CAST(count(*) FILTER (WHERE pr AND po) AS BIGINT) AS \"TP\", CAST({SPAN} - count(*) FILTER (WHERE pr OR po) AS BIGINT) AS \"TN\" FROM cell GROUP BY accession")
def q_genome_wide(spark, d):
    seg = intervals.sweep(parts(spark, d), ["pred", "pos", "neg"])
    n, p, t = F.col("end") - F.col("start") + 1, F.col("pred") > 0, F.col("pos") > 0
    return seg.groupBy("accession").agg(F.sum(F.when(p & t, n).otherwise(0)).alias("TP"), (SPAN - F.sum(F.when(p | t, n).otherwise(0))).alias("TN"))


@query("q_strict_official", f"WITH {_CELL} SELECT accession, round(100.0 * count(*) FILTER (WHERE pr AND po) / nullif(count(*) FILTER (WHERE pr AND po) + count(*) FILTER (WHERE pr AND ne), 0), 6) AS official, round(100.0 * count(*) FILTER (WHERE pr AND po) / nullif(count(*) FILTER (WHERE pr), 0), 6) AS strict, round(count(*) FILTER (WHERE pr) / {SPAN}.0, 6) AS called FROM cell GROUP BY accession")
def q_strict_official(spark, d):
    seg = intervals.sweep(parts(spark, d), ["pred", "pos", "neg"])
    n, p = F.col("end") - F.col("start") + 1, F.col("pred") > 0
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    tp, fp, called = total(p & (F.col("pos") > 0)), total(p & (F.col("neg") > 0)), total(p)
    return seg.groupBy("accession").agg(r6(100 * F.try_divide(tp, tp + fp), "official"), r6(100 * F.try_divide(tp, called), "strict"), r6(called / F.lit(float(SPAN)), "called"))


@query("q_boundary_errors", f"WITH {_BEST} SELECT accession, ts, te, ps IS NOT NULL AS matched, ps - ts AS signed_start, pe - te AS signed_end, (abs(ps - ts) + abs(pe - te)) / 2 AS mean_err, round(jac, 6) AS jaccard FROM best")
def q_boundary_errors(spark, d):
    return intervals.best_overlap(role(spark, d, "pos"), role(spark, d, "pred")).select("accession", "ts", "te", "matched", "signed_start", "signed_end", "mean_err", r6(F.col("jaccard"), "jaccard"))


@query("q_boundary_summary", f"WITH {_BEST}, b AS (SELECT accession % 50 AS grp, * FROM best), e AS (SELECT grp, unnest([abs(ps - ts), abs(pe - te)]) AS err FROM b WHERE ps IS NOT NULL), es AS (SELECT grp, median(err) AS mabe, {', '.join(f'round(avg(CASE WHEN err <= {n} THEN 100.0 ELSE 0.0 END), 6) AS within_{n}' for n in (5, 10, 20))} FROM e GROUP BY grp) SELECT grp, CAST(count(ps) AS BIGINT) AS n_matched, round(median(CASE WHEN ps IS NOT NULL THEN jac END), 6) AS median_jaccard, any_value(mabe) AS mabe, any_value(within_5) AS within_5, any_value(within_10) AS within_10, any_value(within_20) AS within_20 FROM b LEFT JOIN es USING (grp) GROUP BY grp")
def q_boundary_summary(spark, d):
    m = intervals.best_overlap(role(spark, d, "pos"), role(spark, d, "pred")).withColumn("grp", F.col("accession") % 50)
    s = evaluate.boundary_summary(m, ["grp"], (5, 10, 20))
    return s.select("grp", "n_matched", r6(F.col("median_jaccard"), "median_jaccard"), "mabe", *[r6(F.col(f"within_{n}"), f"within_{n}") for n in (5, 10, 20)])


@query("q_both_agree", f"WITH {_PARTS} SELECT accession, s AS start, e AS \"end\" FROM parts m WHERE role = 'pred' AND EXISTS (SELECT 1 FROM parts o WHERE o.role = 'pos' AND o.accession = m.accession AND o.s <= m.e AND o.e >= m.s)")
def q_both_agree(spark, d):
    return intervals.overlapping(role(spark, d, "pred"), role(spark, d, "pos"))


@query("q_gene_in_interval", f"WITH {_PARTS}, g AS (SELECT accession, (s + e) // 2 AS pos FROM parts WHERE role = 'neg') SELECT accession, pos, EXISTS (SELECT 1 FROM parts o WHERE o.role = 'pred' AND o.accession = g.accession AND o.s <= pos AND o.e >= pos) AS inside FROM g")
def q_gene_in_interval(spark, d):
    genes = role(spark, d, "neg").select("accession", F.expr("(start + end) div 2").alias("pos"))
    return intervals.points_inside(genes, role(spark, d, "pred"))


@query("q_tiles_mask", f"WITH {_PARTS}, t AS (SELECT accession, unnest(range(0, {SPAN // 30})) AS tile_idx FROM (SELECT DISTINCT accession FROM parts)), h AS (SELECT DISTINCT accession, p // 30 AS tile_idx FROM bases WHERE role = 'pred') SELECT t.accession, t.tile_idx, h.tile_idx IS NOT NULL AS touched FROM t LEFT JOIN h ON h.accession = t.accession AND h.tile_idx = t.tile_idx")
def q_tiles_mask(spark, d):
    p = parts(spark, d)
    return vectors.tiles_mask(p.select("accession").distinct().withColumn("tiles", F.lit(SPAN // 30).cast("long")), role(spark, d, "pred"), 30)


_LAB = "lab AS (SELECT d.source, d.n_chars AS score, l.quality = 1 AS positive FROM documents d JOIN labels l USING (doc_id))"


@query("q_auc", f"WITH {_LAB}, r AS (SELECT source, positive, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM lab), s AS (SELECT source, count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg, sum(r) FILTER (WHERE positive) AS sr FROM r GROUP BY source) SELECT source, n_pos, n_neg, CASE WHEN n_pos >= 3 AND n_neg >= 3 THEN round((sr - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM s")
def q_auc(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))
    return evaluate.auc(rows, ["source"]).select("source", "n_pos", "n_neg", r6(F.col("auc"), "auc"))


_PAIR = "m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), t AS (SELECT list_sort(list(DISTINCT event_type)) AS t FROM events), pr AS (SELECT user_id, round(max(v) FILTER (WHERE event_type = t[1]) - max(v) FILTER (WHERE event_type = t[2]), 2) AS d FROM m, t GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = t[1]) > 0 AND count(*) FILTER (WHERE event_type = t[2]) > 0)"


def _pairs(spark, d):
    means = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    # the first two event types, as a row of two names beside each
    names = read(spark, d, "events").select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    named = means.join(F.broadcast(names), F.lit(True)).select("user_id", "v", (F.array_position("t", F.col("event_type"))).alias("nth"))  # one row of a few names
    return evaluate.paired(named, "user_id", "nth", "v", 1, 2).withColumn("d", F.round("d", 2))


@query("q_pivot_pairs", f"WITH {_PAIR} SELECT user_id, d FROM pr")
def q_pivot_pairs(spark, d):
    return _pairs(spark, d).select("user_id", "d")


def _signed_ranks(used: str, where: str) -> str:
    """Rank sums and z of ``pr``, of the rows ``used``, zero differences' ranks in halves."""
    return f"""r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM pr {where}),
ti AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT count(*) AS m FROM r GROUP BY abs(d))),
w AS (SELECT count(*) AS k, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END) AS wm FROM r)
SELECT (SELECT count(*) FROM pr) AS n, (SELECT count(*) FROM pr WHERE d > 0) AS wins, round(wp, 3) AS w_plus, round(wm, 3) AS w_minus,
  round((least(wp, wm) - k * (k + 1) / 4.0) / nullif(sqrt(k * (k + 1) * (2 * k + 1) / 24.0 - ties / 48.0), 0), 6) AS z FROM w, ti"""


for _zeros, _where in (("wilcox", "WHERE d <> 0"), ("zsplit", "")):

    @query("q_wilcoxon" if _zeros == "wilcox" else f"q_wilcoxon_{_zeros}", f"WITH {_PAIR}, {_signed_ranks(_zeros, _where)}")
    def q_wilcoxon(spark, d, zeros=_zeros):
        w = evaluate.wilcoxon(_pairs(spark, d), zeros)
        return w.select("n", "wins", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), r6(F.col("z"), "z"))


@query("q_bootstrap")
def q_bootstrap(spark, d):
    return evaluate.bootstrap(_pairs(spark, d).withColumnRenamed("user_id", "key"), 200)


@query("q_mcnemar", f"WITH {_PAIR}, c AS (SELECT count(*) FILTER (WHERE d > 0) AS gained, count(*) FILTER (WHERE d < 0) AS lost FROM pr), s AS (SELECT gained, lost, sum(exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))) AS tail FROM c, (SELECT unnest(range(0, 100000)) AS i) WHERE i <= least(gained, lost) GROUP BY ALL) SELECT gained, lost, round(least(1, 2 * tail), 6) AS p FROM s")
def q_mcnemar(spark, d):
    c = _pairs(spark, d).agg(F.sum((F.col("d") > 0).cast("long")).alias("gained"), F.sum((F.col("d") < 0).cast("long")).alias("lost"))
    return c.select("gained", "lost", r6(evaluate.binomial_two_sided(F.col("gained"), F.col("gained") + F.col("lost")), "p"))


_TAB = "c AS (SELECT d.source, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS a, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS b, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS c, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS d FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source)"


@query("q_fisher", f"WITH {_TAB}, i AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM c), l AS (SELECT source, a, b, c, d, sum(exp(lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(i+1) - lgamma(a+b-i+1) - lgamma(a+c-i+1) - lgamma(d-a+i+1))) AS p FROM i GROUP BY ALL) SELECT source, round(least(1, p), 6) AS p FROM l")
def q_fisher(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    cell = lambda t, q: F.sum(((F.col("toxic") == t) & (F.col("quality") == q)).cast("long"))
    c = rows.groupBy("source").agg(cell(1, 1).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(0, 0).alias("d"))
    return c.select("source", r6(evaluate.fisher_greater("a", "b", "c", "d"), "p"))


@query("q_sql_fisher", f"WITH {_TAB}, i AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM c), l AS (SELECT source, a, b, c, d, sum(exp(lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(i+1) - lgamma(a+b-i+1) - lgamma(a+c-i+1) - lgamma(d-a+i+1))) AS p FROM i GROUP BY ALL) SELECT source, round(least(1, p), 6) AS p FROM l")
def q_sql_fisher(spark, d):
    """As q_fisher, by the functions that ``spark.sql`` knows after :func:`strandline.functions.sql.register`."""
    sql.register(spark)
    for name in ("documents", "labels"):
        read(spark, d, name).createOrReplaceTempView(f"strandline_{name}")
    cell = lambda t, q: f"count_if(toxic = {t} AND quality = {q})"
    return spark.sql(f"SELECT source, round(fisher_greater(a, b, c, d), 6) AS p FROM (SELECT source, {cell(1, 1)} AS a, {cell(0, 1)} AS b, {cell(1, 0)} AS c, {cell(0, 0)} AS d FROM strandline_documents JOIN strandline_labels USING (doc_id) GROUP BY source)")


@query("q_sql_windows", f"WITH {_SEQ}, n AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(seq) - 400) / 200)) AS BIGINT))) AS win_idx FROM seqs) SELECT doc_id, win_idx, win_idx * 200 AS start FROM n")
def q_sql_windows(spark, d):
    """The window grid by a table function in SQL."""
    sql.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("strandline_documents")
    return spark.sql("SELECT doc_id, win_idx, start FROM (SELECT doc_id, length(text) AS n FROM strandline_documents) AS l, LATERAL series_windows(n, 400, 200)")


_CV = "s AS (SELECT user_id AS unit, user_id % 5 AS fold, event_type AS config, avg(value) AS v FROM events GROUP BY ALL)"


def _cv(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("unit"), (F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("config")).agg(F.avg("value").alias("v"))


@query("q_best_config", f"WITH {_CV} SELECT config, round(avg(v), 6) AS score FROM s GROUP BY config ORDER BY round(avg(v), 9) DESC, config LIMIT 1")
def q_best_config(spark, d):
    means = _cv(spark, d).groupBy("config").agg(F.avg("v").alias("score"))
    return evaluate.best_config(means, F.round("score", 9), ["config"]).select("config", r6(F.col("score"), "score"))


@query("q_kfold", f"WITH {_CV}, t AS (SELECT o AS \"out\", config, avg(v) AS tm FROM s, (SELECT unnest(range(0, 5)) AS o) WHERE fold <> o GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY \"out\" ORDER BY round(tm, 9) DESC, config) = 1) SELECT b.\"out\", b.config, round(b.tm, 6) AS train_mean, round(avg(s.v), 6) AS held_out_mean FROM b JOIN s ON s.fold = b.\"out\" AND s.config = b.config GROUP BY b.\"out\", b.config, b.tm")
def q_kfold(spark, d):
    return evaluate.cross_validate(_cv(spark, d), ["config"], "unit", "v", 5).select("out", "config", r6(F.col("train_mean"), "train_mean"), r6(F.col("held_out_mean"), "held_out_mean"))


@query("q_kde", "WITH v AS (SELECT l_quantity AS v, count(*) AS m FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem), g AS (SELECT unnest(range(0, 51)) * 1.0 AS x) SELECT x, round(sum(m * exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM g, v, s GROUP BY x")
def q_kde(spark, d):
    return evaluate.kde(read(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 51).select("x", F.round("density", 9).alias("density"))


@query("q_qcut", "WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY 1) SELECT p_partkey, CAST(p_retailprice > m AS INTEGER) AS half FROM part JOIN m USING (p_brand)")
def q_qcut(spark, d):
    return evaluate.halves(read(spark, d, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", "half")


@query("q_keyword_flags", "SELECT doc_id, regexp_matches(coalesce(text, ''), 'licen[sc]e', 'i') AS license, regexp_matches(coalesce(text, ''), 'token|secret', 'i') AS secret, regexp_matches(coalesce(text, ''), 'licen[sc]e|token|secret', 'i') AS any_flag FROM documents")
def q_keyword_flags(spark, d):
    found = evaluate.flags(F.col("text"), {"license": ["licen[sc]e"], "secret": ["token", "secret"]})
    return read(spark, d, "documents").select("doc_id", *[c.alias("any_flag" if n == "any_hgt" else n) for n, c in found.items()])


_CATS = {n: "|".join(p).replace("'", "''") for n, p in configs.CATEGORIES.items()}
_PRODUCTS = "c AS (SELECT list_sort(list(DISTINCT k)) AS k FROM (VALUES ('ISxx integrase'), ('IS256 element'), ('phage tail'), ('fimbrial protein'), ('toxin'), ('multidrug efflux pump'), ('plain protein'), ('TetracyclinE binding')) v(k))"
PRODUCTS = sorted(["ISxx integrase", "IS256 element", "phage tail", "fimbrial protein", "toxin", "multidrug efflux pump", "plain protein", "TetracyclinE binding"])


@query("q_categories", f"WITH {_PRODUCTS}, p AS (SELECT p_partkey, p_brand || ' ' || k[p_partkey % 8 + 1] AS product FROM part, c), f AS (SELECT p_partkey, {', '.join(f"regexp_matches(product, '{x}', 'i') AS {n}" for n, x in _CATS.items())} FROM p) SELECT *, mobility OR virulence OR resistance AS any_hgt FROM f")
def q_categories(spark, d):
    """Parts under made product names, by what the patterns of categories find in them."""
    product = F.concat("p_brand", F.lit(" "), F.get(F.array(*[F.lit(p) for p in PRODUCTS]), (F.col("p_partkey") % 8).cast("int")))
    return read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in evaluate.flags(product, configs.CATEGORIES).items()])


@query("q_header_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM conversations")
def q_header_fill(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return genomes.carried(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "user_turn").drop("role")


@query("q_union_dedup", "WITH u AS (SELECT l_orderkey AS k, l_linenumber AS o, l_extendedprice AS v FROM lineitem UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders) SELECT k, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC, v DESC) = 1")
def q_union_dedup(spark, d):
    u = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), F.col("l_extendedprice").alias("v"))
    u = u.unionByName(read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("o"), F.col("o_totalprice").alias("v")))
    return genomes.last_of(u, ["k"], ["o"]).select("k", "v")


@query("q_resume_antijoin", "SELECT o_orderkey, sha1(o_orderpriority)[1:10] AS digest FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def q_resume_antijoin(spark, d):
    done = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return genomes.missing(read(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey", F.substring(F.sha1("o_orderpriority"), 1, 10).alias("digest"))


@query("q_refine")
def q_refine(spark, d):
    signal = vectors.robust_distance(tiles(spark, d)).select("accession", F.col("tile_idx").alias("idx"), F.col("distance").alias("score"))
    size = signal.groupBy("accession").agg((F.count("*") * TILE).alias("length"))
    coarse = size.select("accession", F.expr("length div 3").alias("start"), F.expr("2 * length div 3").alias("end"))
    return tracks.refine(coarse, signal, TILE, 80, 120, size)


@query("q_pca")
def q_pca(spark, d):
    return detect.pca(tiles(spark, d), 4).select("accession", "tile_idx", *[r6(F.get("scores", F.lit(i)), f"pc{i + 1}") for i in range(4)])


@query("q_mcd_scores")
def q_mcd_scores(spark, d):
    x = detect.pca(tiles(spark, d), 4).select("accession", F.col("tile_idx").alias("idx"), F.col("scores").alias("x"))
    return detect.two_stage_envelope(x, stride=1).select("accession", "idx", r6(F.col("score"), "score"))


_BASE_OF = "substring('ATCG', CAST(vec[2 * j - 1] > 0 AS INTEGER) * 2 + CAST(vec[2 * j] > 0 AS INTEGER) + 1, 1)"
_LSEQ = f"{_TILES}, lseq AS (SELECT accession, string_agg(s, '' ORDER BY tile_idx) AS seq, count(*) * {TILE} AS len FROM (SELECT accession, tile_idx, array_to_string(list_transform(range(1, {TILE + 1}), lambda j: {_BASE_OF}), '') AS s FROM tiles) GROUP BY accession)"


def label_sequences(spark, d) -> DataFrame:
    """(accession, seq): bases by the signs of each tile's first entries, so that a series has tiles and a sequence."""
    bit = lambda i: (F.get("vec", F.lit(i)) > 0).cast("int")
    own = F.concat(*[F.substring(F.lit(S.BASES), bit(2 * j) * 2 + bit(2 * j + 1) + 1, F.lit(1)) for j in range(TILE)])
    rows = tiles(spark, d).select("accession", "tile_idx", own.alias("s"))
    whole = F.array_sort(F.collect_list(F.struct("tile_idx", "s")))  # a sequence, as the readers give it
    return rows.groupBy("accession").agg(F.array_join(F.transform(whole, lambda t: t["s"]), "").alias("seq"))


def _windowed(k: int) -> str:
    """Counts of the k-mers of each window of 400 at steps of 200, as wk<k>."""
    next_ = " || ".join(["ch", *(f"lead(ch, {i}) OVER w" for i in range(1, k))])
    return f"""km{k} AS (SELECT doc_id, pos, {next_} AS kmer FROM one {"WINDOW w AS (PARTITION BY doc_id ORDER BY pos)" if k > 1 else ""}),
wk{k} AS (SELECT doc_id, kmer, pos // 200 - o AS win_idx, count(*) AS c FROM km{k} JOIN nw USING (doc_id), (VALUES (0), (1)) v(o) WHERE regexp_full_match(kmer, '[ATCG]{{{k}}}') AND pos // 200 - o >= 0 AND pos // 200 - o < n AND pos + {k} <= (pos // 200 - o) * 200 + 400 GROUP BY ALL)"""


def _entropy(rows: str, f: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, win_idx, sum((f / s + 1) * log2(f / s + 1)) AS {name} FROM (SELECT doc_id, win_idx, {f} AS f, sum({f}) OVER (PARTITION BY doc_id, win_idx) AS s FROM {rows}) GROUP BY ALL)"


_AA = ", ".join(str(x) for x in S.CODONS.items())
_FEATURES = f"""{_ONE}, nw AS (SELECT doc_id, CAST(greatest(0, ceil((len - 400) / 200)) AS BIGINT) AS n FROM chars), {', '.join(_windowed(k) for k in (1, 2, 3, 4))},
grid AS (SELECT doc_id, unnest(range(0, n)) AS win_idx FROM nw),
b1 AS (SELECT doc_id, win_idx, sum(c) FILTER (WHERE kmer = 'G') AS g, sum(c) FILTER (WHERE kmer = 'C') AS c FROM wk1 GROUP BY ALL),
bias AS (SELECT p.doc_id, p.win_idx, p.c / (sqrt(x.c) * sqrt(y.c) + 1e-6) AS f FROM wk2 p JOIN wk1 x ON x.doc_id = p.doc_id AND x.win_idx = p.win_idx AND x.kmer = p.kmer[1] JOIN wk1 y ON y.doc_id = p.doc_id AND y.win_idx = p.win_idx AND y.kmer = p.kmer[2]),
acid AS (SELECT doc_id, win_idx, aa, sum(c) AS f FROM wk3 JOIN (VALUES {_AA}) v(codon, aa) ON codon = kmer GROUP BY ALL),
{_entropy("bias", "f", "h_dinuc")}, {_entropy("acid", "f", "h_aa")}, {_entropy("wk4", "c", "h_tetra")}"""


@query("q_window_features", f"WITH {_FEATURES} SELECT doc_id, win_idx, round((coalesce(g, 0) + coalesce(c, 0)) / 400.0, 6) AS gc, round(coalesce((coalesce(g, 0) - coalesce(c, 0)) / nullif(coalesce(g, 0) + coalesce(c, 0), 0), 0), 6) AS skew, {', '.join(f'round(coalesce({h}, 0), 6) AS {h}' for h in ('h_dinuc', 'h_aa', 'h_tetra'))} FROM grid LEFT JOIN b1 USING (doc_id, win_idx) LEFT JOIN h_dinuc USING (doc_id, win_idx) LEFT JOIN h_aa USING (doc_id, win_idx) LEFT JOIN h_tetra USING (doc_id, win_idx)")
def q_window_features(spark, d):
    f = S.window_features(sequences(spark, d), "seq", "doc_id", 400, 200)
    return f.select("doc_id", "win_idx", *[r6(F.col(c), c) for c in ("gc", "skew", "h_dinuc", "h_aa", "h_tetra")])


@query("q_fused_windows", f"""WITH {_LSEQ}, long AS (SELECT accession, tile_idx, unnest(range(0, len(vec))) AS dim, unnest(vec) AS v FROM tiles),
w AS (SELECT accession, seq, unnest(range(0, CAST(greatest(0, ceil((len - 40) / 10)) AS BIGINT))) AS win_idx FROM lseq),
c AS (SELECT accession, win_idx, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'C', '')) AS c FROM (SELECT accession, win_idx, substring(seq, win_idx * 10 + 1, 40) AS s FROM w)),
j AS (SELECT w.accession, win_idx, dim, v, least(win_idx * 10 + 40, (tile_idx + 1) * {TILE}) - greatest(win_idx * 10, tile_idx * {TILE}) AS wt FROM w JOIN long USING (accession))
SELECT accession, win_idx, dim, round(sum(wt * v) / sum(wt), 6) AS value FROM j WHERE wt > 0 GROUP BY ALL
UNION ALL SELECT accession, win_idx, 64, round((g + c) / 40.0, 6) FROM c UNION ALL SELECT accession, win_idx, 65, round(coalesce((g - c) / nullif(g + c, 0), 0), 6) FROM c""")
def q_fused_windows(spark, d):
    """Pooled tile vectors and composition of the same windows, one after the other."""
    t, seq = tiles(spark, d), label_sequences(spark, d)
    windows = S.starts(seq.select("accession", F.length("seq").alias("len")), S.n_windows(F.col("len"), 40, 10), 10).select("accession", "win_idx", "start")
    n = S.window_counts(seq, "seq", "accession", [], 40, 10)
    c, g = F.get("c1", F.lit(2)), F.get("c1", F.lit(3))
    composition = n.select("accession", "win_idx", F.array((g + c) / 40, S.gc_skew(g, c)).alias("vec"))
    fused = predict.window_matrix([vectors.pool_vectors(t, windows, TILE, 40), composition])
    return fused.select("accession", "win_idx", F.posexplode("vec").alias("dim", "v")).select("accession", "win_idx", F.col("dim").cast("long").alias("dim"), r6(F.col("v"), "value"))


@query("q_cosine_guard", f"WITH {_TILES}, c AS (SELECT list_dot_product(vec, r) / greatest(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(r, r)), 1e-12) AS c FROM (SELECT vec, list_transform(vec, lambda x: round(x, 1)) AS r FROM tiles)) SELECT count(*) AS n, round(min(c), 9) AS lowest, coalesce(min(c) > 0.999, false) AS accepted FROM c")
def q_cosine_guard(spark, d):
    """Vectors against themselves with one digit."""
    t = tiles(spark, d).withColumn("short", F.transform("vec", lambda x: F.round(x, 1)))
    return vectors.cosine_guard(t, "vec", "short").withColumn("lowest", F.round("lowest", 9))


@query("q_evaluate", f"WITH {_PARTS}, l AS (SELECT DISTINCT accession FROM parts), cell AS (SELECT accession, p, max(role = 'pred') AS pr, max(role = 'pos') AS po, max(role = 'neg') AS ne FROM bases WHERE p < {SPAN // 3} GROUP BY accession, p), n AS (SELECT accession, count(*) FILTER (WHERE pr AND po) AS tp, count(*) FILTER (WHERE NOT pr AND po) AS fn, count(*) FILTER (WHERE pr AND ne) AS fp, count(*) FILTER (WHERE NOT pr AND ne) AS tn FROM cell GROUP BY accession) SELECT l.accession, coalesce(tp, 0) AS \"TP\", coalesce(fn, 0) AS \"FN\", coalesce(fp, 0) AS \"FP\", coalesce(tn, 0) AS \"TN\", round(100.0 * coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(100.0 * coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM l LEFT JOIN n USING (accession)")
def q_evaluate(spark, d):
    """All intervals clipped to a third of the span, and counted."""
    lengths = parts(spark, d).select("accession").distinct().withColumn("length", F.lit(SPAN // 3).cast("long"))
    found = evaluate.rates(intervals.evaluated(*[role(spark, d, r) for r in ("pred", "pos", "neg")], lengths))
    return found.select("accession", "TP", "FN", "FP", "TN", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query("q_pipeline_composition")
def q_pipeline_composition(spark, d):
    """The compositional baseline over the labels' sequences."""
    return predict.by_composition(label_sequences(spark, d), 80, 10, 5, 20)


@query("q_pipeline_embedding")
def q_pipeline_embedding(spark, d):
    """The whole predictor on tile vectors alone."""
    return _predicted(spark, d, None)


@query("q_pipeline_fused")
def q_pipeline_fused(spark, d):
    """The whole predictor on tile vectors and composition."""
    f = S.window_features(label_sequences(spark, d), "seq", "accession", 80, 10)
    return _predicted(spark, d, predict.composition_matrix(f))


def _predicted(spark, d, composition) -> DataFrame:
    t = tiles(spark, d)
    lengths = t.groupBy("accession").agg(((F.max("tile_idx") + 1) * TILE).alias("length"))
    return predict.by_vectors(t, lengths, TILE, 80, 10, 4, 5, 20, 30, composition, refine=(80, 120), stride=1)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(O)
