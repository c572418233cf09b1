"""Report queries over several methods, synthetic sequences and parsed files, on the driver's tables.

Beside the roles of :mod:`strandline.plans.catalogue`: the predicted intervals
of a part belong to one of three methods by their line number, and all methods
are held against the same positive and negative intervals. ``documents`` are
hosts of planted inserts, the benchmark's items their donors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import evaluate, intervals, predict, synthetic, tracks
from strandline.plans.catalogue import _CV, _cv, _K, _PARTS, _RUNS, _SEQ, _signed_ranks, _TILES, GAP, LEAST, SPAN, WIDTH, parts, r6, read, sequences, tiles, track
from strandline.sources import genomes
from strandline.sources.staging import cut

METHODS, TILE, NEED, EDGE, FLANK = 3, 10, 2, 40, 15
INSERT = TILE * NEED

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def shared_intervals(spark, d) -> DataFrame:
    """(accession, role, start, end): each method's predictions as pred_<method>, and all others, which every method shares."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    role = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("pred_"), (F.col("l_linenumber") % METHODS).cast("string"))).when(F.col("l_returnflag") == "N", "pos").otherwise("neg")
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("accession"), role.alias("role"), start.alias("start"), (start + F.col("l_quantity").cast("long") - 1).alias("end"))


BY, ALL_METHODS = ["accession", "method"], list(range(METHODS))

_MI = f"""mi AS (SELECT l_partkey AS accession, unnest(CASE WHEN l_returnflag = 'R' THEN [CAST(l_linenumber % {METHODS} AS BIGINT)] ELSE CAST([0, 1, 2] AS BIGINT[]) END) AS method,
  CASE l_returnflag WHEN 'R' THEN 'pred' WHEN 'N' THEN 'pos' ELSE 'neg' END AS role, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) - 1 AS e FROM lineitem)"""
_MC = f"""{_MI}, bases AS (SELECT DISTINCT accession, method, role, unnest(range(s, e + 1)) AS p FROM mi),
cell AS (SELECT accession, method, p, max(role = 'pred') AS pr, max(role = 'pos') AS po, max(role = 'neg') AS ne FROM bases GROUP BY ALL),
conf AS (SELECT accession, method, count(*) FILTER (WHERE pr AND po) AS tp, count(*) FILTER (WHERE NOT pr AND po) AS fn, count(*) FILTER (WHERE pr AND ne) AS fp, count(*) FILTER (WHERE pr) AS called FROM cell GROUP BY ALL),
rate AS (SELECT *, 100.0 * coalesce(tp / nullif(tp + fp, 0), 0) AS p, 100.0 * coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM conf),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM rate)"""
_MB = f"""{_MI}, t AS (SELECT DISTINCT accession, method, s, e FROM mi WHERE role = 'pos'), p AS (SELECT accession, method, s, e FROM mi WHERE role = 'pred'),
best AS (SELECT t.accession, t.method, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe FROM t LEFT JOIN p ON p.accession = t.accession AND p.method = t.method AND p.s <= t.e AND p.e >= t.s
  QUALIFY row_number() OVER (PARTITION BY t.accession, t.method, t.s, t.e ORDER BY CASE WHEN p.s IS NULL THEN 0 ELSE least(t.e, p.e) - greatest(t.s, p.s) + 1 END DESC, p.s, p.e) = 1)"""


def by_method(spark, d, totals) -> DataFrame:
    """(accession, method, ``totals``): the positive and negative intervals are swept once for all methods."""
    return intervals.by_method(shared_intervals(spark, d), ALL_METHODS, totals)


def _rates(spark, d):
    return evaluate.rates(by_method(spark, d, intervals.CONFUSION))


def _matches(spark, d):
    rows = shared_intervals(spark, d)
    preds = rows.where("role not in ('pos', 'neg')").withColumn("method", F.substring("role", 6, 1).cast("long"))
    return intervals.best_overlap(rows.where("role = 'pos'"), preds, methods=ALL_METHODS)


@query("q_report_main", f"WITH {_MC}, m AS (SELECT method, count(*) AS n, avg(p) AS p, avg(r) AS r, avg(f1) AS f1 FROM f GROUP BY method) SELECT method, n, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_of_means FROM m")
def q_report_main(spark, d):
    m = _rates(spark, d).groupBy("method").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    p, r = F.col("precision"), F.col("recall")
    return m.select("method", "n", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")], r6(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "f1_of_means"))


_ABLATION = " UNION ALL ".join(
    f"""SELECT CAST({m} AS BIGINT) AS method, (SELECT count(*) FROM d{m}) AS n, (SELECT count(*) FROM d{m} WHERE d > 0) AS wins, (SELECT round(avg(d), 6) FROM d{m}) AS mean_diff,
  round(sum(r) FILTER (WHERE d > 0), 3) AS w_plus, round(sum(r) FILTER (WHERE d < 0), 3) AS w_minus FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d{m} WHERE d <> 0)"""
    for m in range(1, METHODS)
)
_DIFFS = ", ".join(f"d{m} AS (SELECT round(a.f1 - b.f1, 9) AS d FROM f a JOIN f b USING (accession) WHERE a.method = {m} AND b.method = 0)" for m in range(1, METHODS))


@query("q_report_ablation", f"WITH {_MC}, {_DIFFS} {_ABLATION}")
def q_report_ablation(spark, d):
    f1 = cut(_rates(spark, d).select(*BY, "f1"))  # each comparison reads it several times
    found = None
    for m in range(1, METHODS):  # the methods, not rows
        diffs = evaluate.paired(f1, "accession", "method", "f1", m, 0).withColumn("d", F.round("d", 9))
        one = evaluate.wilcoxon(diffs).select(F.lit(m).cast("long").alias("method"), "n", "wins", r6(F.col("mean_diff"), "mean_diff"), F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"))
        found = one if found is None else found.union(one)
    return found


@query("q_report_protocol", f"WITH {_MC} SELECT method, round(avg(100.0 * tp / nullif(tp + fp, 0)), 6) AS official, round(avg(100.0 * tp / nullif(called, 0)), 6) AS strict, round(avg(called / {SPAN}.0), 6) AS called FROM conf GROUP BY method")
def q_report_protocol(spark, d):
    each = by_method(spark, d, {"tp": lambda p, t, f: p & t, "fp": lambda p, t, f: p & f, "called": lambda p, t, f: p})
    tp, fp, called = F.col("tp"), F.col("fp"), F.col("called")
    return each.groupBy("method").agg(r6(F.avg(100 * F.try_divide(tp, tp + fp)), "official"), r6(F.avg(100 * F.try_divide(tp, called)), "strict"), r6(F.avg(called / F.lit(float(SPAN))), "called"))


@query("q_report_fractions", f"WITH {_MC}, s AS (SELECT accession, method, count(*) FILTER (WHERE pr) AS called, count(*) FILTER (WHERE po OR ne) AS scored, count(*) FILTER (WHERE pr AND (po OR ne)) AS hit FROM cell GROUP BY ALL) SELECT method, round(avg(100.0 * called / {SPAN}), 6) AS called, round(avg(100.0 * scored / {SPAN}), 6) AS scored, round(avg(100.0 * hit / nullif(called, 0)), 6) AS called_scored FROM s GROUP BY method")
def q_report_fractions(spark, d):
    """What of a sequence is called, what is scored, and what of the called is."""
    each = by_method(spark, d, {"called": lambda p, t, f: p, "scored": lambda p, t, f: t | f, "both": lambda p, t, f: p & (t | f)})
    share = lambda c: r6(F.avg(100 * F.col(c) / F.lit(float(SPAN))), c)
    return each.groupBy("method").agg(share("called"), share("scored"), r6(F.avg(100 * F.try_divide("both", "called")), "called_scored"))


@query("q_report_boundaries", f"WITH {_MB}, e AS (SELECT method, unnest([abs(ps - ts), abs(pe - te)]) AS err FROM best WHERE ps IS NOT NULL), m AS (SELECT method, CAST(median(err) AS DOUBLE) AS mabe FROM e GROUP BY method) SELECT method, count(ps) AS n_matched, CAST(median(ps - ts) AS DOUBLE) AS median_signed_start, CAST(median(pe - te) AS DOUBLE) AS median_signed_end, any_value(mabe) AS mabe, round(avg(CASE WHEN ps IS NULL THEN 0.0 ELSE 100.0 END), 6) AS detection_rate FROM best JOIN m USING (method) GROUP BY method")
def q_report_boundaries(spark, d):
    found = _matches(spark, d)
    rate = found.groupBy("method").agg(r6(100 * F.avg(F.col("matched").cast("int")), "detection_rate"))
    return evaluate.boundary_summary(found, ["method"]).join(rate, "method").select("method", "n_matched", "median_signed_start", "median_signed_end", "mabe", "detection_rate")


@query("q_report_edges", f"WITH {_MB}, j AS (SELECT x.ps IS NOT NULL AS mx, y.ps IS NOT NULL AS my, abs(x.ps - x.ts) AS ex, abs(y.ps - y.ts) AS ey FROM best x JOIN best y USING (accession, ts, te) WHERE x.method = 1 AND y.method = 0) SELECT count(*) AS n, count(*) FILTER (WHERE mx AND NOT my) AS gained, count(*) FILTER (WHERE my AND NOT mx) AS lost, count(*) FILTER (WHERE ex < ey) AS nearer, CAST(median(ex - ey) AS DOUBLE) AS median_diff FROM j")
def q_report_edges(spark, d):
    """The same islands under two methods: which finds them, and whose start lies nearer."""
    found = _matches(spark, d)
    key = ["accession", "ts", "te"]
    x, y = (found.where(F.col("method") == m).select(*key, F.col("matched").alias(f"m{n}"), F.col("start_err").alias(f"e{n}")) for m, n in ((1, "x"), (0, "y")))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return x.join(y, key).agg(F.count("*").alias("n"), n(F.col("mx") & ~F.col("my")).alias("gained"), n(F.col("my") & ~F.col("mx")).alias("lost"), n(F.col("ex") < F.col("ey")).alias("nearer"), F.median(F.col("ex") - F.col("ey")).alias("median_diff"))


@query("q_report_enrichment", f"WITH {_PARTS}, u AS (SELECT DISTINCT accession, p FROM bases WHERE role = 'pred'), g AS (SELECT l_partkey AS accession, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS pos, o_orderpriority AS category FROM orders JOIN lineitem ON l_orderkey = o_orderkey), i AS (SELECT g.*, u.p IS NOT NULL AS inside FROM g LEFT JOIN u ON u.accession = g.accession AND u.p = g.pos), t AS (SELECT count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_out FROM i), c AS (SELECT category, count(*) FILTER (WHERE inside) AS a, count(*) FILTER (WHERE NOT inside) AS b FROM i GROUP BY category) SELECT category, a AS marker_in, n_in AS genes_in, round(100.0 * a / greatest(n_in, 1), 6) AS rate_in, round(100.0 * b / greatest(n_out, 1), 6) AS rate_out, round(CASE WHEN b * (n_in - a) = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(a AS DOUBLE) * (n_out - b) / (b * (n_in - a)) END, 6) AS odds_ratio FROM c, t")
def q_report_enrichment(spark, d):
    """Orders as genes at their dates: how often each priority lies in the predicted intervals of the order's parts."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("accession"))
    genes = read(spark, d, "orders").select("o_orderkey", day.alias("pos"), F.col("o_orderpriority").alias("category")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("accession", "pos", "category")
    found = intervals.points_inside(genes, parts(spark, d).where("role = 'pred'"))
    c = found.groupBy("category").agg(F.sum(F.col("inside").cast("long")).alias("a"), F.sum((~F.col("inside")).cast("long")).alias("b"))
    t = c.agg(F.sum("a").alias("n_in"), F.sum("b").alias("n_out"))
    a, b, n_in, n_out = (F.col(x) for x in ("a", "b", "n_in", "n_out"))
    ratio = evaluate.odds_ratio(a.cast("double"), b.cast("double"), (n_in - a).cast("double"), (n_out - b).cast("double"))
    return c.crossJoin(F.broadcast(t)).select("category", a.alias("marker_in"), n_in.alias("genes_in"), r6(100 * a / F.greatest(n_in, F.lit(1)), "rate_in"), r6(100 * b / F.greatest(n_out, F.lit(1)), "rate_out"), r6(ratio, "odds_ratio"))  # one row


@query("q_best_dims", "WITH m AS (SELECT event_type AS representation, user_id % 5 AS dims, round(avg(value), 9) AS mean FROM events GROUP BY ALL) SELECT representation, dims, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY representation ORDER BY mean DESC, dims) = 1")
def q_best_dims(spark, d):
    m = read(spark, d, "events").groupBy(F.col("event_type").alias("representation"), (F.col("user_id") % 5).alias("dims")).agg(F.round(F.avg("value"), 9).alias("mean"))
    return evaluate.best_config(m, F.col("mean"), ["dims"], ["representation"]).select("representation", "dims", r6(F.col("mean"), "mean"))


@query("q_contrast", "SELECT lang, round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_in, round(avg(n_chars) FILTER (WHERE quality = 0), 6) AS mean_out, round(avg(n_chars) FILTER (WHERE quality = 1) / nullif(avg(n_chars) FILTER (WHERE quality = 0), 0), 6) AS contrast FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def q_contrast(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")
    inside, out = (F.avg(F.when(F.col("quality") == i, F.col("n_chars"))) for i in (1, 0))
    return rows.groupBy("lang").agg(r6(inside, "mean_in"), r6(out, "mean_out"), r6(F.try_divide(inside, out), "contrast"))


def _runs(spark, d):
    return tracks.runs(tracks.alien(track(spark, d), WIDTH))


for _name, _shift in (("start", 0), ("center", 30 // 2 - 10 // 2)):

    @query(f"q_project_narrow_{_name}", f'WITH {_RUNS} SELECT accession, CAST(first * 10 + {_shift} AS BIGINT) AS start, CAST((last + 1) * 10 + {_shift} - 1 AS BIGINT) AS "end" FROM runs')
    def q_project(spark, d, assign=_name):
        return tracks.project(_runs(spark, d), 30, 10, assign)


_M = f"""WITH {_RUNS}, m1 AS (SELECT accession, first, last, CASE WHEN first - max(last) OVER (PARTITION BY accession ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= {GAP} THEN 0 ELSE 1 END AS new FROM runs),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY accession ORDER BY first) AS g FROM m1)"""


@query("q_merge_close", f'{_M} SELECT accession, CAST(min(first) AS BIGINT) AS start, CAST(max(last) AS BIGINT) AS "end" FROM m2 GROUP BY accession, g')
def q_merge_close(spark, d):
    return intervals.joined(tracks.project(_runs(spark, d), 1, 1, "start"), gap=GAP)


@query("q_drop_short", f'WITH {_RUNS} SELECT accession, CAST(first AS BIGINT) AS start, CAST(last AS BIGINT) AS "end" FROM runs WHERE last - first + 1 >= {LEAST}')
def q_drop_short(spark, d):
    return intervals.drop_short(tracks.project(_runs(spark, d), 1, 1, "start"), LEAST)


def hosts(spark, d) -> DataFrame:
    """(accession, seq, length): sequences long enough for three inserts."""
    rows = sequences(spark, d).select(F.col("doc_id").alias("accession"), "seq", F.length("seq").cast("long").alias("length"))
    return rows.where(F.col("length") >= 4 * EDGE)


def host_lengths(spark, d) -> DataFrame:
    """(accession, length) of :func:`hosts`, written once: a sequence has as many letters as its text, so none is translated."""
    rows = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("accession"), F.length("text").cast("long").alias("length"))
    return cut(rows.where(F.col("length") >= 4 * EDGE))


def quarters(found: DataFrame) -> DataFrame:
    """Offsets at the last tile's start before each quarter: a placement without hashes, so that SQL can follow it."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k")
    return found.select("accession", "length", k).select("accession", "k", (F.expr(f"(length * (k + 1)) div {4 * TILE}") * TILE).alias("offset"))


_HOSTS = f"{_SEQ}, hosts AS (SELECT doc_id AS accession, seq, CAST(length(seq) AS BIGINT) AS length FROM seqs WHERE length(seq) >= {4 * EDGE})"
_OFFSETS = f"{_HOSTS}, k AS (SELECT unnest(CAST([0, 1, 2] AS BIGINT[])) AS k), offs AS (SELECT accession, length, k, (length * (k + 1)) // {4 * TILE} * {TILE} AS o FROM hosts, k)"


@query("q_chimera_coords", f'WITH {_OFFSETS} SELECT accession, k, o + k * {INSERT} AS start, o + k * {INSERT} + {INSERT - 1} AS "end" FROM offs')
def q_chimera_coords(spark, d):
    return synthetic.inserts(quarters(hosts(spark, d)), INSERT)


@query("q_chimera_shift", f'WITH {_OFFSETS} SELECT accession, length // 3 + {INSERT} * count(*) FILTER (WHERE o <= length // 3) AS start, 2 * length // 3 + {INSERT} * count(*) FILTER (WHERE o <= 2 * length // 3) AS "end" FROM offs GROUP BY accession, length')
def q_chimera_shift(spark, d):
    h = hosts(spark, d).select("accession", "length")
    return synthetic.shifted(_third(h), quarters(h), INSERT)


def _third(h: DataFrame) -> DataFrame:
    return h.select("accession", F.expr("length div 3").alias("start"), F.expr("2 * length div 3").alias("end"))


@query("q_chimera_splice", f"WITH {_OFFSETS}, items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, text AS b FROM benchmark WHERE text IS NOT NULL), m AS (SELECT count(*) AS m FROM items), donor AS (SELECT offs.accession, k, o, b FROM offs, m JOIN items ON i = (offs.accession * 3 + k) % m), w AS (SELECT accession, any_value(h.seq) AS q, list(b ORDER BY k) AS b, list(o ORDER BY k) AS o FROM donor JOIN hosts h USING (accession) GROUP BY accession), s AS (SELECT accession, substring(q, 1, o[1]) || b[1] || substring(q, o[1] + 1, o[2] - o[1]) || b[2] || substring(q, o[2] + 1, o[3] - o[2]) || b[3] || substring(q, o[3] + 1) AS s FROM w) SELECT accession, CAST(length(s) AS BIGINT) AS length, md5(s) AS digest FROM s")
def q_chimera_splice(spark, d):
    """Three whole items of the benchmark, others for each host, put into its sequence."""
    h = hosts(spark, d)
    items = read(spark, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("block"))
    line = numbered(items, "item_id")
    offsets = quarters(h)
    wanted = offsets.join(F.broadcast(items.agg(F.count("*").alias("m"))), F.lit(True)).select("accession", "k", ((F.col("accession") * 3 + F.col("k")) % F.col("m")).alias("nth"))  # one row
    made = synthetic.splice(h.select("accession", "seq"), wanted.join(line, "nth").select("accession", "k", "block"), offsets)
    return made.select("accession", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``nth``, their number from 0 in the order of ``by``: the benchmark's items, a list that is short beside all else."""
    return rows.withColumn("nth", (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


@query("q_chimera_tiles", f"WITH {_TILES}, n AS (SELECT accession, count(*) AS n FROM tiles GROUP BY accession), k AS (SELECT unnest(CAST([0, 1, 2] AS BIGINT[])) AS k), offs AS (SELECT accession, n, k, n * (k + 1) // 4 AS o FROM n, k), old AS (SELECT t.accession, t.tile_idx + {NEED} * count(*) FILTER (WHERE o <= t.tile_idx) AS tile_idx, any_value(vec) AS vec FROM tiles t JOIN offs USING (accession) GROUP BY t.accession, t.tile_idx), put AS (SELECT offs.accession, o + k * {NEED} + t.tile_idx AS tile_idx, t.vec FROM offs JOIN tiles t ON t.accession = (offs.accession + 1) % 10 AND t.tile_idx < {NEED}) SELECT accession, tile_idx, unnest(range(0, len(vec))) AS dim, unnest(list_transform(vec, lambda v: round(v, 6))) AS value FROM (SELECT * FROM old UNION ALL SELECT * FROM put)")
def q_chimera_tiles(spark, d):
    """Each label's vectors with blocks of the next label's first vectors put in at the quarters."""
    t = tiles(spark, d)
    n = t.groupBy("accession").agg(F.count("*").alias("length"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k")
    offsets = n.select("accession", "length", k).select("accession", "k", (F.expr("(length * (k + 1)) div 4") * TILE).alias("offset"))
    donor = t.where(F.col("tile_idx") < NEED).select(F.pmod(F.col("accession") - 1, F.lit(10)).cast("long").alias("accession"), k, F.col("tile_idx").alias("nth"), "vec")
    made = synthetic.assemble_tiles(t, donor, offsets, TILE, NEED, n.select("accession", (F.col("length") + 3 * NEED).alias("tiles")))
    return made.select("accession", "tile_idx", F.posexplode("vec").alias("dim", "v")).select("accession", "tile_idx", F.col("dim").cast("long").alias("dim"), r6(F.col("v"), "value"))


@query("q_negative_regions", f'WITH {_OFFSETS}, iv AS (SELECT accession, o + k * {INSERT} - {FLANK} AS s, o + k * {INSERT} + {INSERT - 1 + FLANK} AS e FROM offs UNION ALL SELECT accession, length // 3 + {INSERT} * count(*) FILTER (WHERE o <= length // 3), 2 * length // 3 + {INSERT} * count(*) FILTER (WHERE o <= 2 * length // 3) FROM offs GROUP BY accession, length), m AS (SELECT *, max(e) OVER (PARTITION BY accession ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), gaps AS (SELECT accession, coalesce(reach + 1, 0) AS start, s - 1 AS "end" FROM m WHERE s > coalesce(reach + 1, 0) UNION ALL SELECT accession, max(e) + 1, max(length) + {3 * INSERT} - 1 FROM iv JOIN hosts USING (accession) GROUP BY accession) SELECT * FROM gaps WHERE "end" >= start')
def q_negative_regions(spark, d):
    h = host_lengths(spark, d)
    offsets = quarters(h)
    lengths = h.select("accession", (F.col("length") + 3 * INSERT).alias("length"))
    return synthetic.negative_regions(synthetic.inserts(offsets, INSERT), synthetic.shifted(_third(h), offsets, INSERT), lengths, FLANK)


@query("q_chimera_placed")
def q_chimera_placed(spark, d):
    """Inserts placed in hash order, away from the edges and the middle third, and from each other."""
    h = host_lengths(spark, d)
    places = synthetic.candidates(h, TILE, EDGE, _third(h), FLANK)
    return synthetic.inserts(synthetic.place(places, 3, 5 * TILE, tile=TILE), INSERT)


@query("q_fasta", f"""WITH {_SEQ}, c AS (SELECT doc_id, '>' || doc_id || chr(10) || regexp_replace(seq, '[^\\x00-\\x7F]', 'N', 'g') AS content FROM seqs),
s AS (SELECT doc_id, upper(array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(x, '>')), lambda x: regexp_replace(x, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), '')) AS s FROM c)
SELECT CAST(doc_id AS VARCHAR) AS accession, CAST(length(s) AS BIGINT) AS length, md5(s) AS digest FROM s""")
def q_fasta(spark, d):
    content = F.concat(F.lit(">"), "doc_id", F.lit("\n"), F.regexp_replace("seq", r"[^\x00-\x7F]", "N"))
    read_ = sequences(spark, d).select(F.col("doc_id").cast("string").alias("accession"), genomes.fasta_sequence(content).alias("seq"))
    return read_.select("accession", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


@query("q_feature_table", """SELECT l_partkey AS accession, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS "end", 'line ' || l_linenumber AS product FROM lineitem WHERE l_returnflag = 'R'""")
def q_feature_table(spark, d):
    """Line items written as feature tables of their parts, some from end to start, and read back."""
    a, b = F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_quantity").cast("long")
    back = F.col("l_linestatus") == "O"
    kind = F.when(F.col("l_returnflag") == "R", "CDS").otherwise("gene")
    spot = F.concat(F.lit("<"), F.when(back, b).otherwise(a).cast("string"), F.lit("\t>"), F.when(back, a).otherwise(b).cast("string"), F.lit("\t"), kind)
    named = F.concat(F.lit("\t\t\tproduct\tline "), F.col("l_linenumber").cast("string"))
    # lines of one item follow each other; the order of the items in a table is free
    rows = read(spark, d, "lineitem").select("*", (3 * F.monotonically_increasing_id()).alias("first"))
    made = F.inline(F.array(*[F.struct((F.col("first") + i).alias("line_no"), x.alias("line")) for i, x in enumerate((spot, F.lit("\t\t\tproduct\tearlier"), named))]))
    return genomes.feature_table(rows.select(F.col("l_partkey").alias("accession"), made))


@query("q_protein_table", """SELECT l_partkey AS accession, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS "end", 'g' || l_suppkey AS gene, l_returnflag AS product FROM lineitem WHERE l_linestatus = 'O'""")
def q_protein_table(spark, d):
    """Line items written as protein tables of their parts, some too short to count, and read back."""
    span = F.concat(F.col("l_orderkey").cast("string"), F.lit(".."), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).cast("string"))
    full = F.concat_ws("\t", span, F.lit("+"), F.lit("9"), F.lit("1"), F.concat(F.lit("g"), F.col("l_suppkey").cast("string")), F.lit("-"), F.lit("-"), F.lit("-"), "l_returnflag")
    item = F.when(F.col("l_linestatus") == "O", full).otherwise(F.concat_ws("\t", span, F.lit("+")))
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("accession"), (F.col("l_orderkey") * 32 + F.col("l_linenumber") + 1).alias("line_no"), item.alias("line"))
    heads = rows.select("accession", F.lit(0).cast("long").alias("line_no"), F.lit("Location\tStrand").alias("line")).distinct()
    return genomes.protein_table(heads.union(rows))


@query("q_comp_distance", f"""WITH {_K(4)}, n AS (SELECT lang, kmer, count(*) AS n FROM ok JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY ALL), f AS (SELECT lang, kmer, n / sum(n) OVER (PARTITION BY lang) AS f FROM n),
p AS (SELECT kmer, coalesce(max(f) FILTER (WHERE lang = 'en'), 0) AS x, coalesce(max(f) FILTER (WHERE lang = 'de'), 0) AS y FROM f GROUP BY kmer)
SELECT 'en' AS a, 'de' AS b, (SELECT round(abs(max(gc) FILTER (WHERE lang = 'en') - max(gc) FILTER (WHERE lang = 'de')), 9) FROM (SELECT lang, sum(CASE WHEN ch IN ('G', 'C') THEN 1.0 ELSE 0 END) / count(*) AS gc FROM one JOIN documents USING (doc_id) WHERE ch IN ('A', 'T', 'C', 'G') AND lang IN ('en', 'de') GROUP BY lang)) AS gc_difference, round(sqrt(sum((x - y) ** 2)), 9) AS euclidean, round(sum(abs(x - y)), 9) AS manhattan, round(1 - sum(x * y) / (sqrt(sum(x ** 2)) * sqrt(sum(y ** 2)) + 1e-12), 9) AS cosine FROM p""")
def q_comp_distance(spark, d):
    """Distances of the tetranucleotide profiles of two languages' documents."""
    lang = read(spark, d, "documents").select("doc_id", "lang").where("lang is not null")
    rows = sequences(spark, d).join(lang, "doc_id").select(F.col("lang").alias("name"), "seq")
    n = S.kmer_counts(rows, "seq", 4)
    f = n.select("name", "kmer", (F.col("n") / F.sum("n").over(Window.partitionBy("name"))).alias("f"))
    gc = S.gc_difference(rows.select("name", *[c.alias(b) for b, c in S.base_counts(F.col("seq")).items()]), "en", "de")
    both = S.profile_distances(f, "en", "de").crossJoin(F.broadcast(gc))  # one row each
    return both.select("a", "b", *[F.round(c, 9).alias(c) for c in ("gc_difference", "euclidean", "manhattan", "cosine")])


@query("q_report_familiarity", f"WITH {_MC} SELECT method, count(*) FILTER (WHERE accession % 3 = 0) AS n_in, round(avg(f1) FILTER (WHERE accession % 3 = 0), 6) AS f1_in, round(avg(f1) FILTER (WHERE accession % 3 <> 0), 6) AS f1_out FROM f GROUP BY method")
def q_report_familiarity(spark, d):
    """Mean F1 of the sequences that a flag sets apart, and of the others."""
    known = F.col("accession") % 3 == 0
    return _rates(spark, d).groupBy("method").agg(F.sum(known.cast("long")).alias("n_in"), r6(F.avg(F.when(known, F.col("f1"))), "f1_in"), r6(F.avg(F.when(~known, F.col("f1"))), "f1_out"))


@query("q_report_detection", f"WITH {_MB}, m AS (SELECT method, quantile_cont(te - ts + 1, 0.5) AS m FROM best GROUP BY method) SELECT method, CAST(te - ts + 1 > m AS INTEGER) AS half, count(*) AS n, round(avg(CASE WHEN ps IS NULL THEN 0.0 ELSE 100.0 END), 6) AS detection_rate FROM best JOIN m USING (method) GROUP BY ALL")
def q_report_detection(spark, d):
    """Detection rates of the shorter and the longer half of the positive intervals."""
    found = _matches(spark, d).withColumn("size", F.col("te") - F.col("ts") + 1)
    return evaluate.halves(found, "size", ["method"]).groupBy("method", "half").agg(F.count("*").alias("n"), r6(100 * F.avg(F.col("matched").cast("int")), "detection_rate"))


@query("q_report_cases", f"""WITH {_MC}, {_MB.removeprefix(_MI + ", ")}, np AS (SELECT accession, method, count(*) FILTER (WHERE role = 'pred') AS n_pred FROM mi GROUP BY ALL),
e AS (SELECT accession, method, unnest([abs(ps - ts), abs(pe - te)]) AS err FROM best WHERE ps IS NOT NULL), eb AS (SELECT accession, method, CAST(median(err) AS DOUBLE) AS mabe FROM e GROUP BY ALL), nm AS (SELECT accession, method, count(ps) AS n_matched FROM best GROUP BY ALL)
SELECT accession, method, n_pred, tp, fp, round(f.p, 6) AS precision, round(f.r, 6) AS recall, round(f1, 6) AS f1, n_matched, mabe FROM f JOIN np USING (accession, method) LEFT JOIN nm USING (accession, method) LEFT JOIN eb USING (accession, method)""")
def q_report_cases(spark, d):
    """Each sequence and method: how many intervals are predicted, with what rates and boundary errors."""
    n = shared_intervals(spark, d).groupBy("accession").agg(*[F.sum((F.col("role") == f"pred_{m}").cast("long")).alias(str(m)) for m in ALL_METHODS])
    n = n.select("accession", F.inline(F.array(*[F.struct(F.lit(m).cast("long").alias("method"), F.col(str(m)).alias("n_pred")) for m in ALL_METHODS])))
    edges = evaluate.boundary_summary(_matches(spark, d), BY).select(*BY, "n_matched", "mabe")
    rows = _rates(spark, d).join(n, BY).join(edges, BY, "left")
    return rows.select(*BY, "n_pred", F.col("TP").alias("tp"), F.col("FP").alias("fp"), *[r6(F.col(c), c) for c in ("precision", "recall", "f1")], "n_matched", "mabe")


@query("q_report_cv", f'WITH {_CV}, i AS (SELECT config, avg(v) AS m FROM s GROUP BY config ORDER BY round(avg(v), 9) DESC, config LIMIT 1), t AS (SELECT o AS "out", config, avg(v) AS tm FROM s, (SELECT unnest(range(0, 5)) AS o) WHERE fold <> o GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY "out" ORDER BY round(tm, 9) DESC, config) = 1), h AS (SELECT b."out", avg(s.v) AS m FROM b JOIN s ON s.fold = b."out" AND s.config = b.config GROUP BY 1) SELECT config, round(m, 6) AS in_sample, (SELECT round(avg(h.m), 6) FROM h) AS held_out FROM i')
def q_report_cv(spark, d):
    """The configuration chosen on all units with its mean, and the mean over folds of what was chosen without them."""
    scores = _cv(spark, d)
    chosen = evaluate.best_config(scores.groupBy("config").agg(F.avg("v").alias("m")), F.round("m", 9), ["config"])
    held = evaluate.cross_validate(scores, ["config"], "unit", "v", 5).agg(r6(F.avg("held_out_mean"), "held_out"))
    return chosen.select("config", r6(F.col("m"), "in_sample")).crossJoin(F.broadcast(held))  # one row


#: Mean F1 of the methods as published, to hold others against (fixed values).
PUBLISHED = {0: 55.17, 1: 52.33, 2: 49.10}


@query("q_report_fidelity", f"WITH {_MC}, m AS (SELECT method, avg(p) AS p, avg(r) AS r, avg(f1) AS f1 FROM f GROUP BY method), c(method, published) AS (VALUES {', '.join(f'({m}, {v})' for m, v in PUBLISHED.items())}) SELECT method, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(published AS DOUBLE) AS published, round(f1 - published, 6) AS difference, round(max(abs(f1 - published)) OVER (), 6) AS worst FROM m JOIN c USING (method)")
def q_report_fidelity(spark, d):
    """Means of the methods beside published ones, and the largest difference."""
    means = _rates(spark, d).groupBy("method").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    published = F.create_map(*[F.lit(x) for m, v in PUBLISHED.items() for x in (m, v)])[F.col("method").cast("int")]
    rows = means.withColumn("published", published).where("published is not null").withColumn("difference", F.col("f1") - F.col("published"))
    worst = F.max(F.abs("difference")).over(Window.partitionBy())  # over a row for each method
    return rows.withColumn("worst", worst).select("method", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")], "published", r6(F.col("difference"), "difference"), r6(F.col("worst"), "worst"))


@query("q_report_projection", f"WITH {_MB}, pr AS (SELECT accession, x.ps - x.ts AS a, y.ps - y.ts AS b, (x.ps - x.ts) - (y.ps - y.ts) AS d FROM best x JOIN best y USING (accession, ts, te) WHERE x.method = 1 AND y.method = 0 AND x.ps IS NOT NULL AND y.ps IS NOT NULL), {_signed_ranks('wilcox', 'WHERE d <> 0').replace('SELECT (SELECT count(*) FROM pr) AS n', 'SELECT (SELECT round(avg(a), 6) FROM pr) AS mean_start, (SELECT round(avg(d), 6) FROM pr) AS shift, (SELECT count(*) FROM pr) AS n')}")
def q_report_projection(spark, d):
    """How far one method's signed start errors lie from another's on the islands that both find, with the paired test."""
    found = _matches(spark, d).where("matched").select("accession", "ts", "te", "method", "signed_start")
    diffs = evaluate.paired(found.select(F.struct("accession", "ts", "te").alias("key"), "method", F.col("signed_start").cast("double").alias("v")), "key", "method", "v", 1, 0)
    mean = diffs.agg(r6(F.avg("x"), "mean_start"), r6(F.avg("d"), "shift"))
    w = evaluate.wilcoxon(diffs).select("n", "wins", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), r6(F.col("z"), "z"))
    return mean.crossJoin(F.broadcast(w))  # one row each


_AUCS = "lab AS (SELECT d.source, d.lang, l.quality = 1 AS positive, unnest([0, 1]) AS representation, unnest([CAST(d.n_chars AS DOUBLE), CAST((d.doc_id * 7919) % 1009 AS DOUBLE)]) AS score FROM documents d JOIN labels l USING (doc_id) WHERE d.source IS NOT NULL AND d.lang IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY source, lang, representation ORDER BY score) + (count(*) OVER (PARTITION BY source, lang, representation, score) - 1) / 2.0 AS r FROM lab), s AS (SELECT source, lang, representation, count(*) FILTER (WHERE positive) AS n1, count(*) FILTER (WHERE NOT positive) AS n0, sum(r) FILTER (WHERE positive) AS sr FROM r GROUP BY ALL), a AS (SELECT source, lang, representation, round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auc FROM s WHERE n1 >= 3 AND n0 >= 3)"


@query("q_report_representations", f"WITH {_AUCS} SELECT representation, count(*) AS n, round(avg(auc), 6) AS mean_auc, round(median(auc), 6) AS median_auc, (SELECT count(*) FROM a x JOIN a y USING (source, lang) WHERE x.representation = 0 AND y.representation = 1 AND x.auc > y.auc) AS wins, (SELECT round(avg(x.auc - y.auc), 6) FROM a x JOIN a y USING (source, lang) WHERE x.representation = 0 AND y.representation = 1) AS mean_diff FROM a GROUP BY representation")
def q_report_representations(spark, d):
    """AUC of two scores in every source and language, their means, and the paired comparison."""
    rows = read(spark, d, "documents").where("source is not null and lang is not null").join(read(spark, d, "labels"), "doc_id")
    two = F.inline(F.array(F.struct(F.lit(0).alias("representation"), F.col("n_chars").cast("double").alias("score")), F.struct(F.lit(1).alias("representation"), ((F.col("doc_id") * 7919) % 1009).cast("double").alias("score"))))
    a = evaluate.auc(rows.select("source", "lang", (F.col("quality") == 1).alias("positive"), two), ["source", "lang", "representation"]).where("auc is not null").withColumn("auc", F.round("auc", 9))
    both = evaluate.paired(a.select(F.struct("source", "lang").alias("key"), "representation", "auc"), "key", "representation", "auc", 0, 1)
    pair = both.agg(F.sum((F.col("d") > 0).cast("long")).alias("wins"), r6(F.avg("d"), "mean_diff"))
    each = a.groupBy("representation").agg(F.count("*").alias("n"), r6(F.avg("auc"), "mean_auc"), r6(F.median("auc"), "median_auc"))
    return each.crossJoin(F.broadcast(pair)).withColumn("wins", F.coalesce("wins", F.lit(0)))  # one row


@query("q_report_dims", "WITH s AS (SELECT user_id // 5 AS accession, user_id % 5 AS dims, event_type AS representation, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT representation, dims, round(avg(v), 9) AS mean FROM s GROUP BY ALL), b AS (SELECT representation, dims FROM m QUALIFY row_number() OVER (PARTITION BY representation ORDER BY mean DESC, dims) = 1), p AS (SELECT accession, representation, v FROM s JOIN b USING (representation, dims)), l AS (SELECT min(representation) AS first FROM p) SELECT y.representation, count(*) AS n, count(*) FILTER (WHERE x.v > y.v) AS wins, round(avg(x.v - y.v), 6) AS mean_diff FROM p x JOIN p y USING (accession), l WHERE x.representation = first AND y.representation <> first GROUP BY y.representation")
def q_report_dims(spark, d):
    """Each representation at its own best number of dimensions, and the first one's paired differences from the others."""
    s = read(spark, d, "events").groupBy((F.expr("user_id div 5")).alias("accession"), (F.col("user_id") % 5).alias("dims"), F.col("event_type").alias("representation")).agg(F.avg("value").alias("v"))
    means = s.groupBy("representation", "dims").agg(F.round(F.avg("v"), 9).alias("mean"))
    best = evaluate.best_config(means, F.col("mean"), ["dims"], ["representation"]).select("representation", "dims")
    p = s.join(best, ["representation", "dims"])
    first = p.agg(F.min("representation").alias("first"))
    rows = p.join(F.broadcast(first), F.lit(True))  # one row
    x = rows.where("representation = first").select("accession", F.col("v").alias("x"))
    pairs = rows.where("representation <> first").join(x, "accession")
    return pairs.groupBy("representation").agg(F.count("*").alias("n"), F.sum((F.col("x") > F.col("v")).cast("long")).alias("wins"), r6(F.avg(F.col("x") - F.col("v")), "mean_diff"))


@query("q_report_competitor", f"WITH {_MC}, o AS (SELECT p_partkey AS accession, CAST(p_size AS DOUBLE) AS other FROM part WHERE p_size % 3 <> 0), j AS (SELECT f.method, f.f1, o.other FROM f LEFT JOIN o USING (accession)) SELECT method, count(*) AS n, count(other) AS n_common, round(avg(f1), 6) AS f1_all, round(avg(f1) FILTER (WHERE other IS NOT NULL), 6) AS f1_common, round(avg(other), 6) AS other_common FROM j GROUP BY method")
def q_report_competitor(spark, d):
    """The methods beside another source's figures, which it has for some sequences only: over all, and over those that both have."""
    other = read(spark, d, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").alias("accession"), F.col("p_size").cast("double").alias("other"))
    rows = _rates(spark, d).join(other, "accession", "left")
    both = F.col("other").isNotNull()
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count("other").alias("n_common"), r6(F.avg("f1"), "f1_all"), r6(F.avg(F.when(both, F.col("f1"))), "f1_common"), r6(F.avg("other"), "other_common"))


@query("q_audit", f"WITH {_MC}, p AS (SELECT a.method, round(a.f1 - b.f1, 9) AS d FROM f a JOIN f b USING (accession) WHERE b.method = 0) SELECT method, round(avg(d), 6) AS mean_diff, round(avg(d), 2) = 0 AND count(*) FILTER (WHERE d <> 0) = 0 AS suspect FROM p GROUP BY method")
def q_audit(spark, d):
    """All methods against method 0, itself among them: the comparison with itself is told by its difference and p-value."""
    f1 = cut(_rates(spark, d).select("accession", "method", "f1"))
    base = f1.where("method = 0").select("accession", F.col("f1").alias("base"))
    diffs = f1.join(base, "accession").select("method", F.round(F.col("f1") - F.col("base"), 9).alias("d"))
    tests = diffs.groupBy("method").agg(F.avg("d").alias("mean_diff"), F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down"))
    tests = tests.withColumn("p", F.coalesce(evaluate.binomial_two_sided(F.least("up", "down"), F.col("up") + F.col("down")), F.when(F.col("up") + F.col("down") == 0, 1.0)))
    return evaluate.self_comparisons(tests).select("method", r6(F.col("mean_diff"), "mean_diff"), F.when(F.col("up") + F.col("down") == 0, F.col("suspect")).otherwise(False).alias("suspect"))


@query("q_sweep")
def q_sweep(spark, d):
    """Inserts of two lengths from the other labels in two labels' series, through the whole predictor: what of them is found, and how well."""
    t = tiles(spark, d)
    label = t.select("accession").distinct()
    grid = synthetic.conditions(label.where("accession < 2"), label.where("accession in (2, 3)"), [4, 8], [0])
    name = F.concat_ws("|", "host", "donor", "insert_len", "seed").alias("accession")
    parts = [synthetic.chimeras(t, grid.where(F.col("insert_len") == need).select(name, "host", "donor"), TILE, need, 2, 4 * TILE, 12 * TILE) for need in (4, 8)]
    made, put, lengths = (cut(a.unionByName(b)) for a, b in zip(*parts, strict=True))
    calls = predict.by_vectors(made, lengths, TILE, 4 * TILE, TILE, 4, 5, TILE, 2 * TILE, refine=(40, 60), stride=1)
    found = cut(intervals.best_overlap(put, calls).join(grid.select(name, "insert_len"), "accession"))
    rate = found.groupBy("insert_len").agg(F.count("*").alias("n"), r6(100 * F.avg(F.col("matched").cast("int")), "detection_rate"))
    return rate.join(evaluate.boundary_summary(found, ["insert_len"], (TILE,)), "insert_len").select("insert_len", "n", "detection_rate", "n_matched", "mabe", r6(F.col("median_jaccard"), "median_jaccard"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(O)
