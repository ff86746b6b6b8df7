"""Uncertainty and agreement over the CELLS, AUDIT and RECORDS frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from colprov.operators import score as G
from colprov.operators import stats as H
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.plans.score_queries import CNT, DEC_SQL, scored, shown
from colprov.plans.screen_queries import rounded

BINOM = """CASE WHEN b + c = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(0, b + c + 1), lambda k:
  CASE WHEN exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))
    <= exp(lgamma(b + c + 1) - lgamma(least(b, c) + 1) - lgamma(b + c - least(b, c) + 1) - (b + c) * ln(2)) * (1 + 1e-9) + 1e-12
  THEN exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) ELSE 0 END))) END"""


@query(
    "h1_mcnemar",
    f"""WITH {DEC_SQL}, w AS (SELECT model, ds, seed, col, is_pos, bool_or(flagged AND cond = 1) AS fa, bool_or(flagged AND cond = 6) AS fb FROM mat GROUP BY ALL),
   d AS (SELECT model, count(*) FILTER (WHERE fa = is_pos AND fb <> is_pos) AS b, count(*) FILTER (WHERE fb = is_pos AND fa <> is_pos) AS c FROM w GROUP BY model)
   SELECT model, b, c, round({BINOM}, 6)::DOUBLE AS p FROM d""",
)
def h1(t: Tables):
    v = shown(t)
    cells = G.match_cells(scored(t, v), [1, 6])
    return rounded(H.mcnemar_conditions(v, fr.cell_truth(t), cells, 1, 6), "p")


@query(
    "h1_mcnemar_of_row_predictions",
    f"""WITH r AS (SELECT l_linenumber, (l_quantity > 25) = (l_returnflag = 'R') AS a, (l_tax > 0.06) = (l_returnflag = 'R') AS bb FROM lineitem),
   d AS (SELECT l_linenumber, count(*) FILTER (WHERE a AND NOT bb) AS b, count(*) FILTER (WHERE bb AND NOT a) AS c FROM r GROUP BY l_linenumber)
   SELECT l_linenumber, b, c, round({BINOM}, 6)::DOUBLE AS p FROM d""",
)
def h1b(t: Tables):
    y = F.col("l_returnflag") == "R"
    right = t.lineitem.select("l_linenumber", ((F.col("l_quantity") > 25) == y).alias("ra"), ((F.col("l_tax") > 0.06) == y).alias("rb"))
    return rounded(H.mcnemar(right, "ra", "rb", ["l_linenumber"]), "p")


DRAWS = 2000


@query(
    "h2_cluster_bootstrap",
    f"""WITH {DEC_SQL}, per AS (SELECT model, ds, count(*) FILTER (WHERE cond = 1 AND is_pos AND flagged) AS tp1, count(*) FILTER (WHERE cond = 1 AND NOT is_pos AND flagged) AS fp1,
     count(*) FILTER (WHERE cond = 1 AND is_pos AND NOT flagged) AS fn1, count(*) FILTER (WHERE cond = 6 AND is_pos AND flagged) AS tp6,
     count(*) FILTER (WHERE cond = 6 AND NOT is_pos AND flagged) AS fp6, count(*) FILTER (WHERE cond = 6 AND is_pos AND NOT flagged) AS fn6 FROM mat GROUP BY ALL),
  ix AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ds) - 1 AS slot, count(*) OVER (PARTITION BY model) AS n FROM per),
  dr AS (SELECT model, n, d AS draw, ('0x' || substr(md5(d || '|' || slot), 1, 8))::BIGINT % n AS pick FROM ix, range({DRAWS}) r(d)),
  s AS (SELECT dr.model, dr.n, draw, sum(tp1) AS tp1, sum(fp1) AS fp1, sum(fn1) AS fn1, sum(tp6) AS tp6, sum(fp6) AS fp6, sum(fn6) AS fn6
        FROM dr JOIN ix ON ix.model = dr.model AND ix.slot = dr.pick GROUP BY ALL),
  f AS (SELECT model, n, CASE WHEN tp6 > 0 THEN 2 * tp6 / (2 * tp6 + fp6 + fn6) ELSE 0 END - CASE WHEN tp1 > 0 THEN 2 * tp1 / (2 * tp1 + fp1 + fn1) ELSE 0 END AS d
        FROM s WHERE tp1 + fn1 > 0 AND tp6 + fn6 > 0 AND n > 1),
  g AS (SELECT model, n, list_sort(list(d)) AS l FROM f GROUP BY ALL)
  SELECT model, round(l[floor(0.025 * len(l))::INT + 1], 6)::DOUBLE AS lo, round(l[least(len(l), floor(0.975 * len(l))::INT + 1)], 6)::DOUBLE AS hi, n AS n_ds, len(l)::BIGINT AS n_draws FROM g""",
)
def h2(t: Tables):
    b = H.cluster_bootstrap(G.match_cells(scored(t), [1, 6]), 1, 6, DRAWS, H.digest_pick)
    return rounded(b, "lo", "hi")


PRED_SQL = """pr AS (SELECT l_linenumber, l_returnflag AS y,
   CASE WHEN l_quantity < 20 THEN l_returnflag WHEN l_tax < 0.03 THEN 'A' WHEN l_tax < 0.06 THEN 'N' ELSE 'R' END AS clean,
   CASE WHEN l_returnflag = 'R' THEN 'R' WHEN l_quantity < 22 THEN l_returnflag WHEN l_discount < 0.05 THEN 'A' ELSE 'N' END AS leak FROM lineitem)"""


def predictions(t: Tables):
    y, q, tax = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_tax")
    clean = F.when(q < 20, y).when(tax < 0.03, "A").when(tax < 0.06, "N").otherwise("R")
    leak = F.when(y == "R", "R").when(q < 22, y).when(F.col("l_discount") < 0.05, "A").otherwise("N")
    return t.lineitem.select("l_linenumber", y.alias("y"), clean.alias("clean"), leak.alias("leak"))


def rates_sql(c):
    return f"""SELECT l_linenumber, count(*) FILTER (WHERE y <> 'R' AND {c} = 'R') AS escaped, count(*) FILTER (WHERE y <> 'R' AND {c} <> 'R') AS kept,
     count(*) FILTER (WHERE y <> 'R' AND {c} <> 'R' AND {c} <> y) AS wrong,
     count(*) FILTER (WHERE y <> 'R' AND {c} <> 'R' AND {c} <> y) / greatest(count(*) FILTER (WHERE y <> 'R' AND {c} <> 'R'), 1) AS rate FROM pr GROUP BY l_linenumber"""


@query(
    "h3_paired_delta",
    f"""WITH {PRED_SQL}, c AS ({rates_sql('clean')}), k AS ({rates_sql('leak')}), d AS (SELECT 100 * (k.rate - c.rate) AS d FROM c JOIN k USING (l_linenumber)),
   s AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d), th AS (SELECT *, atan(abs(mean / (sd / sqrt(n))) / sqrt(n - 1)) AS th FROM s),
   p AS (SELECT *, 1 - sin(th) * (1 + cos(th)**2 / 2 + 3 * cos(th)**4 / 8) AS p FROM th)
   SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.96 * sd / sqrt(n), 6)::DOUBLE AS lo, round(mean + 1.96 * sd / sqrt(n), 6)::DOUBLE AS hi,
   round(p, 6)::DOUBLE AS p, CASE WHEN p >= .05 THEN 'no change' WHEN mean > 0 THEN 'degrades' ELSE 'improves' END AS verdict FROM p""",
)
def h3(t: Tables):
    """Seven partitions (line numbers), so six degrees of freedom."""
    p = predictions(t)
    by = ["l_linenumber"]
    c = H.pair_rates(p, "y", "clean", "R", ("A", "N"), by).select("l_linenumber", F.col("rate").alias("rc"))
    k = H.pair_rates(p, "y", "leak", "R", ("A", "N"), by).select("l_linenumber", F.col("rate").alias("rl"))
    return rounded(H.paired_delta(c.join(k, by), "rc", "rl"), "mean", "sd", "lo", "hi", "p")


COMMON_SQL = """cm AS (SELECT l_linenumber, count(*) FILTER (WHERE ok) AS common, count(*) FILTER (WHERE ok AND clean <> y) AS wrong_clean, count(*) FILTER (WHERE ok AND leak <> y) AS wrong_leak,
   count(*) FILTER (WHERE ok AND clean = y AND leak <> y) AS broke, count(*) FILTER (WHERE ok AND clean <> y AND leak = y) AS fixed
   FROM (SELECT *, y <> 'R' AND clean <> 'R' AND leak <> 'R' AS ok FROM pr) GROUP BY l_linenumber)"""


@query(
    "h4_object_level_delta",
    f"""WITH {PRED_SQL}, {COMMON_SQL}, x AS (SELECT *, broke AS b, fixed AS c, (broke - fixed) / common AS d, sqrt(broke + fixed) / common AS se FROM cm), pp AS (SELECT *, {BINOM} AS p FROM x)
   SELECT round(median(d), 6) AS delta, round(median(d - 1.96 * se), 6) AS lo, round(median(d + 1.96 * se), 6) AS hi, round(median(p), 6) AS p_median,
   count(*) FILTER (WHERE p < .05) AS n_significant, count(*) AS n_partitions FROM pp""",
)
def h4(t: Tables):
    c = H.pair_common(predictions(t), "y", "clean", "leak", "R", ("A", "N"), ["l_linenumber"])
    return rounded(H.object_level(c), "delta", "lo", "hi", "p_median")


@query("h5_matched_pair_rates", f"WITH {PRED_SQL}, c AS ({rates_sql('clean')}) SELECT * REPLACE (round(rate, 6)::DOUBLE AS rate) FROM c")
def h5(t: Tables):
    return rounded(H.pair_rates(predictions(t), "y", "clean", "R", ("A", "N"), ["l_linenumber"]), "rate")


@query("h6_composition_matched_pair", f"WITH {PRED_SQL}, {COMMON_SQL} SELECT * FROM cm")
def h6(t: Tables):
    return H.pair_common(predictions(t), "y", "clean", "leak", "R", ("A", "N"), ["l_linenumber"])


CODERS_SQL = """code AS (SELECT doc_id, c AS coder, CASE WHEN (doc_id + c * 7) % 4 = 0 THEN 'REASON' WHEN (doc_id * (c + 1)) % 5 < 2 THEN 'CONSEQUENCE' ELSE 'TIMING' END AS category,
   (doc_id * 3 + c) % 10 > 0 AS licensed, quality = 1 AS has_quote, toxic = 0 AS strong FROM labels, (VALUES (0), (1), (2)) v(c))"""


def coders(t: Tables):
    d, c = F.col("doc_id"), F.col("coder")
    rows = t.labels.withColumn("coder", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    cat = F.when((d + c * 7) % 4 == 0, "REASON").when((d * (c + 1)) % 5 < 2, "CONSEQUENCE").otherwise("TIMING")
    return rows.select("doc_id", "coder", cat.alias("category"), ((d * 3 + c) % 10 > 0).alias("licensed"), (F.col("quality") == 1).alias("has_quote"), (F.col("toxic") == 0).alias("strong"))


@query(
    "h7_cohen_kappa",
    f"""WITH {CODERS_SQL}, w AS (SELECT doc_id, max(category) FILTER (WHERE coder = 0) AS a, max(category) FILTER (WHERE coder = 1) AS b FROM code GROUP BY doc_id),
   po AS (SELECT count(*) AS n, avg((a = b)::INT) AS raw FROM w), pe AS (SELECT sum(x.k * y.k)::DOUBLE AS s FROM (SELECT a AS c, count(*) AS k FROM w GROUP BY a) x JOIN (SELECT b AS c, count(*) AS k FROM w GROUP BY b) y USING (c))
   SELECT n, round(raw, 6)::DOUBLE AS raw, round((raw - s / n / n) / (1 - s / n / n), 6)::DOUBLE AS kappa FROM po, pe""",
)
def h7(t: Tables):
    c = coders(t)
    w = c.groupBy("doc_id").agg(F.max(F.when(F.col("coder") == 0, F.col("category"))).alias("a"), F.max(F.when(F.col("coder") == 1, F.col("category"))).alias("b"))
    cells = w.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return rounded(H.cohen(cells, "a", "b", "n", []), "raw", "kappa")


@query(
    "h8_fleiss_kappa",
    f"""WITH {CODERS_SQL}, v AS (SELECT doc_id, category, count(*) AS v FROM code GROUP BY ALL), i AS (SELECT doc_id, (sum(v * v) - 3) / 6.0 AS p, max(v) = 3 AS u FROM v GROUP BY doc_id),
   pj AS (SELECT sum(pow(s / (3.0 * (SELECT count(*) FROM i)), 2)) AS pe FROM (SELECT sum(v) AS s FROM v GROUP BY category))
   SELECT count(*) AS n_items, round(avg(u::INT), 6)::DOUBLE AS unanimous, round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 6)::DOUBLE AS kappa FROM i, pj""",
)
def h8(t: Tables):
    return rounded(H.fleiss(coders(t), ["doc_id"], "category", 3), "unanimous", "kappa")


@query(
    "h9_coder_pairs_on_subsets",
    f"""WITH {CODERS_SQL}, s AS (SELECT 'all' AS subset, * FROM code UNION ALL SELECT 'has quote', * FROM code WHERE has_quote UNION ALL SELECT 'strong tier', * FROM code WHERE strong),
   w AS (SELECT x.subset, x.doc_id, x.coder AS a, y.coder AS b, x.category AS ka, y.category AS kb FROM s x JOIN s y ON x.subset = y.subset AND x.doc_id = y.doc_id AND x.coder < y.coder),
   po AS (SELECT subset, a, b, count(*) AS n, avg((ka = kb)::INT) AS raw FROM w GROUP BY ALL),
   l AS (SELECT subset, a, b, ka AS k, count(*) AS c FROM w GROUP BY ALL), r AS (SELECT subset, a, b, kb AS k, count(*) AS c FROM w GROUP BY ALL),
   pe AS (SELECT subset, a, b, sum(l.c * r.c)::DOUBLE AS s FROM l JOIN r USING (subset, a, b, k) GROUP BY ALL),
   kk AS (SELECT subset, a, b, n, raw, (raw - s / n / n) / (1 - s / n / n) AS kappa FROM po JOIN pe USING (subset, a, b))
   SELECT subset, a, b, n, round(raw, 6)::DOUBLE AS raw, round(kappa, 6)::DOUBLE AS kappa, CASE WHEN kappa <= 0 THEN 'poor' WHEN kappa <= .2 THEN 'slight' WHEN kappa <= .4 THEN 'fair'
     WHEN kappa <= .6 THEN 'moderate' WHEN kappa <= .8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM kk""",
)
def h9(t: Tables):
    subsets = {"all": F.lit(True), "has quote": F.col("has_quote"), "strong tier": F.col("strong")}
    return rounded(H.coder_pairs(coders(t), ["doc_id"], "coder", "category", subsets), "raw", "kappa")


@query(
    "h9_agreement_per_category",
    f"""WITH {CODERS_SQL}, r AS (SELECT doc_id, category AS ref FROM code WHERE coder = 0) SELECT ref, coder, count(*) FILTER (WHERE category = ref) AS hit, count(*) AS n,
   round(avg((category = ref)::INT), 6)::DOUBLE AS agreement FROM code JOIN r USING (doc_id) WHERE coder > 0 GROUP BY ALL""",
)
def h9b(t: Tables):
    c = coders(t)
    return rounded(H.category_agreement(c.where("coder > 0"), c.where("coder = 0"), ["doc_id"], "coder", "category"), "agreement")


@query(
    "h9_disputes",
    f"""WITH {CODERS_SQL}, r AS (SELECT doc_id, category AS ref FROM code WHERE coder = 0) SELECT doc_id, coder, category, ref,
   CASE WHEN NOT licensed THEN 'licence' ELSE 'category' END AS dispute FROM code JOIN r USING (doc_id) WHERE coder > 0 AND (category <> ref OR NOT licensed)""",
)
def h9c(t: Tables):
    c = coders(t)
    return H.disputes(c.where("coder > 0"), c.where("coder = 0"), ["doc_id"], "category").select("doc_id", "coder", "category", "ref", "dispute")


@query(
    "h10_source_agreement",
    f"""WITH {fr.EVIDENCE_SQL}, u AS (SELECT dataset_id, count(DISTINCT "column")::DOUBLE AS n FROM evidence GROUP BY 1),
   s AS (SELECT dataset_id, source_citation, max(scope) AS scope FROM evidence GROUP BY ALL),
   c AS (SELECT DISTINCT dataset_id, source_citation, "column" AS col FROM evidence WHERE label = 'LABEL_DERIVED'),
   z AS (SELECT dataset_id, source_citation, list_sort(list(col)) AS cols, scope FROM c JOIN s USING (dataset_id, source_citation) GROUP BY dataset_id, source_citation, scope),
   p AS (SELECT x.dataset_id, x.source_citation AS a, y.source_citation AS b, x.scope = y.scope AS same, n, len(x.cols) AS na, len(y.cols) AS nb, len(list_intersect(x.cols, y.cols)) AS i,
     array_to_string(list_sort(list_filter(x.cols, lambda q: NOT list_contains(y.cols, q))), ',') AS oa, array_to_string(list_sort(list_filter(y.cols, lambda q: NOT list_contains(x.cols, q))), ',') AS ob
     FROM z x JOIN z y ON x.dataset_id = y.dataset_id AND x.source_citation < y.source_citation JOIN u ON u.dataset_id = x.dataset_id),
   k AS (SELECT *, (i + n - (na + nb - i)) / n AS po, (na / n) * (nb / n) + ((n - na) / n) * ((n - nb) / n) AS pe FROM p)
   SELECT dataset_id, a, b, CASE WHEN same THEN round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) END::DOUBLE AS kappa, CASE WHEN same THEN round(i / (na + nb - i), 6) END::DOUBLE AS jaccard,
   CASE WHEN same THEN oa END AS only_a, CASE WHEN same THEN ob END AS only_b, CASE WHEN NOT same THEN 'scope mismatch -- silence is not comparable' END AS skipped FROM k""",
)
def h10(t: Tables):
    return rounded(H.source_agreement(fr.evidence(t)), "kappa", "jaccard")


TALLIES_SQL = f"""{DEC_SQL}, tl AS (SELECT model, ds, col, subtype, count(*) FILTER (WHERE flagged) AS h, count(*) AS n FROM mat WHERE cond = 1 AND is_pos AND subtype IN ('REASON', 'CONSEQUENCE') GROUP BY ALL)"""


def tallies(t: Tables):
    v = shown(t)
    cells = G.match_cells(scored(t, v), [1, 6])
    return H.recall_tallies(v, fr.cell_truth(t), cells, 1)


RELABEL_SHARES = [0.05, 0.1, 0.2, 0.3, 0.5]


@query(
    "h11_random_relabelling",
    f"""WITH {TALLIES_SQL}, it AS (SELECT ds, col, row_number() OVER (ORDER BY ds, col) - 1 AS slot, count(*) OVER () AS m FROM (SELECT DISTINCT ds, col FROM tl)),
   sh AS (SELECT unnest({RELABEL_SHARES}::DOUBLE[]) AS share),
   rk AS (SELECT d AS draw, ds, col, m, row_number() OVER (PARTITION BY d ORDER BY ('0x' || substr(md5(d || '|' || slot), 1, 8))::BIGINT, slot) AS rn FROM it, range({DRAWS}) r(d)),
   x AS (SELECT share, draw, model, h, n, CASE WHEN (rn <= greatest(1, round(share * m))) <> (subtype = 'REASON') THEN 'R' ELSE 'C' END AS lab FROM tl JOIN rk USING (ds, col), sh),
   g AS (SELECT share, draw, model, sum(h) FILTER (WHERE lab = 'C') / sum(n) FILTER (WHERE lab = 'C') AS c, sum(h) FILTER (WHERE lab = 'R') / sum(n) FILTER (WHERE lab = 'R') AS r FROM x GROUP BY share, draw, model),
   q AS (SELECT share, draw, avg(c) - avg(r) AS gap FROM g GROUP BY share, draw), l AS (SELECT share, avg(gap) AS m, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM q GROUP BY share)
   SELECT share, round(m, 6)::DOUBLE AS mean_gap, round(g[floor(0.025 * len(g))::INT + 1], 6)::DOUBLE AS lo, round(g[least(len(g), floor(0.975 * len(g))::INT + 1)], 6)::DOUBLE AS hi FROM l""",
)
def h11(t: Tables):
    return rounded(H.random_relabel(tallies(t), RELABEL_SHARES, DRAWS, H.digest_order), "mean_gap", "lo", "hi")


@query("h12_greedy_adversary")
def h12(t: Tables):
    """Three worst flips; rows only, the rounds depend on each other."""
    return rounded(H.greedy_relabel(tallies(t), 3), "gap")


@query("h12_greedy_adversary_restricted")
def h12b(t: Tables):
    weak = t.part.where("p_size % 2 = 0").select(F.col("p_brand").alias("ds"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"))
    return rounded(H.greedy_relabel(tallies(t), 3, weak), "gap")


@query(
    "h14_partition_summary",
    f"""WITH {PRED_SQL}, cl AS (SELECT unnest(['A', 'N', 'R']) AS y), pt AS (SELECT DISTINCT l_linenumber FROM pr),
   f AS (SELECT l_linenumber, cl.y, 2 * count(*) FILTER (WHERE pr.y = cl.y AND clean = cl.y) / (count(*) FILTER (WHERE pr.y = cl.y) + count(*) FILTER (WHERE clean = cl.y)) AS v FROM pr, cl GROUP BY ALL),
   z AS (SELECT * FROM f UNION ALL SELECT l_linenumber, 'MACRO', avg(v) FROM f GROUP BY 1 UNION ALL SELECT l_linenumber, 'ACCURACY', avg((y = clean)::INT) FROM pr GROUP BY 1)
   SELECT y, round(avg(v), 6)::DOUBLE AS mean, round(stddev_samp(v), 6)::DOUBLE AS sd, count(*) AS n_partitions FROM z GROUP BY y""",
)
def h14(t: Tables):
    return rounded(H.partition_summary(predictions(t), "l_linenumber", "y", "clean"), "mean", "sd")
