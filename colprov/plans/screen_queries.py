"""Statistical screens over the AUDIT frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from colprov.functions.ranks import exact_quantiles
from colprov.operators import screens as S
from colprov.operators import typed
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.session import cut

# ---------------------------------------------------------------- oracle text

MEDIAN_SQL = """med AS (SELECT ds, col, median(v) AS m FROM long GROUP BY ds, col),
f AS (SELECT l.ds, l.col, l.y, coalesce(l.v, m.m) AS v, l.v IS NULL AS isnull FROM long l JOIN med m USING (ds, col))"""

AUC_SQL = """ranked AS (
  SELECT ds, col, y, rank() OVER (PARTITION BY ds, col ORDER BY v)
         + (count(*) OVER (PARTITION BY ds, col, v) - 1) / 2.0 AS rk FROM f),
sizes AS (SELECT ds, col, count(*)::DOUBLE AS n FROM f GROUP BY ds, col),
byclass AS (SELECT ds, col, y, count(*)::DOUBLE AS np, sum(rk)::DOUBLE AS rs FROM ranked GROUP BY ds, col, y),
aucs AS (SELECT ds, col, y, (rs - np * (np + 1) / 2) / (np * (n - np)) AS a FROM byclass JOIN sizes USING (ds, col)),
live AS (SELECT ds, col, min(v) < max(v) AS live, count(v) AS nv FROM long GROUP BY ds, col),
auc AS (SELECT ds, col, CASE WHEN live THEN max(abs(a - .5) + .5) ELSE 0 END AS auc
        FROM aucs JOIN live USING (ds, col) GROUP BY ds, col, live)"""

# correlation with each class indicator written out, 0 where a side is constant
COR_SQL = """tot AS (SELECT ds, col, count(*)::DOUBLE AS n, avg(v) AS mu, var_pop(v) AS vp, min(v) AS lo, max(v) AS hi
        FROM f GROUP BY ds, col),
cls AS (SELECT ds, col, y, count(*)::DOUBLE AS nc, avg(v) AS mc FROM f GROUP BY ds, col, y),
assoc AS (SELECT ds, col, y,
   CASE WHEN lo < hi THEN nc * abs(mc - mu) / (n - 1) ELSE 0 END AS cov,
   CASE WHEN lo < hi AND nc < n THEN nc * abs(mc - mu) / sqrt(n * vp * nc * (1 - nc / n)) ELSE 0 END AS cor
   FROM cls JOIN tot USING (ds, col)),
cor AS (SELECT ds, col, max(cor) AS cor FROM assoc GROUP BY ds, col)"""

MISS_SQL = """mrate AS (SELECT ds, col, y, avg((v IS NULL)::INT) AS r, count(v) AS nv, count(*) AS n FROM long GROUP BY ds, col, y),
miss AS (SELECT ds, col, CASE WHEN sum(nv) > 0 AND sum(nv) < sum(n) THEN max(r) - min(r) ELSE 0 END AS miss
         FROM mrate GROUP BY ds, col)"""

MARKER_RE = (
    r"(?i)\bpost[- ]?charge|\bpost[- ]|\bafter\b|\bfollowing\b|\bsubsequent|\bfollow[- ]?up\b|\bcause of death\b"
    r"|\bat discharge\b|\bdischarge\b|\boutcome\b|\brecover|\bcollection|\bsettle|\bfinal\b|\bresulted\b|\bclosed\b"
    r"|\bterminated\b|\bwrite[- ]?off|\bcharged[- ]?off|\bdefault(ed)?\b|\bdeceased\b|\bexpired\b|\bsurviv"
    r"|\blast payment\b|\bto date\b|\bso far\b|\bever\b"
)

FEATURES_SQL = f"""WITH {fr.LONG_SQL},
{MEDIAN_SQL},
{AUC_SQL},
{COR_SQL},
{MISS_SQL},
{fr.TRUTH_SQL},
features AS (
  SELECT ds, col, round(auc, 6) AS auc, round(cor, 6) AS cor, round(miss, 6) AS miss,
         regexp_matches(replace(col, '_', ' '), '{MARKER_RE}') AS regex, is_pos, subtype
  FROM auc JOIN cor USING (ds, col) JOIN miss USING (ds, col) JOIN truth USING (ds, col))"""


def AUDIT(t: Tables):
    return fr.audit_ds(t), fr.FEATURES, "y", ["ds"]


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def features(t: Tables):
    f = typed.column_features(*AUDIT(t), truth=fr.truth(t))
    return rounded(f, "auc", "cor", "miss")


@query("c1_column_features", FEATURES_SQL + " SELECT * FROM features")
def c1(t: Tables):
    """Every screen of every column, with truth: the flagship table."""
    return features(t)


MIXED = ["o_totalprice", "c_name", "c_mktsegment", "tax_rate", "size_code", "is_large", "balance", "recorded_after_closing"]

#: Orders with columns of every kind: text, text that is a number, numbers with NaN, booleans.
MIXED_SQL = """src AS (SELECT o_orderpriority AS ds, o_orderstatus AS y, o_orderkey, o_totalprice, c_name, c_mktsegment,
    CASE WHEN o_custkey % 9 > 0 THEN (o_custkey % 30) || '%' END AS tax_rate, CASE WHEN o_custkey % 2 = 0 THEN 'S' || o_custkey % 7 WHEN o_custkey % 5 > 0 THEN '12' END AS size_code,
    o_totalprice > 100000 AS is_large, CASE WHEN o_custkey % 7 = 0 OR o_orderstatus = 'P' THEN NULL ELSE c_acctbal END AS balance, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS recorded_after_closing
    FROM orders JOIN customer ON o_custkey = c_custkey),
 cell AS (SELECT ds, y, 'o_totalprice' AS col, o_totalprice AS num, NULL AS txt, FALSE AS written FROM src UNION ALL SELECT ds, y, 'is_large', is_large::INT, NULL, FALSE FROM src
   UNION ALL SELECT ds, y, 'balance', balance, NULL, FALSE FROM src UNION ALL SELECT ds, y, 'c_name', NULL, c_name, TRUE FROM src UNION ALL SELECT ds, y, 'c_mktsegment', NULL, c_mktsegment, TRUE FROM src
   UNION ALL SELECT ds, y, 'tax_rate', TRY_CAST(replace(tax_rate, '%', '') AS DOUBLE), tax_rate, TRUE FROM src UNION ALL SELECT ds, y, 'size_code', TRY_CAST(size_code AS DOUBLE), size_code, TRUE FROM src
   UNION ALL SELECT ds, y, 'recorded_after_closing', NULL, recorded_after_closing, TRUE FROM src),
 kind AS (SELECT ds, col, bool_or(written) AND avg((num IS NOT NULL)::INT) <= .8 AS coded FROM cell GROUP BY ALL),
 code AS (SELECT ds, col, txt, row_number() OVER (PARTITION BY ds, col ORDER BY txt) - 1 AS c FROM (SELECT DISTINCT ds, col, txt FROM cell JOIN kind USING (ds, col) WHERE coded AND txt IS NOT NULL)),
 long AS (SELECT ds, col, y, CASE WHEN coded THEN coalesce(c, -1) ELSE num END::DOUBLE AS v, CASE WHEN written THEN txt IS NULL ELSE num IS NULL END AS gone
   FROM cell JOIN kind USING (ds, col) LEFT JOIN code USING (ds, col, txt))"""

MIXED_MISS_SQL = """mrate AS (SELECT ds, col, y, avg(gone::INT) AS r, count(*) FILTER (WHERE NOT gone) AS nv, count(*) AS n FROM long GROUP BY ds, col, y),
miss AS (SELECT ds, col, CASE WHEN sum(nv) > 0 AND sum(nv) < sum(n) THEN max(r) - min(r) ELSE 0 END AS miss FROM mrate GROUP BY ds, col)"""


def mixed(t: Tables):
    k = F.col("o_custkey")
    j = t.orders.join(t.customer, k == F.col("c_custkey"))
    balance = F.when((k % 7 == 0) | (F.col("o_orderstatus") == "P"), F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    size = F.when(k % 2 == 0, F.concat(F.lit("S"), (k % 7).cast("string"))).when(k % 5 > 0, F.lit("12"))
    return j.select(
        F.col("o_orderpriority").alias("ds"), F.col("o_orderstatus").alias("y"), "o_totalprice", "c_name", "c_mktsegment",
        F.when(k % 9 > 0, F.concat((k % 30).cast("string"), F.lit("%"))).alias("tax_rate"), size.alias("size_code"),
        (F.col("o_totalprice") > 100000).alias("is_large"), balance.alias("balance"), F.when(F.col("o_orderstatus") == "F", "yes").alias("recorded_after_closing"),
    )


@query(
    "c1_features_of_any_type",
    f"""WITH {MIXED_SQL},
{MEDIAN_SQL},
{AUC_SQL},
{COR_SQL},
{MIXED_MISS_SQL}
  SELECT ds, col, round(auc, 6) AS auc, round(cor, 6) AS cor, round(miss, 6) AS miss, regexp_matches(replace(col, '_', ' '), '{MARKER_RE}') AS regex
  FROM auc JOIN cor USING (ds, col) JOIN miss USING (ds, col)""",
)
def c1b(t: Tables):
    """Every screen over text, numbers written as text, booleans and numbers with NaN."""
    return rounded(typed.column_features(mixed(t), MIXED, "y", ["ds"], share=0.8), "auc", "cor", "miss")


@query(
    "c2_one_vs_rest_auc",
    f"WITH {fr.LONG_SQL},\n{MEDIAN_SQL},\n{AUC_SQL} SELECT ds, col, round(auc, 6) AS auc FROM auc",
)
def c2(t: Tables):
    return rounded(S.auc_screen(*AUDIT(t)), "auc")


@query(
    "c3_class_correlation",
    f"WITH {fr.LONG_SQL},\n{MEDIAN_SQL},\n{COR_SQL} SELECT ds, col, y, round(cor, 6) AS cor FROM assoc",
)
def c3(t: Tables):
    a = S.association(*AUDIT(t))
    return rounded(a.select("ds", "col", "y", "cor"), "cor")


LABELLED_LONG_SQL = """j AS (SELECT d.source AS ds, d.lang AS y, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic,
                  d.n_chars::DOUBLE AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
long AS (SELECT ds, 'quality' AS col, quality AS v, y FROM j UNION ALL SELECT ds, 'toxic', toxic, y FROM j
         UNION ALL SELECT ds, 'n_chars', n_chars, y FROM j)"""


def LABELLED(t: Tables):
    j = t.documents.join(t.labels, "doc_id", "left").withColumn("ds", F.col("source"))
    return j, ["quality", "toxic", "n_chars"], "lang", ["ds"]


@query(
    "c4_missingness_asymmetry",
    f"WITH {LABELLED_LONG_SQL},\n{MISS_SQL} SELECT ds, col, round(miss, 6) AS miss FROM miss",
)
def c4(t: Tables):
    return rounded(S.missing_asymmetry(S.class_moments(*LABELLED(t))), "miss")


C5_SQL = f"""WITH {LABELLED_LONG_SQL}, {MEDIAN_SQL}, {AUC_SQL},
  mr AS (SELECT ds, col, y, count(*)::DOUBLE AS n, count(*) - count(v) AS k FROM long GROUP BY ds, col, y),
  mt AS (SELECT ds, col, sum(n) AS tn, sum(k) AS tk FROM mr GROUP BY ds, col),
  am AS (SELECT ds, col, 0.5 + max(CASE WHEN tn > n THEN abs(k / n - (tk - k) / (tn - n)) ELSE 0 END) / 2 AS a_miss
         FROM mr JOIN mt USING (ds, col) GROUP BY ds, col),
  av AS (SELECT ds, col, CASE WHEN nv >= 10 AND live THEN greatest(coalesce(max(abs(a - .5) + .5), .5), .5) ELSE .5 END AS a_val
         FROM live LEFT JOIN aucs USING (ds, col) GROUP BY ds, col, nv, live)
  SELECT ds, col, round(a_val, 6)::DOUBLE AS a_val, round(a_miss, 6)::DOUBLE AS a_miss, round(greatest(a_val, a_miss), 6)::DOUBLE AS score,
         CASE WHEN a_miss > a_val THEN 'missingness' ELSE 'values' END AS how
  FROM av JOIN am USING (ds, col)"""


@query("c5_values_or_missingness", C5_SQL)
def c5(t: Tables):
    return rounded(S.two_way_screen(*LABELLED(t)), "a_val", "a_miss", "score")


@query(
    "c6_screen_rank",
    FEATURES_SQL
    + """ SELECT ds, col, auc, is_pos, rank() OVER (PARTITION BY ds ORDER BY auc DESC) AS rank,
      is_pos AND rank() OVER (PARTITION BY ds ORDER BY auc DESC) <= 3 AS caught FROM features""",
)
def c6(t: Tables):
    a = rounded(S.auc_screen(*AUDIT(t)), "auc")
    return S.screen_rank(a, "auc", fr.truth(t)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "c7_name_markers",
    r"""SELECT 'events' AS ds, col, regexp_matches(col, '"""
    + MARKER_RE.replace(r"\b", r"(?:\b|_)")
    + r"""') AS frozen, regexp_matches(col, '"""
    + "|".join([MARKER_RE.replace(r"\b", r"(?:\b|_)")] + S.TUNED_EXTRA)
    + r"""') AS tuned, n FROM (
      SELECT event_type || '_' || CASE WHEN value >= 100 THEN 'outcome' WHEN value >= 50 THEN 'post_charge_amt'
             WHEN value >= 20 THEN 'days_to_close' WHEN value >= 10 THEN 'age' ELSE 'user_id' END AS col, count(*) AS n
      FROM events GROUP BY 1)""",
)
def c7(t: Tables):
    """Names made of the event types, so that their number follows the table."""
    v = F.col("value")
    tail = (
        F.when(v >= 100, "outcome").when(v >= 50, "post_charge_amt").when(v >= 20, "days_to_close")
        .when(v >= 10, "age").otherwise("user_id")
    )
    names = t.events.groupBy(F.concat_ws("_", "event_type", tail).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return S.name_screen(names).select(F.lit("events").alias("ds"), "col", "frozen", "tuned", "n")


SWEEP_SQL = """cand AS (SELECT DISTINCT round({s}, 4) AS threshold FROM scored),
swept AS (SELECT threshold, count(*) FILTER (WHERE is_pos AND {s} >= threshold) AS tp,
                 count(*) FILTER (WHERE NOT is_pos AND {s} >= threshold) AS fp,
                 count(*) FILTER (WHERE is_pos AND NOT {s} >= threshold) AS fn,
                 count(*) FILTER (WHERE NOT is_pos AND NOT {s} >= threshold) AS tn
          FROM cand, scored GROUP BY threshold),
g AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM swept),
g2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1,
              coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM g)
SELECT threshold, tp, fp, fn, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(f1, 6)::DOUBLE AS f1, round(mcc, 6)::DOUBLE AS mcc
FROM g2 ORDER BY round(f1, 12) DESC, threshold LIMIT 1"""


@query("c8_best_threshold", FEATURES_SQL + ", scored AS (SELECT cor, is_pos FROM features), " + SWEEP_SQL.format(s="cor"))
def c8(t: Tables):
    return rounded(S.best_threshold(features(t), "cor", "is_pos"), "p", "r", "f1", "mcc")


C9_SQL = (
    """WITH scored AS (SELECT (l_extendedprice + 500 * l_linenumber) / 100000.0 AS s, l_returnflag = 'R' AS is_pos FROM lineitem),
  cand AS (SELECT DISTINCT round(unnest(quantile_cont(s, ["""
    + ", ".join(str(k / 100) for k in range(1, 100))
    + """])), 4) AS threshold FROM scored),
  swept AS (SELECT threshold, count(*) FILTER (WHERE is_pos AND s >= threshold) AS tp,
                 count(*) FILTER (WHERE NOT is_pos AND s >= threshold) AS fp,
                 count(*) FILTER (WHERE is_pos AND NOT s >= threshold) AS fn FROM cand, scored GROUP BY threshold),
  g AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM swept),
  g2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM g)
  SELECT threshold, tp, fp, fn, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(f1, 6)::DOUBLE AS f1
  FROM g2 ORDER BY round(f1, 12) DESC, threshold LIMIT 1"""
)


@query("c9_quantile_threshold", C9_SQL)
def c9(t: Tables):
    s = t.lineitem.select(
        ((F.col("l_extendedprice") + 500 * F.col("l_linenumber")) / 100000.0).alias("score"),
        (F.col("l_returnflag") == "R").alias("is_pos"),
    )
    grid = exact_quantiles(s, [], "score", [k / 100 for k in range(1, 100)])
    return rounded(S.grid_threshold(s, "score", "is_pos", grid), "p", "r", "f1")


RANKS_SQL = f"""WITH {fr.LONG_SQL}, {MEDIAN_SQL}, {COR_SQL},
  rk AS (SELECT ds, col, y, count(*) OVER (PARTITION BY ds, y) AS nf,
         rank() OVER (PARTITION BY ds, y ORDER BY round(cov, 9) DESC) AS rcov,
         rank() OVER (PARTITION BY ds, y ORDER BY round(cor, 9) DESC) AS rcor FROM assoc),
  best AS (SELECT ds, col, max(nf) AS n_features, min(rcov) AS rank_cov, min(rcor) AS rank_cor FROM rk GROUP BY ds, col)
  SELECT *, round(1 - (rank_cov - 1) / n_features, 6)::DOUBLE AS s_cov, round(1 - (rank_cor - 1) / n_features, 6)::DOUBLE AS s_cor,
         rank_cor <= 3 AS golden FROM best"""


@query("c10_association_ranks", RANKS_SQL)
def c10(t: Tables):
    a = S.association(*AUDIT(t))
    return rounded(S.association_ranks(a), "s_cov", "s_cor")


GAP_SQL = (
    FEATURES_SQL
    + """, nun AS (SELECT ds, col, count(DISTINCT v) AS nun FROM f GROUP BY ds, col),
  gaps AS (SELECT ds, col, nun, nun <= 2 AS "binary", rank() OVER (PARTITION BY ds ORDER BY round(auc, 9) DESC) AS rank_auc,
           rank() OVER (PARTITION BY ds ORDER BY round(cor, 9) DESC) AS rank_cor FROM features JOIN nun USING (ds, col)),
  gap AS (SELECT *, rank_auc - rank_cor AS gap FROM gaps)"""
)


def gaps(t: Tables):
    moments = S.column_moments(*AUDIT(t))
    counts = cut(S.filled_counts(*AUDIT(t), moments))
    f = rounded(S.column_features(*AUDIT(t), moments=moments, counts=counts), "auc", "cor")
    return S.rank_gap(f, S.n_values(*AUDIT(t), moments, counts))


@query("c11_rank_gap", GAP_SQL + " SELECT * FROM gap")
def c11(t: Tables):
    g = gaps(t)
    return g.withColumns({c: F.col(c).cast("long") for c in ("rank_auc", "rank_cor", "gap")})


@query(
    "c11_mann_whitney_of_gaps",
    GAP_SQL
    + """, r AS (SELECT "binary" AS b, rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2.0 AS rk FROM gap),
  ties AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS t FROM gap GROUP BY gap)),
  s AS (SELECT count(*) FILTER (WHERE b) AS n1, count(*) FILTER (WHERE NOT b) AS n2, sum(rk) FILTER (WHERE b)::DOUBLE AS r1 FROM r),
  u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, ties FROM s, ties),
  z AS (SELECT *, (u - n1 * n2 / 2.0 - .5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM u),
  tt AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
  pp AS (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS tail FROM tt)
  SELECT n1, n2, u::DOUBLE AS u, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 6)::DOUBLE AS p FROM pp""",
)
def c11b(t: Tables):
    return rounded(S.mann_whitney(gaps(t), "gap", "binary"), "p")


ACT_SQL = """hn AS (SELECT ds, col, count(*) > count(v) AS has_null FROM long GROUP BY ds, col),
act AS (SELECT ds, col, y, count(*) AS n, count(*) FILTER (WHERE CASE WHEN has_null THEN v IS NOT NULL ELSE v <> 0 END) AS n_active
        FROM long JOIN hn USING (ds, col) GROUP BY ds, col, y)"""


@query(
    "c12_one_sidedness",
    f"""WITH {fr.LONG_SQL}, {ACT_SQL},
  tot AS (SELECT ds, col, sum(n_active)::BIGINT AS n_active FROM act GROUP BY ds, col),
  top AS (SELECT ds, col, y, n_active AS k, row_number() OVER (PARTITION BY ds, col ORDER BY n_active DESC, y DESC) AS rn FROM act)
  SELECT ds, col, n_active, CASE WHEN n_active > 0 THEN y END AS top_class, round(k / n_active, 6)::DOUBLE AS share,
         coalesce(k / n_active >= .7, FALSE) AS one_sided FROM tot JOIN top USING (ds, col) WHERE rn = 1""",
)
def c12(t: Tables):
    return rounded(S.one_sidedness(S.activation(S.class_moments(*AUDIT(t)))), "share")


@query(
    "c13_pair_silence",
    f"""WITH {fr.LONG_SQL}, {ACT_SQL}
  SELECT ds, col, round(max(CASE WHEN y = 'A' THEN n_active / n END), 6)::DOUBLE AS rate_a,
         round(max(CASE WHEN y = 'N' THEN n_active / n END), 6)::DOUBLE AS rate_b,
         max(n_active / n) < .1 AS silent FROM act WHERE y IN ('A', 'N') GROUP BY ds, col""",
)
def c13(t: Tables):
    return rounded(S.pair_silence(S.activation(S.class_moments(*AUDIT(t))), ("A", "N")), "rate_a", "rate_b")


C14_COLS = ["l_linenumber", "l_linestatus", "l_returnflag", "y2", "const_col", "o_orderpriority"]


@query(
    "c14_constant_and_duplicate",
    f"WITH {fr.AUDIT_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(DISTINCT {c}) <= 1 AS constant, "
        f"round(avg(coalesce({c}::VARCHAR = y, FALSE)::INT), 6)::DOUBLE AS same, "
        f"avg(coalesce({c}::VARCHAR = y, FALSE)::INT) > .99 AS duplicates_label FROM audit"
        for c in C14_COLS
    ),
)
def c14(t: Tables):
    return rounded(S.duplicate_checks(fr.audit(t), C14_COLS, "y"), "same")


@query(
    "c15_anonymous_names",
    r"""WITH cols AS (SELECT DISTINCT p_brand AS ds, CASE WHEN p_size <= 25 THEN 'v' || p_size WHEN p_size <= 35 THEN 'x_' || p_size
                      ELSE p_name END AS col FROM part)
  SELECT ds, count(*) AS n_cols, round(avg((regexp_matches(col, '(?i)^(attribute|attr|var|col|feature|[avxf])\s*_?\d+$')
         OR (length(col) <= 3 AND regexp_matches(col, '^[A-Za-z]')))::INT), 6)::DOUBLE AS anon_share,
         avg((regexp_matches(col, '(?i)^(attribute|attr|var|col|feature|[avxf])\s*_?\d+$')
         OR (length(col) <= 3 AND regexp_matches(col, '^[A-Za-z]')))::INT) > .6 AS anonymous FROM cols GROUP BY ds""",
)
def c15(t: Tables):
    s = F.col("p_size")
    name = F.when(s <= 25, F.concat(F.lit("v"), s)).when(s <= 35, F.concat(F.lit("x_"), s)).otherwise(F.col("p_name"))
    cols = t.part.select(F.col("p_brand").alias("ds"), name.alias("col")).distinct()
    return rounded(S.anonymous_names(cols, ["ds"]), "anon_share")


JUDGED_SQL = ", judged AS (SELECT *, auc >= 0.7 AS a, miss > 0.5 OR regex AS b FROM features)"


def judged(t: Tables):
    return features(t).withColumns({"a": F.col("auc") >= 0.7, "b": (F.col("miss") > 0.5) | F.col("regex")})


PRF_TAIL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS p,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS r,
  round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1"""

MCC_TAIL = """round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn)
  / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6)::DOUBLE AS mcc"""

COUNTS = """count(*) FILTER (WHERE {y} AND {p}) AS tp, count(*) FILTER (WHERE NOT {y} AND {p}) AS fp,
  count(*) FILTER (WHERE {y} AND NOT {p}) AS fn, count(*) FILTER (WHERE NOT {y} AND NOT {p}) AS tn"""


@query(
    "c16_screen_fusion",
    FEATURES_SQL
    + JUDGED_SQL
    + """, v AS (SELECT 'A' AS screen, is_pos, a AS pred FROM judged UNION ALL SELECT 'B', is_pos, b FROM judged
      UNION ALL SELECT 'UNION', is_pos, a OR b FROM judged UNION ALL SELECT 'AGREE', is_pos, a AND b FROM judged),
      c AS (SELECT screen, """
    + COUNTS.format(y="is_pos", p="pred")
    + f" FROM v GROUP BY screen) SELECT screen, tp, fp, fn, tn, {PRF_TAIL}, {MCC_TAIL} FROM c",
)
def c16(t: Tables):
    return rounded(S.fuse(judged(t), "a", "b"), "p", "r", "f1", "mcc")


@query(
    "c16_fusion_gaps_by_subtype",
    FEATURES_SQL
    + JUDGED_SQL
    + """ SELECT coalesce(subtype, 'NONE') AS subtype, count(*) FILTER (WHERE is_pos AND a AND NOT b) AS only_a,
      count(*) FILTER (WHERE is_pos AND b AND NOT a) AS only_b, count(*) FILTER (WHERE is_pos AND NOT a AND NOT b) AS missed_by_both,
      count(*) FILTER (WHERE a OR b) AS flagged, count(*) AS n, count(*) FILTER (WHERE is_pos) AS n_pos
      FROM judged GROUP BY 1""",
)
def c16b(t: Tables):
    j = judged(t).withColumn("subtype", F.coalesce("subtype", F.lit("NONE")))
    return S.fusion_gaps(j, "a", "b", by=["subtype"])


@query(
    "c17_triage_bucket",
    FEATURES_SQL
    + JUDGED_SQL
    + """ SELECT bucket, count(*) AS n, count(*) FILTER (WHERE is_pos) AS n_pos FROM (
      SELECT is_pos, CASE WHEN b AND a THEN 'A' WHEN b THEN 'B' WHEN a THEN 'C' ELSE 'D' END AS bucket FROM judged) GROUP BY bucket""",
)
def c17(t: Tables):
    b = S.triage(judged(t), "b", "a")
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_pos").alias("n_pos"))


@query(
    "c18_constant_baselines",
    FEATURES_SQL
    + """, v AS (SELECT 'B0 never' AS screen, is_pos, FALSE AS pred FROM features
      UNION ALL SELECT 'B5 regex or auc', is_pos, regex OR auc >= 0.9 FROM features), c AS (SELECT screen, """
    + COUNTS.format(y="is_pos", p="pred")
    + f" FROM v GROUP BY screen) SELECT screen, tp, fp, fn, tn, {PRF_TAIL}, {MCC_TAIL} FROM c",
)
def c18(t: Tables):
    return rounded(S.constant_baselines(features(t), 0.9), "p", "r", "f1", "mcc")
