"""Scoring and matched comparisons over the CELLS and PASSES frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.operators import cells as C
from colprov.operators import score as G
from colprov.operators import screens as S
from colprov.plans import frames as fr
from colprov.plans.cell_queries import alien, tally
from colprov.plans.registry import Tables, query
from colprov.plans.screen_queries import COUNTS, MCC_TAIL, PRF_TAIL, rounded
from colprov.session import cut, kept

# the decisions written out: every truth column of every guarded cell
DEC_SQL = fr.DECISIONS_SQL.replace("verdicts v ON", "shown v ON").replace("FROM verdicts)", "FROM shown)").replace(
    ",\ncells AS",
    """,
shown AS (SELECT model, ds, cond, seed, CASE WHEN seed = 1007 AND cond = 6 THEN 'x' || col ELSE col END AS col, verdict FROM verdicts),
cells AS""",
) + """,
guarded AS (SELECT model, ds, cond, seed FROM decisions GROUP BY ALL HAVING count(*) FILTER (WHERE answered) > 0),
dec AS (SELECT decisions.* FROM decisions JOIN guarded USING (model, ds, cond, seed)),
keys AS (SELECT model, ds, seed FROM guarded WHERE cond IN (1, 6) GROUP BY ALL HAVING count(DISTINCT cond) = 2),
mat AS (SELECT dec.* FROM dec JOIN keys USING (model, ds, seed) WHERE cond IN (1, 6))"""

CNT = """count(*) FILTER (WHERE is_pos AND flagged) AS tp, count(*) FILTER (WHERE NOT is_pos AND flagged) AS fp,
  count(*) FILTER (WHERE is_pos AND NOT flagged) AS fn"""


def scored(t: Tables, v: DataFrame | None = None):
    """The guarded cell tally, kept by a checkpoint: one short row per cell that every
    comparison reads several times, while the verdicts behind it are read once. ``v``: those
    verdicts, where a query reads them again."""
    return cut(C.guarded(tally(t) if v is None else C.cell_tally(v, fr.cell_truth(t))))


def shown(t: Tables) -> DataFrame:
    """The verdicts under the names they were given, kept for queries that read them again
    after the tally: finding them moves every record."""
    return t.once("shown", lambda: kept(alien(fr.verdicts(t)), "verdicts"))


def r3(df):
    return rounded(df, "p", "r", "f1")


@query("g1_prf_and_mcc", f"WITH {DEC_SQL}, c AS (SELECT cond, {COUNTS.format(y='is_pos', p='flagged')} FROM dec WHERE answered GROUP BY cond) SELECT cond, tp, fp, fn, tn, {PRF_TAIL}, {MCC_TAIL} FROM c")
def g1(t: Tables):
    """Judged columns only, as a plain prediction table."""
    from colprov.functions.joins import join_dim

    v = join_dim(alien(fr.verdicts(t)), fr.cell_truth(t).select("ds", "col", "is_pos"), ["ds", "col"])
    return rounded(G.prf(v, F.col("is_pos"), F.col("verdict") == "UNAVAILABLE", ["cond"]), "p", "r", "f1", "mcc")


POOL = f"SELECT model, cond, {CNT}, count(DISTINCT ds) AS n_ds, count(DISTINCT seed) AS n_seeds, count(*) FILTER (WHERE abstained) AS abstained FROM"


@query("g2_pooled_scores", f"WITH {DEC_SQL}, c AS ({POOL} dec GROUP BY model, cond) SELECT *, {PRF_TAIL} FROM c")
def g2(t: Tables):
    return r3(G.pooled(scored(t), ["model", "cond"]))


@query(
    "g3_completeness_scope",
    f"""WITH {DEC_SQL}, c AS (SELECT model, cond, count(DISTINCT ds) AS n_ds FROM dec WHERE NOT (cond = 6 AND ds IN ('Brand#3', 'Brand#4') AND model < '3') GROUP BY model, cond)
   SELECT model, cond, n_ds, CASE WHEN n_ds < max(n_ds) OVER (PARTITION BY model) THEN 'PARTIAL' ELSE 'COMPLETE' END AS scope FROM c""",
)
def g3(t: Tables):
    part = scored(t).where("NOT (cond = 6 AND ds IN ('Brand#3', 'Brand#4') AND model < '3')")
    return G.completeness(G.pooled(part, ["model", "cond"])).select("model", "cond", "n_ds", "scope")


@query("g4_matched_comparison", f"WITH {DEC_SQL}, c AS ({POOL} mat GROUP BY model, cond) SELECT *, {PRF_TAIL} FROM c")
def g4(t: Tables):
    return r3(G.compare(scored(t), [1, 6]))


SUB_SQL = f"""WITH {DEC_SQL}, sub AS (SELECT model, cond, subtype, count(*) FILTER (WHERE flagged) AS hit, count(*) AS total,
   count(*) FILTER (WHERE flagged) / count(*) AS recall FROM mat WHERE is_pos GROUP BY ALL)"""


def subtypes(t: Tables):
    v = shown(t)
    return G.subtype_recall(G.subtype_tally(v, fr.cell_truth(t), G.match_cells(scored(t, v), [1, 6])))


@query("g5_subtype_recall", SUB_SQL + " SELECT model, cond, subtype, hit, total, round(recall, 6)::DOUBLE AS recall FROM sub")
def g5(t: Tables):
    return rounded(subtypes(t), "recall")


@query(
    "g5_mean_subtype_recall",
    SUB_SQL
    + """ SELECT cond, subtype, round(avg(recall), 6)::DOUBLE AS all_models, round(avg(recall) FILTER (WHERE model NOT LIKE '5%'), 6)::DOUBLE AS complete_rosters,
    count(*) AS n_models, count(*) FILTER (WHERE model NOT LIKE '5%') AS n_complete FROM sub GROUP BY cond, subtype""",
)
def g5b(t: Tables):
    bad = t.orders.select(F.col("o_orderpriority").alias("model")).distinct().where("model LIKE '5%'")
    return rounded(G.mean_subtype_recall(subtypes(t), bad), "all_models", "complete_rosters")


PASS_TALLY_SQL = fr.PASSES_SQL + """,
pcells AS (SELECT DISTINCT model, ds, cond, seed FROM passes),
pdec AS (SELECT c.*, t.col, t.is_pos, coalesce(v.verdict = 'UNAVAILABLE', FALSE) AS flagged FROM pcells c JOIN cell_truth t ON c.ds = t.ds
  LEFT JOIN passes v ON v.model = c.model AND v.ds = c.ds AND v.cond = c.cond AND v.seed = c.seed AND v.col = t.col)"""


@query(
    "g6_condition_ladder",
    f"""WITH {PASS_TALLY_SQL}, c AS (SELECT model, cond, {CNT}, count(DISTINCT ds) AS n_ds FROM pdec WHERE ds IN (
      SELECT ds FROM pcells p2 WHERE p2.model = pdec.model GROUP BY ds HAVING count(DISTINCT cond) = 4) GROUP BY model, cond),
   s AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM c)
   SELECT model, cond, tp, fp, fn, n_ds, round(f, 6)::DOUBLE AS f1, round(max(f) OVER (PARTITION BY model) - min(f) OVER (PARTITION BY model), 6)::DOUBLE AS f1_range FROM s""",
)
def g6(t: Tables):
    pt = C.guarded(C.cell_tally(fr.passes(t), fr.cell_truth(t)))
    return rounded(G.ladder(pt).select("model", "cond", "tp", "fp", "fn", "n_ds", "f1", "f1_range"), "f1", "f1_range")


LOO_SQL = f"""WITH {DEC_SQL}, hs AS (SELECT DISTINCT model, ds AS held_out FROM mat),
  c AS (SELECT h.model, held_out, cond, {CNT} FROM hs h JOIN mat m ON m.model = h.model AND m.ds <> h.held_out GROUP BY ALL),
  f AS (SELECT model, held_out, cond, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM c),
  loo AS (SELECT model, held_out, max(f) FILTER (WHERE cond = 1) AS f1_a, max(f) FILTER (WHERE cond = 6) AS f1_b FROM f GROUP BY ALL)"""


@query("g7_leave_one_dataset_out", LOO_SQL + " SELECT model, held_out, round(f1_a, 6)::DOUBLE AS f1_a, round(f1_b, 6)::DOUBLE AS f1_b, round(f1_b - f1_a, 6)::DOUBLE AS gain FROM loo")
def g7(t: Tables):
    return rounded(G.leave_one_out(G.match_cells(scored(t), [1, 6]), 1, 6), "f1_a", "f1_b", "gain")


@query("g7_smallest_gain", LOO_SQL + " SELECT model, round(min(f1_b - f1_a), 6)::DOUBLE AS smallest_gain, count(*) AS n_held_out FROM loo GROUP BY model")
def g7b(t: Tables):
    return rounded(G.smallest_gain(G.leave_one_out(G.match_cells(scored(t), [1, 6]), 1, 6)), "smallest_gain")


SPREAD_SQL = f"""WITH {DEC_SQL}, ns AS (SELECT model, cond, count(DISTINCT seed) AS k FROM guarded GROUP BY ALL),
  com AS (SELECT g.model, g.cond, g.ds FROM guarded g JOIN ns USING (model, cond) GROUP BY g.model, g.cond, g.ds, k HAVING count(DISTINCT seed) = k),
  ps AS (SELECT model, cond, seed, {CNT}, count(DISTINCT ds) AS nd FROM dec JOIN com USING (model, cond, ds) GROUP BY ALL),
  fs AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM ps),
  spread AS (SELECT model, cond, count(*) AS n_seeds, min(f) AS f1_min, max(f) AS f1_max, max(nd) AS n_ds FROM fs GROUP BY ALL HAVING count(*) > 1)"""


@query("g8_seed_spread", SPREAD_SQL + " SELECT model, cond, n_seeds, round(f1_min, 6)::DOUBLE AS f1_min, round(f1_max, 6)::DOUBLE AS f1_max, n_ds, round(f1_max - f1_min, 6)::DOUBLE AS spread FROM spread")
def g8(t: Tables):
    return rounded(G.seed_spread(scored(t)), "f1_min", "f1_max", "spread")


@query(
    "g8_worst_case_gain",
    SPREAD_SQL + """ SELECT model, round(a, 6)::DOUBLE AS best_a, round(b, 6)::DOUBLE AS worst_b, round(b - a, 6)::DOUBLE AS worst_gain FROM (
      SELECT model, max(f1_max) FILTER (WHERE cond = 1) AS a, max(f1_min) FILTER (WHERE cond = 6) AS b FROM spread GROUP BY model)""",
)
def g8b(t: Tables):
    return rounded(G.worst_case_gain(G.seed_spread(scored(t)), 1, 6), "best_a", "worst_b", "worst_gain")


@query(
    "g9_triage_burden",
    f"""WITH {DEC_SQL} SELECT model, cond, count(*) FILTER (WHERE flagged) AS flagged, count(*) AS n_columns,
   round(count(*) FILTER (WHERE flagged AND is_pos) / count(*) FILTER (WHERE is_pos), 6)::DOUBLE AS recall,
   round(count(*) FILTER (WHERE flagged) / count(*), 6)::DOUBLE AS burden FROM dec GROUP BY model, cond""",
)
def g9(t: Tables):
    return rounded(G.burden(scored(t)), "recall", "burden")


A, B = "1-URGENT", "2-HIGH"


@query(
    "g10_two_rater_ensemble",
    f"""WITH {DEC_SQL}, sh AS (SELECT ds, cond, seed FROM cells WHERE model IN ('{A}', '{B}') GROUP BY ALL HAVING count(DISTINCT model) = 2),
  two AS (SELECT d.ds, d.cond, d.seed, d.col, d.is_pos, bool_or(flagged AND model = '{A}') AS a, bool_or(flagged AND model = '{B}') AS b
          FROM decisions d JOIN sh USING (ds, cond, seed) WHERE model IN ('{A}', '{B}') GROUP BY ALL),
  v AS (SELECT cond, '{A} alone' AS arm, is_pos, a AS flagged FROM two UNION ALL SELECT cond, '{B} alone', is_pos, b FROM two
        UNION ALL SELECT cond, 'AND', is_pos, a AND b FROM two UNION ALL SELECT cond, 'OR', is_pos, a OR b FROM two),
  c AS (SELECT cond, arm, {CNT} FROM v GROUP BY ALL) SELECT cond, arm, tp, fp, fn, {PRF_TAIL} FROM c WHERE tp + fp > 0""",
)
def g10(t: Tables):
    return r3(G.ensemble(alien(fr.verdicts(t)), fr.cell_truth(t), A, B))


JUDGED_SQL = fr.PASSES_SQL + """,
jd AS (SELECT model, ds, seed, col, count(DISTINCT cond) AS n, count(*) FILTER (WHERE verdict = 'UNAVAILABLE') AS k,
   bool_or(cond = 1 AND verdict = 'UNAVAILABLE') AS p1, bool_or(cond = 2 AND verdict = 'UNAVAILABLE') AS p2,
   bool_or(cond = 6 AND verdict = 'UNAVAILABLE') AS p6, bool_or(cond = 9 AND verdict = 'UNAVAILABLE') AS p9 FROM passes GROUP BY ALL HAVING count(DISTINCT cond) = 4),
judged AS (SELECT jd.*, coalesce(is_pos, FALSE) AS is_pos FROM jd LEFT JOIN cell_truth USING (ds, col))"""


def judged(t: Tables):
    return G.pass_judgments(fr.passes(t), fr.cell_truth(t), fr.PASS_IDS, ["model", "ds", "seed"])


POLICY_ROWS = {"single C1": "p1", "single C2": "p2", "single C6": "p6", "single C9": "p9", "union": "k >= 1", "2 of 4": "k >= 2", "3 of 4": "k >= 3", "unanimous": "k = 4"}


@query(
    "g11_consensus_policies",
    f"WITH {JUDGED_SQL}, v AS ({' UNION ALL '.join(f'''SELECT '{n}' AS policy, is_pos, {c} AS flagged FROM judged''' for n, c in POLICY_ROWS.items())}), "
    f"c AS (SELECT policy, {CNT} FROM v GROUP BY policy), f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS ff FROM c) "
    f"SELECT policy, tp, fp, fn, {PRF_TAIL}, round(ff - (SELECT ff FROM f WHERE policy = 'single C1'), 6)::DOUBLE AS delta FROM f",
)
def g11(t: Tables):
    p = G.policies(judged(t), fr.PASS_IDS)
    return rounded(p, "p", "r", "f1", "delta").withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")})


@query(
    "g12_three_way_routing",
    f"""WITH {JUDGED_SQL}, b AS (SELECT CASE WHEN k = 4 THEN 'drop' WHEN k > 0 THEN 'review' ELSE 'keep' END AS bucket, count(*) AS columns, count(*) FILTER (WHERE is_pos) AS leaks FROM judged GROUP BY 1)
  SELECT bucket, columns, leaks, CASE WHEN bucket <> 'keep' THEN round(leaks / columns, 6)::DOUBLE END AS precision,
  round(sum(CASE WHEN bucket <> 'keep' THEN leaks END) OVER () / sum(leaks) OVER (), 6)::DOUBLE AS reach,
  round(sum(CASE WHEN bucket = 'review' THEN columns END) OVER () / sum(columns) OVER (), 6)::DOUBLE AS burden,
  round(sum(CASE WHEN bucket = 'keep' THEN leaks END) OVER () / sum(leaks) OVER (), 6)::DOUBLE AS missed FROM b""",
)
def g12(t: Tables):
    return rounded(G.routing(judged(t), 4), "precision", "reach", "burden", "missed")


PARA_SQL = fr.RECORDS_SQL + ",\n" + fr.CELL_TRUTH_SQL + """,
arms AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY paraphrase, model, ds, cond, seed, col ORDER BY ts DESC, tie1 DESC, tie2 DESC) AS rn FROM records) WHERE rn = 1),
sh AS (SELECT DISTINCT paraphrase, model, ds, cond, seed, CASE WHEN NOT paraphrase AND seed = 1007 AND cond = 6 AND ds = 'Brand#5' THEN 'x' || col ELSE col END AS col, verdict FROM arms),
acells AS (SELECT DISTINCT paraphrase, model, ds, cond, seed FROM sh),
ad AS (SELECT c.*, t.col, t.is_pos, coalesce(v.verdict = 'UNAVAILABLE', FALSE) AS flagged, v.col IS NOT NULL AS answered FROM acells c JOIN cell_truth t ON c.ds = t.ds
  LEFT JOIN sh v ON v.paraphrase = c.paraphrase AND v.model = c.model AND v.ds = c.ds AND v.cond = c.cond AND v.seed = c.seed AND v.col = t.col),
bad AS (SELECT DISTINCT model, ds, cond FROM (SELECT paraphrase, model, ds, cond, seed FROM ad GROUP BY ALL HAVING count(*) FILTER (WHERE answered) = 0)),
both_ AS (SELECT model, ds, cond, seed FROM acells ANTI JOIN bad USING (model, ds, cond) GROUP BY ALL HAVING count(*) = 2),
c AS (SELECT paraphrase, model, cond, """ + CNT + """, count(DISTINCT ds) AS nd FROM ad JOIN both_ USING (model, ds, cond, seed) GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM c)"""


@query(
    "g13_rename_decrement",
    f"""WITH {PARA_SQL} SELECT model, cond, round(o.f, 6)::DOUBLE AS f1_original, round(a.f, 6)::DOUBLE AS f1_alias, round(o.f - a.f, 6)::DOUBLE AS decrement, o.nd AS n_ds
   FROM (SELECT * FROM f WHERE NOT paraphrase) o JOIN (SELECT * FROM f WHERE paraphrase) a USING (model, cond)""",
)
def g13(t: Tables):
    """The alias arm is scored against aliased truth after the names are carried back."""
    arms = kept(fr.verdicts(t, by=["paraphrase"]), "verdicts")
    broken = (F.col("seed") == 1007) & (F.col("cond") == 6) & (F.col("ds") == "Brand#5")
    orig = arms.where("NOT paraphrase").withColumn("col", F.when(broken, F.concat(F.lit("x"), "col")).otherwise(F.col("col")))
    aliases = fr.cell_truth(t).select("ds", "col", F.concat(F.lit("f_"), F.expr("substr(col, 2)")).alias("alias"))
    shown = arms.where("paraphrase").withColumn("col", F.concat(F.lit("f_"), F.expr("substr(col, 2)")))
    back = C.back_map(shown, aliases)
    truth = fr.cell_truth(t)
    d = G.rename_decrement(cut(C.cell_tally(orig, truth)), cut(C.cell_tally(back, truth)))
    return rounded(d, "f1_original", "f1_alias", "decrement")


@query(
    "g14_drop_datasets",
    f"""WITH {DEC_SQL}, c AS (SELECT model, cond, ds IN ('Brand#1', 'Brand#2') AS dropped, {CNT} FROM dec GROUP BY ALL),
  a AS (SELECT model, cond, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL),
  k AS (SELECT model, cond, tp, fp, fn FROM c WHERE NOT dropped),
  f AS (SELECT model, cond, CASE WHEN a.tp > 0 THEN 2 * a.tp / (2 * a.tp + a.fp + a.fn) ELSE 0 END AS x, CASE WHEN k.tp > 0 THEN 2 * k.tp / (2 * k.tp + k.fp + k.fn) ELSE 0 END AS y
        FROM a JOIN k USING (model, cond))
  SELECT model, cond, round(x, 6)::DOUBLE AS f1_all, round(y, 6)::DOUBLE AS f1_kept, round(y - x, 6)::DOUBLE AS delta FROM f""",
)
def g14(t: Tables):
    return rounded(G.without_datasets(scored(t), ["Brand#1", "Brand#2"]), "f1_all", "f1_kept", "delta")


@query(
    "g14_recode_one_positive",
    f"""WITH {DEC_SQL}, m2 AS (SELECT * REPLACE (CASE WHEN col IN (SELECT min(col) FROM cell_truth WHERE is_pos GROUP BY ds) THEN FALSE ELSE is_pos END AS is_pos) FROM mat),
   c AS (SELECT model, cond, {CNT} FROM m2 GROUP BY ALL) SELECT *, {PRF_TAIL} FROM c""",
)
def g14b(t: Tables):
    """The first positive of every dataset recoded as legitimate, on matched cells."""
    truth = fr.cell_truth(t)
    one = truth.where("is_pos").groupBy("ds").agg(F.min("col").alias("col")).withColumn("is_pos", F.lit(False))
    tl = cut(C.guarded(C.cell_tally(alien(fr.verdicts(t)), G.override_truth(truth, one))))
    return r3(G.compare(tl, [1, 6]).select("model", "cond", "tp", "fp", "fn", "p", "r", "f1"))


@query(
    "g15_hardest_columns",
    f"""WITH {DEC_SQL}, m AS (SELECT 'missed' AS what, ds, col, count(*) FILTER (WHERE NOT flagged) AS times FROM dec WHERE is_pos GROUP BY ds, col),
   f AS (SELECT 'flagged' AS what, ds, col, count(*) FILTER (WHERE flagged) AS times FROM dec WHERE NOT is_pos GROUP BY ds, col)
   SELECT * FROM (SELECT * FROM m WHERE times > 0 ORDER BY times DESC, ds, col LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM f WHERE times > 0 ORDER BY times DESC, ds, col LIMIT 10)""",
)
def g15(t: Tables):
    v = shown(t)
    cells = scored(t, v).select(*fr.CELL)
    return G.hardest(v.join(cells, fr.CELL, "left_semi"), fr.cell_truth(t).select("ds", "col", "is_pos"), cells, 10)


@query(
    "g16_blind_subset_hits",
    f"""WITH {fr.VERDICTS_SQL} SELECT model, cond, count(*) FILTER (WHERE verdict = 'UNAVAILABLE') AS hits, count(*) AS asked FROM verdicts
   WHERE col IN (SELECT 'c' || p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY ALL""",
)
def g16(t: Tables):
    blind = t.part.where("p_type = 'PROMO'").select(F.col("p_brand").alias("ds"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"))
    return G.blind_hits(fr.verdicts(t), blind)


def grid_cell(c):
    return f"coalesce(max(CASE WHEN cond = {c} THEN CASE WHEN tp = tp + fn THEN 'HIT' WHEN tp = 0 THEN 'miss' ELSE tp || '/' || (tp + fn) END || ' fp' || fp END), '-') AS c{c}"


@query("g17_hit_grid", f"WITH {DEC_SQL}, c AS (SELECT model, ds, cond, {CNT} FROM dec GROUP BY ALL) SELECT model, ds, {grid_cell(1)}, {grid_cell(6)} FROM c GROUP BY model, ds")
def g17(t: Tables):
    return G.hit_grid(scored(t), [1, 6])


@query(
    "g18_tier_means",
    f"""WITH {DEC_SQL}, c AS (SELECT model, cond, {CNT} FROM mat GROUP BY ALL), f AS (SELECT model, cond, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM c),
  g AS (SELECT model, max(f) FILTER (WHERE cond = 6) - max(f) FILTER (WHERE cond = 1) AS gain FROM f GROUP BY model),
  r AS (SELECT *, CASE WHEN model < '3' THEN 'frontier' ELSE 'replication' END AS tier FROM g), rr AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY gain, model) AS rn FROM r)
  SELECT tier, round(avg(gain), 6)::DOUBLE AS mean_gain, count(*) AS n, round(avg(gain) FILTER (WHERE model NOT LIKE '5%'), 6)::DOUBLE AS mean_complete,
  round(avg(gain) FILTER (WHERE rn > 1), 6)::DOUBLE AS mean_without_worst FROM rr GROUP BY tier""",
)
def g18(t: Tables):
    models = t.orders.select(F.col("o_orderpriority").alias("model")).distinct()
    tiers = models.withColumn("tier", F.when(F.col("model") < "3", "frontier").otherwise("replication"))
    gains = G.gain(G.compare(scored(t), [1, 6]), 1, 6)
    return rounded(G.tier_means(gains, tiers, models.where("model LIKE '5%'")), "mean_gain", "mean_complete", "mean_without_worst")


NAMED_SQL = """n AS (SELECT DISTINCT p_brand AS ds, p_type || '_' || p_size AS c0, p_size FROM part),
named AS (SELECT CASE WHEN ds < 'Brand#2' THEN 'A' ELSE 'B' END AS stratum, ds,
  CASE p_size % 6 WHEN 0 THEN c0 || '_outcome' WHEN 1 THEN 'days_to_' || c0 WHEN 2 THEN 'final_' || c0 WHEN 3 THEN c0 || '_score' ELSE c0 END AS col,
  p_size % 3 = 0 AS is_pos, CASE WHEN p_size % 3 = 0 THEN CASE p_size % 2 WHEN 0 THEN 'REASON' ELSE 'TIMING' END END AS subtype FROM n)"""


@query(
    "g19_lexical_score_by_stratum",
    r"WITH " + NAMED_SQL + r""", h AS (SELECT *, regexp_matches(col, '(?i)(^|_|\b)final(\b|_|$)|(\b|_)outcome(\b|_)') AS frozen,
   regexp_matches(col, '(?i)(^|_|\b)final(\b|_|$)|(\b|_)outcome(\b|_)|days?_to_|score$|_outcome$') AS tuned FROM named),
  v AS (SELECT stratum, 'B1' AS variant, is_pos, subtype, frozen AS flagged FROM h UNION ALL SELECT stratum, 'B1-tuned', is_pos, subtype, tuned FROM h),
  c AS (SELECT stratum, variant, """ + CNT + f""", count(*) FILTER (WHERE NOT is_pos AND NOT flagged) AS tn, count(*) FILTER (WHERE is_pos AND NOT flagged AND subtype = 'REASON') AS miss_reason,
  count(*) FILTER (WHERE is_pos AND NOT flagged AND subtype = 'CONSEQUENCE') AS miss_consequence, count(*) FILTER (WHERE is_pos AND NOT flagged AND subtype = 'TIMING') AS miss_timing FROM v GROUP BY ALL)
  SELECT stratum, variant, tp, fp, fn, tn, miss_reason, miss_consequence, miss_timing, {PRF_TAIL}, {MCC_TAIL} FROM c""",
)
def g19(t: Tables):
    n = t.part.select("p_brand", F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("c0"), "p_size").distinct()
    k = F.col("p_size") % 6
    name = (
        F.when(k == 0, F.concat("c0", F.lit("_outcome"))).when(k == 1, F.concat(F.lit("days_to_"), "c0"))
        .when(k == 2, F.concat(F.lit("final_"), "c0")).when(k == 3, F.concat("c0", F.lit("_score"))).otherwise(F.col("c0"))
    )
    pos = F.col("p_size") % 3 == 0
    named = n.select(
        F.when(F.col("p_brand") < "Brand#2", "A").otherwise("B").alias("stratum"), name.alias("col"), pos.alias("is_pos"),
        F.when(pos, F.when(F.col("p_size") % 2 == 0, "REASON").otherwise("TIMING")).alias("subtype"),
    )
    return rounded(G.lexical_score(S.name_screen(named), ["stratum"]), "p", "r", "f1", "mcc")


RECALL_SQL = """ans AS (SELECT p_brand AS ds, CASE WHEN max(p_size) < 50 AND p_brand LIKE '%7' THEN 'timeout' END AS error,
   string_agg(CASE WHEN p_size % 4 = 0 THEN ' C' ELSE 'x' END || p_partkey, ', ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand)"""


@query(
    "g20_names_recalled_from_memory",
    f"""WITH {RECALL_SQL}, {fr.CELL_TRUTH_SQL}, said AS (SELECT DISTINCT ds, lower(trim(unnest(string_split(text, ',')))) AS name FROM ans WHERE error IS NULL),
   h AS (SELECT t.ds, t.is_pos, s.name IS NOT NULL AS hit FROM cell_truth t LEFT JOIN said s ON s.ds = t.ds AND s.name = t.col),
   c AS (SELECT ds, count(*) FILTER (WHERE hit) AS recalled, count(*) AS n, count(*) FILTER (WHERE hit AND is_pos) AS pos_recalled, count(*) FILTER (WHERE is_pos) AS n_pos FROM h GROUP BY ds),
   o AS (SELECT ans.ds, (error IS NOT NULL)::BIGINT AS errors, CASE WHEN error IS NULL THEN recalled ELSE 0 END AS recalled, CASE WHEN error IS NULL THEN n ELSE 0 END AS n,
     CASE WHEN error IS NULL THEN pos_recalled ELSE 0 END AS pos_recalled, CASE WHEN error IS NULL THEN n_pos ELSE 0 END AS n_pos FROM ans JOIN c USING (ds))
   SELECT *, round(coalesce(recalled / nullif(n, 0), 0), 6)::DOUBLE AS rate, round(coalesce(pos_recalled / nullif(n_pos, 0), 0), 6)::DOUBLE AS pos_rate FROM o""",
)
def g20(t: Tables):
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.when(F.col("p_size") % 4 == 0, F.lit(" C")).otherwise(F.lit("x")), F.col("p_partkey").cast("string")).alias("s")))), lambda x: x["s"]), ", ")
    ans = t.part.groupBy(F.col("p_brand").alias("ds")).agg(
        F.when((F.max("p_size") < 50) & F.first("p_brand").like("%7"), "timeout").alias("error"), said.alias("text")
    )
    return rounded(G.recalled_names(ans, fr.cell_truth(t)), "rate", "pos_rate")


@query(
    "g21_rows_recalled_verbatim",
    r"""WITH p AS (SELECT e.event_id, e.event_id || ',' || e.user_id || ',' || e.event_type || ',' || CASE WHEN e.user_id % 3 = 0 THEN 'ok' ELSE 'no' END AS true_row,
      e.event_id || ',' || e.user_id || ',' || CASE WHEN e.user_id % 2 = 0 THEN e.event_type ELSE 'unknown' END || ',' || 'ok' AS said FROM events e),
   a AS (SELECT event_id, true_row AS t, left(said, length(true_row)) AS g FROM p)
   SELECT event_id, t = g AS exact, TRUE AS mined, round(1 - levenshtein(t, g) / greatest(length(t), length(g)), 6)::DOUBLE AS similarity FROM a""",
)
def g21(t: Tables):
    e = t.events
    row = lambda kind, tail: F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), kind, tail)
    said = row(F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("unknown")), F.lit("ok"))
    pairs = e.select(
        "event_id",
        row(F.col("event_type"), F.when(F.col("user_id") % 3 == 0, F.lit("ok")).otherwise(F.lit("no"))).alias("true"),
        F.concat(F.lit("The next row should be:\n`"), said, F.lit("`\nas asked.")).alias("got"),
    )
    return rounded(G.row_match(pairs).select("event_id", "exact", "mined", "similarity"), "similarity")
