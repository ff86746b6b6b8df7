"""Downstream cost over the AUDIT frame and over result tables derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from colprov.operators import impact as J
from colprov.operators import stats as H
from colprov.operators.cells import vote
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.plans.screen_queries import PRF_TAIL, rounded
from colprov.plans.stat_queries import PRED_SQL, predictions

HASH = lambda c: c * 7919 % 100003


@query("j1_grouped_folds", "SELECT l_orderkey, l_linenumber, l_partkey, ((l_orderkey * 7919 % 100003) % 5)::INT AS fold FROM lineitem")
def j1(t: Tables):
    return J.grouped_folds(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 5, hashed=HASH)


@query("j1_stratified_folds", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey * 7919 % 100003, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def j1b(t: Tables):
    return J.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5, hashed=HASH).select("o_orderkey", "fold")


@query("j1_external_folds", "SELECT fold, count(*) AS n FROM (SELECT o_custkey % 5 AS fold FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY fold")
def j1c(t: Tables):
    folds = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("fold"))
    return J.external_folds(t.lineitem, folds, "l_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


#: Orders as groups of lines, by size and histogram of the classes, dealt round.
DEALT_SQL = """n AS (SELECT l_orderkey, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
 g AS (SELECT l_orderkey, -sum(n) AS size, string_agg(y || ':' || n, ',' ORDER BY y) AS kind FROM n GROUP BY l_orderkey),
 f AS (SELECT l_orderkey, ((row_number() OVER (ORDER BY size, kind, l_orderkey * 7919 % 100003, l_orderkey) - 1) % 5)::INT AS fold FROM g)"""


def dealt(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    return J.assign_folds(rows, "row", "l_returnflag", 5, group="l_orderkey", hashed=HASH)


@query("j1_assigned_folds", f"WITH {DEALT_SQL} SELECT l_orderkey, l_linenumber, fold FROM lineitem JOIN f USING (l_orderkey)")
def j1d(t: Tables):
    """Lines of one order in one fold, folds alike in size and classes."""
    return dealt(t).select("l_orderkey", "l_linenumber", "fold")


@query(
    "j1_fold_balance",
    f"""WITH {DEALT_SQL}, c AS (SELECT fold, l_returnflag AS class, count(*) AS n, count(DISTINCT l_orderkey) AS n_groups FROM lineitem JOIN f USING (l_orderkey) GROUP BY ALL)
   SELECT class, max(n) - min(n) AS spread, sum(n)::BIGINT AS n, sum(n_groups)::BIGINT AS n_groups, count(*) AS n_folds FROM c GROUP BY class""",
)
def j1e(t: Tables):
    """How far apart the folds are in each class."""
    c = dealt(t).groupBy("fold", F.col("l_returnflag").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_groups"))
    return c.groupBy("class").agg((F.max("n") - F.min("n")).alias("spread"), F.sum("n").alias("n"), F.sum("n_groups").alias("n_groups"), F.count(F.lit(1)).alias("n_folds"))


ARMS_SQL = """f AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, p_size, p_type FROM part), a AS (SELECT * FROM (SELECT DISTINCT ds FROM f), (VALUES ('ALL'), ('GT'), ('B3'), ('m1')) v(arm)),
 d AS (SELECT ds, 'GT' AS arm, col FROM f WHERE p_size <= 10 UNION ALL SELECT ds, 'B3', col FROM f WHERE p_size <= CASE WHEN ds < 'Brand#2' THEN 10 ELSE 12 END UNION ALL SELECT ds, 'm1', col FROM f WHERE p_type = 'NONE'),
 k AS (SELECT a.ds, a.arm, f.col FROM a JOIN f USING (ds) ANTI JOIN d ON d.ds = a.ds AND d.arm = a.arm AND d.col = f.col),
 s AS (SELECT ds, arm, string_agg(col, ',' ORDER BY col) AS retained FROM k GROUP BY ALL), n AS (SELECT ds, arm, count(*) AS n_dropped FROM d GROUP BY ALL),
 sets AS (SELECT a.ds, a.arm, coalesce(retained, '') AS retained, coalesce(n_dropped, 0) AS n_dropped, left(sha256(a.ds || '|' || coalesce(retained, '')), 12) AS fit_id FROM a LEFT JOIN s USING (ds, arm) LEFT JOIN n USING (ds, arm))"""


def arm_sets(t: Tables):
    name = F.concat(F.lit("c"), F.col("p_partkey").cast("string"))
    f = t.part.select(F.col("p_brand").alias("ds"), name.alias("col"), "p_size", "p_type")
    arms = f.select("ds").distinct().select("ds", F.explode(F.array(*[F.lit(a) for a in ("ALL", "GT", "B3", "m1")])).alias("arm"))
    pick = lambda arm, cond: f.where(cond).select("ds", F.lit(arm).alias("arm"), "col")
    b3 = F.col("p_size") <= F.when(F.col("ds") < "Brand#2", 10).otherwise(12)
    dropped = pick("GT", F.col("p_size") <= 10).unionByName(pick("B3", b3)).unionByName(pick("m1", F.col("p_type") == "NONE"))
    return J.retained_sets(dropped, f.select("ds", "col"), arms)


@query("j2_arms_and_retained_sets", f"WITH {ARMS_SQL} SELECT ds, arm, retained, n_dropped FROM sets")
def j2(t: Tables):
    return arm_sets(t).select("ds", "arm", "retained", "n_dropped")


@query("j3_fits_shared", f"WITH {ARMS_SQL} SELECT count(*) AS n_arms, count(DISTINCT fit_id) AS n_fits, round((count(*) - count(DISTINCT fit_id)) / count(*), 6)::DOUBLE AS saved FROM sets")
def j3(t: Tables):
    return rounded(J.fits_saved(arm_sets(t)), "saved")


ML_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "reason_flag", "refund_amt"]
CLEAN = ["l_quantity", "l_discount", "l_tax", "p_size"]
#: Rows and positives that every arm must have predicted.
ML_SQL = "n AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_returnflag = 'R') AS n_positive FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def ml_frame(t: Tables, k: int = 5):
    a = fr.audit(t).withColumn("target", (F.col("y") == "R").cast("int"))
    a = a.fillna(-999.0, ["refund_amt"])
    return J.grouped_folds(a, "l_orderkey", k)


def by_arm(pred):
    flagged = F.col("score") >= (F.col("threshold") if "threshold" in pred.columns else F.lit(0.5))
    return J.fold_scores(pred, "score", F.col("_label") == 1, flagged, ["arm"])


def arm_facts(pred, ceiling: str = "GT"):
    """Per arm what was predicted, and how it stands to the arm without the leaks."""
    scores, honest = by_arm(pred), F.col("arm") == ceiling
    n = pred.groupBy("arm").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("_label") == 1).cast("long")).alias("n_positive"))
    gt = scores.where(honest).select(F.col("auc").alias("gt_auc"), F.col("f1").alias("gt_f1"))
    return n.join(scores, "arm").join(F.broadcast(gt), how="inner").select(
        "arm", "n_folds", "n_rows", "n_positive", (F.col("auc") > F.col("gt_auc") + 0.1).alias("auc_over_gt"), (F.col("f1") > F.col("gt_f1") + 0.1).alias("f1_over_gt"),
        (F.abs(F.col("auc") - 0.5) < 0.05).alias("chance"),
    )


def facts_sql(*arms: str) -> str:
    """What ``arm_facts`` must say: only arms with a leak are over the ceiling, only the ceiling is at chance."""
    rows = ", ".join(f"('{a}', {a != 'GT'})" for a in arms)
    return f"WITH {ML_SQL} SELECT arm, 5::BIGINT AS n_folds, n_rows, n_positive, leaky AS auc_over_gt, leaky AS f1_over_gt, NOT leaky AS chance FROM n, (VALUES {rows}) v(arm, leaky)"


@query("j4_balanced_fits_by_arm", facts_sql("ALL", "GT", "leak_alone"))
def j4(t: Tables):
    """Keep all, drop the documented, leak alone; forests of 400 trees, every row predicted out of fold."""
    return arm_facts(J.run_arms(ml_frame(t), ML_FEATURES, "target", J.arms_from(ML_FEATURES, fr.LEAKS, leak_alone=CLEAN)))


@query("j4_boosted_fits_by_arm", facts_sql("ALL", "GT", "leak_alone"))
def j4b(t: Tables):
    """The same arms with up to 400 boosted trees, stopped early."""
    return arm_facts(J.run_arms(ml_frame(t), ML_FEATURES, "target", J.arms_from(ML_FEATURES, fr.LEAKS, leak_alone=CLEAN), kind="gb"))


@query("j5_nested_threshold", f"SELECT *, 5::BIGINT AS n_thresholds FROM ({facts_sql('ALL', 'GT')})")
def j5(t: Tables):
    """Thresholds from three inner folds of each training part."""
    pred = J.run_arms(ml_frame(t), ML_FEATURES, "target", {"ALL": [], "GT": fr.LEAKS}, inner=3, unit="l_orderkey")
    n = pred.where("threshold > 0 AND threshold < 1").groupBy("arm").agg(F.count_distinct("fold").alias("n_thresholds"))
    return arm_facts(pred).join(n, "arm")


SCORES_SQL = """pr AS (SELECT o_orderpriority AS arm, l_linenumber AS fold, ((l_quantity + 50 * (l_returnflag = 'R')::INT * (l_tax > 0.03)::INT) / 100) AS score, l_returnflag = 'R' AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def scores(t: Tables):
    r = F.col("l_returnflag") == "R"
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_orderpriority").alias("arm"), F.col("l_linenumber").alias("fold"), ((F.col("l_quantity") + 50 * r.cast("int") * (F.col("l_tax") > 0.03).cast("int")) / 100).alias("score"), r.alias("y"))


@query(
    "j6_fold_mean_scores",
    f"""WITH {SCORES_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY arm, fold ORDER BY score) + (count(*) OVER (PARTITION BY arm, fold, score) - 1) / 2.0 AS rk FROM pr),
   g AS (SELECT arm, fold, count(*) FILTER (WHERE y)::DOUBLE AS np, count(*)::DOUBLE AS n, sum(rk) FILTER (WHERE y)::DOUBLE AS rs, count(*) FILTER (WHERE y AND score >= .4) AS tp, count(*) FILTER (WHERE NOT y AND score >= .4) AS fp, count(*) FILTER (WHERE y AND score < .4) AS fn FROM rk GROUP BY ALL)
   SELECT arm, round(avg((rs - np * (np + 1) / 2) / (np * (n - np))), 6) AS auc, round(avg(2 * tp / (2 * tp + fp + fn)), 6)::DOUBLE AS f1, round(avg(tp / (tp + fp)), 6)::DOUBLE AS p, round(avg(tp / (tp + fn)), 6)::DOUBLE AS r, count(*) AS n_folds FROM g GROUP BY arm""",
)
def j6(t: Tables):
    return rounded(J.fold_scores(scores(t), "score", F.col("y"), F.col("score") >= 0.4, ["arm"]), "auc", "f1", "p", "r")


@query(
    "j7_pooled_confusion",
    f"""WITH {SCORES_SQL}, c AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE NOT y AND score < .4) AS tn, count(*) FILTER (WHERE NOT y AND score >= .4) AS fp, count(*) FILTER (WHERE y AND score < .4) AS fn,
    count(*) FILTER (WHERE y AND score >= .4) AS tp FROM pr GROUP BY arm) SELECT *, {PRF_TAIL} FROM c""",
)
def j7(t: Tables):
    return rounded(J.pooled_confusion(scores(t), F.col("y"), F.col("score") >= 0.4, ["arm"]), "p", "r", "f1")


RES_SQL = """res AS (SELECT p_brand AS dataset, CASE l_linestatus WHEN 'F' THEN 'rf' ELSE 'gb' END AS learner,
   CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ALL' WHEN '2' THEN 'GT' WHEN '3' THEN 'B3' WHEN '4' THEN 'm1' ELSE 'm2' END AS arm, avg(l_discount) * 10 AS f1, avg(l_quantity) / 50 AS auc
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 w AS (SELECT r.*, g.f1 AS gt_f1, g.auc AS gt_auc, r.f1 - g.f1 AS res_f1, r.auc - g.auc AS res_auc FROM res r JOIN res g ON g.arm = 'GT' AND g.dataset = r.dataset AND g.learner = r.learner)"""


def results(t: Tables):
    a = fr.audit(t)
    arm = F.element_at(F.array(*[F.lit(x) for x in ("ALL", "GT", "B3", "m1", "m2")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return a.groupBy(F.col("p_brand").alias("dataset"), F.when(F.col("l_linestatus") == "F", "rf").otherwise("gb").alias("learner"), arm.alias("arm")).agg(
        (F.avg("l_discount") * 10).alias("f1"), (F.avg("l_quantity") / 50).alias("auc")
    )


@query(
    "j8_inflation",
    f"""WITH {RES_SQL}, s AS (SELECT 'all' AS scope, * FROM w WHERE arm = 'ALL' UNION ALL SELECT 'without degenerate', * FROM w WHERE arm = 'ALL' AND dataset <> 'Brand#7')
   SELECT scope, learner, round(avg(res_f1), 6) AS mean_df1, round(median(res_f1), 6) AS median_df1, round(max(res_f1), 6) AS max_df1, round(avg(res_auc), 6) AS mean_dauc, count(*) AS n FROM s GROUP BY ALL""",
)
def j8(t: Tables):
    return rounded(J.inflation(results(t), ["Brand#7"]), "mean_df1", "median_df1", "max_df1", "mean_dauc")


@query(
    "j8_residuals_by_arm",
    f"""WITH {RES_SQL} SELECT arm, round(avg(res_f1) FILTER (WHERE learner = 'gb'), 6) AS gb_resid, round(avg(abs(res_f1)) FILTER (WHERE learner = 'gb'), 6) AS gb_abs_resid,
    round(avg(res_f1) FILTER (WHERE learner = 'rf'), 6) AS rf_resid, round(avg(abs(res_f1)) FILTER (WHERE learner = 'rf'), 6) AS rf_abs_resid FROM w GROUP BY arm""",
)
def j8b(t: Tables):
    return rounded(J.residuals(results(t), ["gb", "rf"]), "gb_resid", "gb_abs_resid", "rf_resid", "rf_abs_resid")


REC_SQL = f"""{RES_SQL}, rec AS (SELECT w.dataset, w.learner, w.arm, least(greatest((a.auc - w.auc) / (a.auc - w.gt_auc), -1), 2) AS recovered, abs(w.res_auc) AS distance FROM w JOIN res a ON a.arm = 'ALL' AND a.dataset = w.dataset AND a.learner = w.learner WHERE w.arm NOT IN ('ALL', 'GT'))"""


@query("j9_recovered_share", f"WITH {REC_SQL} SELECT dataset, learner, arm, round(recovered, 5) AS recovered, round(distance, 6) AS distance FROM rec")
def j9(t: Tables):
    return rounded(J.recovered(results(t)), "distance").withColumn("recovered", F.round("recovered", 5))


@query(
    "j9_distance_win_loss",
    f"""WITH {REC_SQL}, p AS (SELECT dataset, learner, max(distance) FILTER (WHERE arm = 'm1') AS da, max(distance) FILTER (WHERE arm = 'B3') AS db FROM rec GROUP BY ALL)
   SELECT learner, count(*) FILTER (WHERE da - db < -.001) AS wins, count(*) FILTER (WHERE da - db > .001) AS losses, count(*) FILTER (WHERE abs(da - db) <= .001) AS ties, round(avg(da), 6) AS mean_a, round(avg(db), 6) AS mean_b
   FROM p WHERE da IS NOT NULL AND db IS NOT NULL GROUP BY learner""",
)
def j9b(t: Tables):
    return rounded(J.win_loss(J.recovered(results(t)), "m1", "B3"), "mean_a", "mean_b")


@query(
    "j10_class_report",
    f"""WITH {PRED_SQL}, c AS (SELECT y AS class, count(*) AS support, count(*) FILTER (WHERE clean = y) AS tp FROM pr GROUP BY y), s AS (SELECT clean AS class, count(*) AS said FROM pr GROUP BY clean),
   m AS (SELECT class, tp / said AS precision, tp / support AS recall, 2 * tp / (said + support) AS f1, support, tp FROM c JOIN s USING (class)),
   z AS (SELECT class, precision, recall, f1, support FROM m UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::BIGINT FROM m
     UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m
     UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m)
   SELECT class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support FROM z""",
)
def j10(t: Tables):
    return rounded(J.class_report(predictions(t), "y", "clean"), "precision", "recall", "f1")


@query(
    "j10_three_class_report",
    """WITH r AS (SELECT l_returnflag AS class FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), c AS (SELECT class, count(*) AS support FROM r GROUP BY class)
   SELECT arm, class, support, known @> [class] AS perfect, arm <> 'clean' AS over_clean FROM c, (VALUES ('clean', []), ('flag', ['R']), ('flag + code', ['A', 'N', 'R'])) v(arm, known)""",
)
def j10b(t: Tables):
    """Three classes over folds that come with the orders: flags alone against flags and a code, and neither."""
    a = fr.audit(t).drop("fold")
    folds = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("fold"))
    features = [*CLEAN, "reason_flag", "late_code"]
    arms = {"clean": ["reason_flag", "late_code"], "flag": [*CLEAN, "late_code"], "flag + code": CLEAN}
    pred = J.run_arms(J.external_folds(a, folds, "l_orderkey"), features, "y", arms, keep=["y"])
    said = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("pred") + 1).cast("int"))
    rep = J.class_report(pred.withColumn("p", said), "y", "p", ["arm"])
    acc = rep.where("class = 'accuracy'").select("arm", F.col("f1").alias("accuracy"))
    clean = acc.where("arm = 'clean'").select(F.col("accuracy").alias("clean"))
    rows = rep.where("class IN ('A', 'N', 'R')").join(acc, "arm").join(F.broadcast(clean), how="inner")
    return rows.select("arm", "class", "support", (F.col("f1") == 1).alias("perfect"), (F.col("accuracy") > F.col("clean") + 0.05).alias("over_clean"))


@query(
    "j11_clean_against_leak",
    "SELECT y, arm, 10::BIGINT AS n_partitions, TRUE AS leak_over_clean, TRUE AS steady FROM (VALUES ('0'), ('1'), ('ACCURACY'), ('MACRO')) a(y), (VALUES ('clean'), ('+leak')) b(arm)",
)
def j11(t: Tables):
    """Ten partitions of the rows into five folds, clean arm against +leak, per-class F1 and its spread."""
    folds = {str(i): f"pmod(xxhash64(l_orderkey, 'partition', {i}), 5)" for i in range(10)}
    pred = J.run_arms(ml_frame(t), ML_FEATURES, "target", {"clean": fr.LEAKS, "+leak": []}, fold=folds, keep=["l_orderkey"])
    p = pred.select("part", "arm", F.col("_label").cast("int").cast("string").alias("y"), F.col("pred").cast("int").cast("string").alias("p"))
    s = H.partition_summary(p, "part", "y", "p", ["arm"])
    means = s.groupBy("y").agg(F.max(F.when(F.col("arm") == "clean", F.col("mean"))).alias("clean"), F.max(F.when(F.col("arm") == "+leak", F.col("mean"))).alias("leak"))
    return s.join(means, "y").select("y", "arm", "n_partitions", (F.col("leak") > F.col("clean") + 0.1).alias("leak_over_clean"), (F.col("sd") < 0.05).alias("steady"))


#: What each judge flags most, as one of the features.
FLAGGED_SQL = f"""{fr.VERDICTS_SQL}, share AS (SELECT model, ['{"', '".join(ML_FEATURES)}'][1 + ascii(right(col, 1)) % {len(ML_FEATURES)}] AS f, avg((verdict = 'UNAVAILABLE')::INT::DOUBLE) AS s FROM verdicts GROUP BY ALL),
 top AS (SELECT model, arg_max(f, (s, f)) AS f FROM share GROUP BY model)"""


@query("j12_per_model_arms", f"WITH {FLAGGED_SQL}, {ML_SQL} SELECT model AS arm, f AS dropped, n_rows, n_positive, TRUE AS auc_over_gt FROM top, n")
def j12(t: Tables):
    """Arms that drop what each judge's majority flags; columns mapped onto the features."""
    names = F.array(*[F.lit(c) for c in ML_FEATURES])
    v = fr.verdicts(t).withColumn("f", F.element_at(names, (F.ascii(F.right("col", F.lit(1))) % len(ML_FEATURES) + 1).cast("int")))
    share = v.groupBy("model", "f").agg(F.avg((F.col("verdict") == "UNAVAILABLE").cast("double")).alias("s"))
    top = share.groupBy("model").agg(F.max_by("f", F.struct("s", "f")).alias("f"))
    flagged = {r["model"]: [r["f"]] for r in top.collect()}  # one row per judge
    pred = J.run_arms(ml_frame(t), ML_FEATURES, "target", {"ALL": [], "GT": fr.LEAKS, **flagged})
    dropped = t.spark.createDataFrame([(m, c[0]) for m, c in flagged.items()], "arm string, dropped string")
    return arm_facts(pred).join(F.broadcast(dropped), "arm").select("arm", "dropped", "n_rows", "n_positive", "auc_over_gt")


@query("j12_oracle_delta_of_arms", f"""WITH {RES_SQL}, a AS (SELECT dataset, learner, f1 AS fa FROM res WHERE arm = 'ALL'), g AS (SELECT dataset, learner, f1 AS fg FROM res WHERE arm = 'GT')
   SELECT arm, round(avg(fa - f1), 6) AS mean_delta, round(avg(fa - fg), 6) AS oracle_delta, round(avg((fa - f1 > 0)::INT), 6)::DOUBLE AS share_positive, count(*) AS n
   FROM res JOIN a USING (dataset, learner) JOIN g USING (dataset, learner) WHERE arm IN ('m1', 'm2', 'B3') AND learner = 'rf' GROUP BY arm""")
def j12b(t: Tables):
    return rounded(J.drop_arm_report(results(t).where("learner = 'rf'"), ["m1", "m2", "B3"]), "mean_delta", "oracle_delta", "share_positive")


@query("j13_missing_specs", f"WITH {RES_SQL} SELECT dataset, arm FROM (SELECT * FROM (SELECT DISTINCT p_brand AS dataset FROM part), (VALUES ('ALL'), ('GT'), ('m9')) v(arm)) ANTI JOIN (SELECT DISTINCT dataset, arm FROM res) USING (dataset, arm)")
def j13(t: Tables):
    r = results(t)
    expected = t.part.select(F.col("p_brand").alias("dataset")).distinct().select("dataset", F.explode(F.array(F.lit("ALL"), F.lit("GT"), F.lit("m9"))).alias("arm"))
    return J.assemble_results([r.where("learner = 'rf'"), r.where("learner = 'gb'")], expected, ["dataset", "arm"])[1]


@query("j13_assembled_results", f"WITH {RES_SQL} SELECT learner, arm, count(*) AS n, round(avg(f1), 6) AS f1 FROM res GROUP BY ALL")
def j13b(t: Tables):
    r = results(t)
    out = J.assemble_results([r.where("learner = 'rf'"), r.where("learner = 'gb'")], r.select("dataset", "arm").distinct(), ["dataset", "arm"])[0]
    return rounded(out.groupBy("learner", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1")), "f1")


@query("h13_null_subset_scan", "SELECT y, 6::BIGINT AS n_null, TRUE AS detected, TRUE AS far FROM (VALUES ('0'), ('1')) v(y)")
def h13(t: Tables):
    """The two leaky features against every pair of the clean ones, per-class z."""
    leaks, subsets, features = [c for c in ML_FEATURES if c in fr.LEAKS], H.reference_subsets(CLEAN, 2, 120), ML_FEATURES
    kept = {"leak": leaks} | {f"null{i}": cols for i, cols in enumerate(subsets)}
    pred = J.run_arms(ml_frame(t), features, "target", {name: [c for c in features if c not in cols] for name, cols in kept.items()})
    rep = J.class_report(pred.select("arm", F.col("_label").cast("int").cast("string").alias("y"), F.col("pred").cast("int").cast("string").alias("p")), "y", "p", ["arm"])
    f1s = rep.where("class IN ('0', '1')").select(F.col("arm").alias("subset"), (F.col("arm") == "leak").alias("is_leak"), F.col("class").alias("y"), "f1")
    return H.subset_z(f1s).select("y", "n_null", "detected", (F.col("z") > 5).alias("far"))
