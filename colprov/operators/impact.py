"""What a leak costs downstream: folds, arms, fits, and the bookkeeping of results.

Forests are grown here, boosted trees are Spark ML's. Only signs and orderings are comparable with other
learners, so every number comes with the arm it is to be compared with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.ranks import dense_codes, exact_quantiles
from colprov.functions.special import ratio
from colprov.operators.fits import Fit, Fits
from colprov.operators.score import count_if, with_prf
from colprov.operators.screens import class_auc, grid_threshold

# --------------------------------------------------------------------- folds


def grouped_folds(df: DataFrame, group: str, k: int, seed: int = 0, hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """All rows of a group in one fold, without moving a row."""
    h = hashed(F.col(group)) if hashed else F.xxhash64(F.col(group), F.lit(seed))
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, row_id: str, y: str, k: int, seed: int = 0, hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each class dealt round over the folds in hashed order; ``row_id`` is unique.
    A class of any size is ranked in ranges, never in one task."""
    h = hashed(F.col(row_id)) if hashed else F.xxhash64(F.col(row_id), F.lit(seed))
    keyed = df.select(row_id, F.col(y).alias("_y"), h.alias("_h"))
    place = dense_codes(keyed, ["_y"], ["_h", row_id], "_place").select(row_id, (F.col("_place") % k).cast("int").alias("fold"))
    return df.join(place, row_id)


def grouped_stratified_folds(df: DataFrame, group: str, y: str, k: int, seed: int = 0, hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """All rows of a group in one fold, and every fold with about the same classes.

    Groups are ordered by size, then by their histogram of classes, then by hash, and dealt
    round the folds in that order. So of the groups with one histogram each fold gets the
    same number but for one, and two folds differ in their count of a class by at most the
    sum of that class over the distinct histograms. Groups are ranked in ranges, never in
    one task; a row moves only to meet its group's fold.
    """
    h = hashed(F.col(group)) if hashed else F.xxhash64(F.col(group), F.lit(seed))
    n = df.groupBy(group, F.col(y).cast("string").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = n.groupBy(group).agg(
        (-F.sum("_n")).alias("_size"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("_y", F.lit("")).alias("y"), "_n"))), lambda e: F.concat(e["y"], F.lit(":"), e["_n"].cast("string"))), ",").alias("_kind"),
    )
    keyed = kinds.select(group, "_size", "_kind", h.alias("_h"), F.lit(0).alias("_one"))
    dealt = dense_codes(keyed, ["_one"], ["_size", "_kind", "_h", group], "_place").select(group, (F.col("_place") % k).cast("int").alias("fold"))
    return join_dim(df, dealt, [group])


def assign_folds(df: DataFrame, row_id: str, y: str, k: int = 5, group: str | None = None, seed: int = 0, hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Grouped and stratified when the key repeats and has at least k groups, else stratified."""
    if group:
        g = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).first()
        if k <= g["g"] < g["n"]:
            return grouped_stratified_folds(df, group, y, k, seed, hashed)
    return stratified_folds(df, row_id, y, k, seed, hashed)


def external_folds(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    return df.join(folds.select(key, "fold"), key)


# ---------------------------------------------------------------------- arms


def arms_from(features: list[str], documented: list[str], **detectors: list[str]) -> dict[str, list[str]]:
    """Arm -> dropped columns: keep all, drop the documented leaks, drop what each detector flags."""
    arms = {"ALL": [], "GT": [c for c in documented if c in features]}
    return arms | {name: [c for c in cols if c in features] for name, cols in detectors.items()}


def retained_sets(dropped: DataFrame, features: DataFrame, arms: DataFrame) -> DataFrame:
    """(ds, arm, retained, n_dropped, fit_id): the sorted columns each arm keeps;
    arms that keep the same columns share a ``fit_id``. ``dropped``: (ds, arm, col)."""
    kept = arms.join(features, "ds").join(dropped, ["ds", "arm", "col"], "left_anti")
    sets = kept.groupBy("ds", "arm").agg(F.array_join(F.array_sort(F.collect_list("col")), ",").alias("retained"))
    n = dropped.join(features, ["ds", "col"], "left_semi").groupBy("ds", "arm").agg(F.count(F.lit(1)).alias("n_dropped"))
    out = arms.join(sets, ["ds", "arm"], "left").join(n, ["ds", "arm"], "left")
    return out.select(
        "ds", "arm", F.coalesce("retained", F.lit("")).alias("retained"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.left(F.sha2(F.concat_ws("|", "ds", F.coalesce("retained", F.lit(""))), 256), F.lit(12)).alias("fit_id"),
    )


def fits_saved(sets: DataFrame) -> DataFrame:
    return sets.agg(F.count(F.lit(1)).alias("n_arms"), F.count_distinct("fit_id").alias("n_fits")).withColumn(
        "saved", ratio(F.col("n_arms") - F.col("n_fits"), F.col("n_arms"))
    )


# ---------------------------------------------------------------------- fits


def run_arms(
    df: DataFrame,
    features: list[str],
    y: str,
    arms: dict[str, list[str]],
    k: int = 5,
    kind: str = "rf",
    inner: int = 0,
    unit: str | None = None,
    keep: list[str] | None = None,
    fold: str | dict[str, str] = "fold",
    folder: str | None = None,
    **opts,
) -> DataFrame:
    """Every row predicted by the fits that did not see its fold, for every arm.

    ``fold`` is an SQL expression over kept columns, or one per partition of the rows (a
    dictionary), which adds the column ``part``. Arms that keep the same columns share their
    fits, and all fits run side by side (``fits.Fits``). Columns (arm, [part,] fold, the kept
    ones, _label, scores, score, pred[, threshold]); ``_label`` and the places of ``scores``
    are the sorted classes of ``y``. With ``inner`` folds a threshold is chosen on the
    training part only, from out-of-fold scores; rows of one ``unit`` stay together in an
    inner fold.
    """
    if inner and not unit:
        raise ValueError("inner folds need the unit they are dealt by")
    parts = fold if isinstance(fold, dict) else {"": fold}
    held = [*(["fold"] if "fold" in df.columns else []), *(keep or []), *([unit] if unit else [])]
    fits = Fits(df, features, y, held, folder)
    options = tuple(sorted(opts.items()))
    outer: dict[Fit, list[dict]] = {}
    inside: dict[Fit, list[dict]] = {}
    for arm, dropped in arms.items():
        cols = tuple(c for c in features if c not in dropped)
        if not cols:
            continue
        for part, by in parts.items():
            for i in range(k):
                tag = {"arm": arm, "part": part, "fold": i}
                outer.setdefault(Fit(cols, f"({by}) <> {i}", f"({by}) = {i}", kind, options), []).append(tag)
                for j in range(inner):
                    own = f"pmod(xxhash64({unit}, 'inner', {i}), {inner})"
                    seen, left = f"({by}) <> {i} AND {own} <> {j}", f"({by}) <> {i} AND {own} = {j}"
                    inside.setdefault(Fit(cols, seen, left, kind, options), []).append(tag)
    names = fits.run([*outer, *inside])
    tagged = lambda which: [(names[f], t) for f, tags in which.items() for t in tags]
    keys = ["arm", "part", "fold"]
    out = fits.read(tagged(outer)) if "fold" not in held else fits.read([(n, {**t, "_i": t["fold"]}) for n, t in tagged(outer)]).drop("fold").withColumnRenamed("_i", "fold")
    if inner:
        oof = fits.read([(n, {**t, "_i": t["fold"]}) for n, t in tagged(inside)]).select("arm", "part", F.col("_i").alias("fold"), "score", (F.col("_label") == len(fits.classes) - 1).alias("y"))
        best = grid_threshold(oof, "score", "y", exact_quantiles(oof, keys, "score", [q / 100 for q in range(1, 100)]), keys)
        out = join_dim(out, best.select(*keys, "threshold"), keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return out if isinstance(fold, dict) else out.drop("part")


# ------------------------------------------------------------------- results


def fold_scores(pred: DataFrame, score: str, y: Column, flagged: Column, by: list[str], fold: str = "fold") -> DataFrame:
    """AUC, F1, P, R per arm as means over folds, one-class folds left out."""
    keys = [*by, fold]
    p = pred.select(*keys, F.col(score).alias("v"), y.cast("int").alias("y"), flagged.alias("f"))
    counts = p.groupBy(*keys, "v", "y").agg(F.count(F.lit(1)).alias("n"))
    auc = class_auc(counts, keys).where("y = 1 AND auc IS NOT NULL").select(*keys, "auc")
    conf = with_prf(
        p.groupBy(*keys).agg(
            count_if(F.col("f") & (F.col("y") == 1)).alias("tp"), count_if(F.col("f") & (F.col("y") == 0)).alias("fp"), count_if(~F.col("f") & (F.col("y") == 1)).alias("fn")
        )
    )
    return auc.join(conf, keys).groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("auc", "f1", "p", "r")], F.count(F.lit(1)).alias("n_folds"))


def pooled_confusion(pred: DataFrame, y: Column, flagged: Column, by: list[str]) -> DataFrame:
    """Counts summed over folds first, rates from the sums."""
    return with_prf(
        pred.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), count_if(~y & ~flagged).alias("tn"), count_if(~y & flagged).alias("fp"), count_if(y & ~flagged).alias("fn"), count_if(y & flagged).alias("tp")
        )
    )


def with_ceiling(results: DataFrame, ceiling: str = "GT") -> DataFrame:
    """Each arm's residual to the honest ceiling of its (dataset, learner)."""
    gt = results.where(F.col("arm") == ceiling).select("dataset", "learner", F.col("f1").alias("gt_f1"), F.col("auc").alias("gt_auc"))
    return results.join(gt, ["dataset", "learner"]).withColumns({"res_f1": F.col("f1") - F.col("gt_f1"), "res_auc": F.col("auc") - F.col("gt_auc")})


def inflation(results: DataFrame, degenerate: list[str]) -> DataFrame:
    """Per learner what keeping the leaks adds, with and without the datasets whose
    ceiling is degenerate."""
    al = with_ceiling(results).where("arm = 'ALL'")
    both = al.withColumn("scope", F.explode(F.when(F.col("dataset").isin(degenerate), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without degenerate")))))
    return both.groupBy("scope", "learner").agg(
        F.avg("res_f1").alias("mean_df1"), F.median("res_f1").alias("median_df1"), F.max("res_f1").alias("max_df1"), F.avg("res_auc").alias("mean_dauc"), F.count(F.lit(1)).alias("n")
    )


def residuals(results: DataFrame, learners: list[str]) -> DataFrame:
    """Mean residual and mean absolute residual per arm, side by side by learner."""
    r = with_ceiling(results).groupBy("arm").pivot("learner", learners).agg(F.avg("res_f1").alias("resid"), F.avg(F.abs("res_f1")).alias("abs_resid"))
    return r


def recovered(results: DataFrame) -> DataFrame:
    """Share of the inflation an arm removes, clipped to [-1, 2], and how far it ends
    from the ceiling."""
    w = with_ceiling(results)
    al = w.where("arm = 'ALL'").select("dataset", "learner", F.col("auc").alias("all_auc"))
    j = w.where("arm NOT IN ('ALL', 'GT')").join(al, ["dataset", "learner"])
    share = F.try_divide(F.col("all_auc") - F.col("auc"), F.col("all_auc") - F.col("gt_auc"))
    return j.select("dataset", "learner", "arm", F.least(F.greatest(share, F.lit(-1.0)), F.lit(2.0)).alias("recovered"), F.abs("res_auc").alias("distance"))


def win_loss(rec: DataFrame, a: str, b: str, tie: float = 1e-3) -> DataFrame:
    """Per learner in how many datasets arm a ends nearer the ceiling than arm b."""
    p = rec.groupBy("dataset", "learner").agg(F.max(F.when(F.col("arm") == a, F.col("distance"))).alias("da"), F.max(F.when(F.col("arm") == b, F.col("distance"))).alias("db")).where("da IS NOT NULL AND db IS NOT NULL")
    d = F.col("da") - F.col("db")
    return p.groupBy("learner").agg(
        count_if(d < -tie).alias("wins"), count_if(d > tie).alias("losses"), count_if(F.abs(d) <= tie).alias("ties"), F.avg("da").alias("mean_a"), F.avg("db").alias("mean_b")
    )


def class_report(pred: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, with rows for accuracy and for
    the weighted and macro averages."""
    by = by or []
    cells = pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = cells.where("y = p").select(*by, F.col("y").alias("class"), F.col("n").alias("tp"))
    sup = cells.groupBy(*by, F.col("y").alias("class")).agg(F.sum("n").alias("support"))
    said = cells.groupBy(*by, F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    per = sup.join(said, [*by, "class"], "left").join(tp, [*by, "class"], "left").fillna(0, ["said", "tp"])
    per = per.select(
        *by, "class", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support", "tp",
    )
    total = F.sum("support")
    avg = per.groupBy(*by).agg(
        (F.sum("tp") / total).alias("acc"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"), F.col("acc").alias("recall"), F.col("acc").alias("f1")),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"w_{c}").alias(c) for c in ("precision", "recall", "f1")]),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{c}").alias(c) for c in ("precision", "recall", "f1")]),
    )
    return per.drop("tp").unionByName(avg.select(*by, F.explode(rows).alias("e"), "support").select(*by, "e.*", "support"))


def drop_arm_report(results: DataFrame, model_arms: list[str]) -> DataFrame:
    """Per model arm its F1 change against keep-all, and the oracle's; with the mean
    and the share of datasets where dropping helped honesty."""
    al = results.where("arm = 'ALL'").select("dataset", F.col("f1").alias("f_all"))
    gt = results.where("arm = 'GT'").select("dataset", F.col("f1").alias("f_gt"))
    j = results.where(F.col("arm").isin(model_arms)).join(al, "dataset").join(gt, "dataset")
    d = F.col("f_all") - F.col("f1")
    return j.groupBy("arm").agg(F.avg(d).alias("mean_delta"), F.avg(F.col("f_all") - F.col("f_gt")).alias("oracle_delta"), F.avg((d > 0).cast("double")).alias("share_positive"), F.count(F.lit(1)).alias("n"))


def assemble_results(parts: list[DataFrame], expected: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """All result rows in one table, and the expected keys that no part delivered."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, expected.join(out.select(*key).distinct(), key, "left_anti")
