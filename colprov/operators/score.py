"""Precision, recall, F1 and the matched comparisons built on them.

Conventions: P = tp/(tp+fp) or 0, R = tp/(tp+fn) or 0, F1 = 2PR/(P+R) or 0. An
abstention and a missing verdict both count as *not flagged*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.special import ratio

CELL = ["model", "ds", "cond", "seed"]


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def with_prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", mcc: str | None = None) -> DataFrame:
    """Add p, r, f1 from count columns; with ``mcc`` (the tn column) also mcc."""
    p = ratio(F.col(tp), F.col(tp) + F.col(fp))
    r = ratio(F.col(tp), F.col(tp) + F.col(fn))
    out = df.withColumns({"p": p, "r": r}).withColumn(
        "f1", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    )
    if mcc:
        a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, mcc))
        out = out.withColumn("mcc", ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c))))
    return out


def prf(df: DataFrame, y: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, P, R, F1 and MCC of a boolean prediction against a boolean truth."""
    counts = df.groupBy(*(by or [])).agg(
        count_if(y & pred).alias("tp"),
        count_if(~y & pred).alias("fp"),
        count_if(y & ~pred).alias("fn"),
        count_if(~y & ~pred).alias("tn"),
    )
    return with_prf(counts, mcc="tn")


# ------------------------------------------------------------------ scoring
#
# All of the following read the cell tally (one short row per cell: tp, fp, fn,
# n_cols, n_pos, abstained), never the verdicts again.


def pooled(tally: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged P, R, F1 with the datasets, seeds and abstentions behind them."""
    return with_prf(
        tally.groupBy(*by).agg(
            F.sum("tp").alias("tp"),
            F.sum("fp").alias("fp"),
            F.sum("fn").alias("fn"),
            F.count_distinct("ds").alias("n_ds"),
            F.count_distinct("seed").alias("n_seeds"),
            F.sum("abstained").alias("abstained"),
        )
    )


def completeness(scores: DataFrame) -> DataFrame:
    """PARTIAL where a condition covers fewer datasets than the model's fullest."""
    w = Window.partitionBy("model")
    return scores.withColumn("scope", F.when(F.col("n_ds") < F.max("n_ds").over(w), "PARTIAL").otherwise("COMPLETE"))


def match_cells(tally: DataFrame, conds: list[int], on: list[str] | None = None) -> DataFrame:
    """The cells of ``conds`` whose (model, ds, seed) has every one of them.

    Every comparison of conditions goes through here: a difference of two numbers
    over different cells is an accounting error, not a finding.
    """
    on = on or ["model", "ds", "seed"]
    rows = tally.where(F.col("cond").isin(conds))
    both = rows.groupBy(*on).agg(F.count_distinct("cond").alias("k")).where(F.col("k") == len(conds)).drop("k")
    return rows.join(both, on, "left_semi")


def compare(tally: DataFrame, conds: list[int]) -> DataFrame:
    """Pooled scores of each condition over matched cells only."""
    return pooled(match_cells(tally, conds), ["model", "cond"])


def gain(scores: DataFrame, a: int, b: int, by: list[str] | None = None) -> DataFrame:
    """f1_a, f1_b and their difference per model from pooled scores."""
    by = by or ["model"]
    g = scores.groupBy(*by).agg(
        F.max(F.when(F.col("cond") == a, F.col("f1"))).alias("f1_a"),
        F.max(F.when(F.col("cond") == b, F.col("f1"))).alias("f1_b"),
    )
    return g.where("f1_a IS NOT NULL AND f1_b IS NOT NULL").withColumn("gain", F.col("f1_b") - F.col("f1_a"))


def subtype_tally(verdicts: DataFrame, truth: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell.., subtype, hit, total) over the positives of the given cells."""
    coded = truth.where("is_pos").withColumn("subtype", F.coalesce("subtype", F.lit("UNCODED")))
    flags = verdicts.where("verdict = 'UNAVAILABLE'").select(*CELL, "col").join(cells.select(*CELL), CELL, "left_semi")
    hits = join_dim(flags, coded.select("ds", "col", "subtype"), ["ds", "col"]).groupBy(*CELL, "subtype").agg(
        F.count(F.lit(1)).alias("hit")
    )
    per_ds = coded.groupBy("ds", "subtype").agg(F.count(F.lit(1)).alias("total"))
    every = cells.select(*CELL).join(per_ds, "ds")
    return every.join(hits, CELL + ["subtype"], "left").withColumn("hit", F.coalesce("hit", F.lit(0).cast("long")))


def subtype_recall(sub: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sub.groupBy(*(by or ["model", "cond"]), "subtype").agg(
        F.sum("hit").alias("hit"), F.sum("total").alias("total")
    ).withColumn("recall", ratio(F.col("hit"), F.col("total")))


def mean_subtype_recall(recalls: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Mean over models of each subtype's recall, for all models and for those
    with complete rosters."""
    j = recalls.where("total > 0")
    j = j.withColumn("complete", F.lit(True)) if incomplete is None else j.join(
        incomplete.select("model", F.lit(False).alias("complete")), "model", "left"
    ).withColumn("complete", F.coalesce("complete", F.lit(True)))
    return j.groupBy("cond", "subtype").agg(
        F.avg("recall").alias("all_models"),
        F.avg(F.when(F.col("complete"), F.col("recall"))).alias("complete_rosters"),
        F.count(F.lit(1)).alias("n_models"),
        F.count_if("complete").alias("n_complete"),
    )


def ladder(tally: DataFrame) -> DataFrame:
    """Scores of every condition of a model on the datasets all of them share, with
    the range of F1 over the ladder."""
    n = tally.groupBy("model").agg(F.count_distinct("cond").alias("n_conds"))
    common = (
        tally.groupBy("model", "ds").agg(F.count_distinct("cond").alias("k")).join(n, "model").where("k = n_conds").select("model", "ds")
    )
    s = pooled(tally.join(common, ["model", "ds"], "left_semi"), ["model", "cond"])
    w = Window.partitionBy("model")
    return s.withColumn("f1_range", F.max("f1").over(w) - F.min("f1").over(w))


def leave_one_out(matched: DataFrame, a: int, b: int) -> DataFrame:
    """Gain from a to b with each dataset held out: the totals less its own counts,
    so no dataset is ever paired with the others."""
    counts = ["tp", "fp", "fn"]
    per = matched.groupBy("model", "ds", "cond").agg(*[F.sum(c).alias(c) for c in counts])
    w = Window.partitionBy("model", "cond")
    totals = per.groupBy("model", "cond").agg(*[F.sum(c).alias(f"all_{c}") for c in counts])
    held = per.join(totals, ["model", "cond"]).select(
        "model", F.col("ds").alias("held_out"), "cond", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in counts]
    )
    return gain(with_prf(held.where("tp + fn > 0")), a, b, ["model", "held_out"])


def smallest_gain(loo: DataFrame) -> DataFrame:
    return loo.groupBy("model").agg(F.min("gain").alias("smallest_gain"), F.count(F.lit(1)).alias("n_held_out"))


def seed_spread(tally: DataFrame) -> DataFrame:
    """Smallest and largest F1 over seeds, on the datasets all seeds of the
    (model, cond) answered; needs two seeds."""
    by = ["model", "cond"]
    n = tally.groupBy(*by).agg(F.count_distinct("seed").alias("n_seeds")).where("n_seeds > 1")
    common = (
        tally.groupBy(*by, "ds").agg(F.count_distinct("seed").alias("k")).join(n, by).where("k = n_seeds").select(*by, "ds")
    )
    per = pooled(tally.join(common, by + ["ds"], "left_semi"), by + ["seed"]).where("tp + fn > 0")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), F.max("n_ds").alias("n_ds")
    ).where("n_seeds > 1").withColumn("spread", F.col("f1_max") - F.col("f1_min"))


def worst_case_gain(spread: DataFrame, a: int, b: int) -> DataFrame:
    """Worst seed of b against best seed of a."""
    return (
        spread.groupBy("model")
        .agg(F.max(F.when(F.col("cond") == a, F.col("f1_max"))).alias("best_a"), F.max(F.when(F.col("cond") == b, F.col("f1_min"))).alias("worst_b"))
        .where("best_a IS NOT NULL AND worst_b IS NOT NULL")
        .withColumn("worst_gain", F.col("worst_b") - F.col("best_a"))
    )


def burden(tally: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of columns a reviewer is asked to look at, and the recall it buys."""
    g = tally.groupBy(*(by or ["model", "cond"])).agg(
        (F.sum("tp") + F.sum("fp")).alias("flagged"),
        F.sum("n_cols").alias("n_columns"),
        ratio(F.sum("tp"), F.sum("n_pos")).alias("recall"),
    )
    return g.withColumn("burden", ratio(F.col("flagged"), F.col("n_columns")))


def ensemble(verdicts: DataFrame, truth: DataFrame, first: str, second: str) -> DataFrame:
    """Two raters alone, AND, OR, per condition, on cells both answered."""
    two = verdicts.where(F.col("model").isin(first, second))
    key = ["ds", "cond", "seed"]
    shared = two.groupBy(*key).agg(F.count_distinct("model").alias("k")).where("k = 2").drop("k")
    flagged = F.col("verdict") == "UNAVAILABLE"
    per = (
        two.join(shared, key, "left_semi")
        .groupBy(*key, "col")
        .agg(
            F.coalesce(F.bool_or(flagged & (F.col("model") == first)), F.lit(False)).alias("a"),
            F.coalesce(F.bool_or(flagged & (F.col("model") == second)), F.lit(False)).alias("b"),
        )
        .where("a OR b")
    )
    known = join_dim(per, truth.select("ds", "col", "is_pos"), ["ds", "col"])
    arms = {
        f"{first} alone": F.col("a"),
        f"{second} alone": F.col("b"),
        "AND": F.col("a") & F.col("b"),
        "OR": F.col("a") | F.col("b"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("arm"), v.alias("pred")) for k, v in arms.items()])
    counts = known.select("cond", "is_pos", F.explode(each).alias("e")).groupBy("cond", "e.arm").agg(
        F.count_if(F.col("e.pred") & F.col("is_pos")).alias("tp"), F.count_if(F.col("e.pred") & ~F.col("is_pos")).alias("fp")
    )
    sizes = truth.groupBy("ds").agg(F.count_if("is_pos").alias("n_pos"))
    pos = shared.join(sizes, "ds").groupBy("cond").agg(F.sum("n_pos").alias("n_pos"))
    return with_prf(counts.join(pos, "cond").withColumn("fn", F.col("n_pos") - F.col("tp"))).drop("n_pos").where("tp + fp > 0")


def pass_judgments(verdicts: DataFrame, truth: DataFrame, passes: list[int], run: list[str]) -> DataFrame:
    """(run.., col, is_pos, v: flags per pass, k: how many flag) for the columns judged under every pass."""
    flag = F.col("verdict") == "UNAVAILABLE"
    per = (
        verdicts.where(F.col("cond").isin(passes))
        .groupBy(*run, "col")
        .agg(F.count_distinct("cond").alias("judged"), *[F.coalesce(F.bool_or(flag & (F.col("cond") == p)), F.lit(False)).alias(f"p{p}") for p in passes])
        .where(F.col("judged") == len(passes))
        .drop("judged")
    )
    k = sum((F.col(f"p{p}").cast("int") for p in passes), F.lit(0))
    known = join_dim(per, truth.select("ds", "col", "is_pos"), ["ds", "col"], "left")
    return known.withColumns({"is_pos": F.coalesce("is_pos", F.lit(False)), "k": k})


def policies(judged: DataFrame, passes: list[int]) -> DataFrame:
    """Each pass alone and the consensus policies, against the first pass."""
    rules = {f"single C{p}": F.col(f"p{p}") for p in passes}
    n = len(passes)
    rules |= {"union": F.col("k") >= 1} | {f"{i} of {n}": F.col("k") >= i for i in range(2, n)} | {"unanimous": F.col("k") == n}
    each = F.array(*[F.struct(F.lit(name).alias("policy"), r.alias("pred")) for name, r in rules.items()])
    long = judged.groupBy("is_pos", "k", *[f"p{p}" for p in passes]).agg(F.count(F.lit(1)).alias("n"))
    c = long.select("is_pos", "n", F.explode(each).alias("e")).groupBy("e.policy").agg(
        F.coalesce(F.sum(F.when(F.col("e.pred") & F.col("is_pos"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("e.pred") & ~F.col("is_pos"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("e.pred") & F.col("is_pos"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    scored = with_prf(c)
    base = scored.where(F.col("policy") == f"single C{passes[0]}").select("f1").scalar()
    return scored.withColumn("delta", F.col("f1") - base)


def routing(judged: DataFrame, n_passes: int) -> DataFrame:
    """drop (all passes flag), review (some), keep (none): columns, leaks, precision,
    and over all buckets the reach, burden and missed share."""
    bucket = F.when(F.col("k") == n_passes, "drop").when(F.col("k") > 0, "review").otherwise("keep")
    per = judged.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("columns"), F.count_if("is_pos").alias("leaks"))
    w = Window.partitionBy(F.lit(1))
    return per.select(
        "bucket",
        "columns",
        "leaks",
        F.when(F.col("bucket") != "keep", ratio(F.col("leaks"), F.col("columns"))).alias("precision"),
        ratio(F.sum(F.when(F.col("bucket") != "keep", F.col("leaks"))).over(w), F.sum("leaks").over(w)).alias("reach"),
        ratio(F.sum(F.when(F.col("bucket") == "review", F.col("columns"))).over(w), F.sum("columns").over(w)).alias("burden"),
        ratio(F.sum(F.when(F.col("bucket") == "keep", F.col("leaks"))).over(w), F.sum("leaks").over(w)).alias("missed"),
    )


def rename_decrement(original: DataFrame, aliased: DataFrame) -> DataFrame:
    """F1 on original names less F1 on aliases over identical cells: a cell whose
    join failed in either arm leaves both."""
    key = ["model", "ds", "seed", "cond"]
    lost = ["model", "ds", "cond"]
    bad = original.where("n_matched = 0").select(*lost).unionByName(aliased.where("n_matched = 0").select(*lost)).distinct()
    shared = original.select(*key).join(aliased.select(*key), key, "left_semi").join(bad, lost, "left_anti")
    arms = [
        pooled(t.join(shared, key, "left_semi"), ["model", "cond"]).select("model", "cond", F.col("f1").alias(n), F.col("n_ds").alias(f"ds_{n}"))
        for t, n in ((original, "f1_original"), (aliased, "f1_alias"))
    ]
    return arms[0].join(arms[1].drop("ds_f1_alias"), ["model", "cond"]).select(
        "model", "cond", "f1_original", "f1_alias", (F.col("f1_original") - F.col("f1_alias")).alias("decrement"), F.col("ds_f1_original").alias("n_ds")
    )


def without_datasets(tally: DataFrame, drop: list[str]) -> DataFrame:
    """Pooled F1 with and without the listed datasets."""
    a = pooled(tally, ["model", "cond"]).select("model", "cond", F.col("f1").alias("f1_all"))
    b = pooled(tally.where(~F.col("ds").isin(drop)), ["model", "cond"]).select("model", "cond", F.col("f1").alias("f1_kept"))
    return a.join(b, ["model", "cond"]).withColumn("delta", F.col("f1_kept") - F.col("f1_all"))


def override_truth(truth: DataFrame, overrides: DataFrame) -> DataFrame:
    """Truth with the listed columns recoded (``is_pos`` of ``overrides`` wins)."""
    o = overrides.select("ds", "col", F.col("is_pos").alias("_new"))
    return join_dim(truth, o, ["ds", "col"], "left").withColumn("is_pos", F.coalesce("_new", "is_pos")).drop("_new")


def hardest(verdicts: DataFrame, truth: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The k most-missed positives and the k most-flagged negatives."""
    flags = verdicts.where("verdict = 'UNAVAILABLE'").groupBy("ds", "col").agg(F.count(F.lit(1)).alias("flagged"))
    n = cells.groupBy("ds").agg(F.count(F.lit(1)).alias("n_cells"))
    known = truth.join(n, "ds").join(flags, ["ds", "col"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(0).cast("long")))
    miss = known.where("is_pos").select(F.lit("missed").alias("what"), "ds", "col", (F.col("n_cells") - F.col("flagged")).alias("times"))
    false = known.where("NOT is_pos").select(F.lit("flagged").alias("what"), "ds", "col", F.col("flagged").alias("times"))

    def top(df):
        return df.where("times > 0").orderBy(F.desc("times"), "ds", "col").limit(k)

    return top(miss).unionByName(top(false))


def blind_hits(verdicts: DataFrame, blind: DataFrame) -> DataFrame:
    """Flags on a named subset of columns, per model and condition."""
    rows = join_dim(verdicts, blind.select("ds", "col"), ["ds", "col"], "left_semi")
    return rows.groupBy("model", "cond").agg(
        F.count_if(F.col("verdict") == "UNAVAILABLE").alias("hits"), F.count(F.lit(1)).alias("asked")
    )


def hit_grid(tally: DataFrame, conds: list[int]) -> DataFrame:
    """(model, ds) x condition: HIT, hits of positives or miss, with false positives."""
    per = tally.groupBy("model", "ds", "cond").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "n_pos")])
    cell = F.concat(
        F.when(F.col("tp") == F.col("n_pos"), F.lit("HIT")).when(F.col("tp") == 0, F.lit("miss")).otherwise(F.concat_ws("/", F.col("tp").cast("string"), F.col("n_pos").cast("string"))),
        F.lit(" fp"),
        F.col("fp").cast("string"),
    )
    grid = per.groupBy("model", "ds").pivot("cond", conds).agg(F.first(cell))
    return grid.select("model", "ds", *[F.coalesce(F.col(str(c)), F.lit("-")).alias(f"c{c}") for c in conds])


def tier_means(gains: DataFrame, tiers: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Mean gain per tier: all models, complete rosters, all but the single worst."""
    w = Window.partitionBy("tier").orderBy("gain", "model")
    j = (
        gains.join(tiers, "model")
        .join(incomplete.select("model", F.lit(True).alias("_bad")), "model", "left")
        .withColumn("rn", F.row_number().over(w))
    )
    return j.groupBy("tier").agg(
        F.avg("gain").alias("mean_gain"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("_bad").isNull(), F.col("gain"))).alias("mean_complete"),
        F.avg(F.when(F.col("rn") > 1, F.col("gain"))).alias("mean_without_worst"),
    )


def lexical_score(named: DataFrame, by: list[str]) -> DataFrame:
    """Frozen and tuned name rules per stratum, with the misses by mechanism."""
    each = F.array(
        F.struct(F.lit("B1").alias("variant"), F.col("frozen").alias("pred")),
        F.struct(F.lit("B1-tuned").alias("variant"), F.col("tuned").alias("pred")),
    )
    long = named.select(*by, "is_pos", "subtype", F.explode(each).alias("e"))
    out = prf(long, F.col("is_pos"), F.col("e.pred"), by + [F.col("e.variant").alias("variant")])
    miss = long.where("is_pos AND NOT e.pred").groupBy(*by, "e.variant").agg(
        *[F.count_if(F.coalesce(F.col("subtype"), F.lit("?")) == s).alias(f"miss_{s.lower()}") for s in ("REASON", "CONSEQUENCE", "TIMING")]
    )
    return out.join(miss, by + ["variant"], "left").fillna(0, [c for c in miss.columns if c.startswith("miss_")])


def recalled_names(answers: DataFrame, truth: DataFrame, text: str = "text") -> DataFrame:
    """Column names reproduced from memory: per dataset, overall and among positives.
    Failed answers are left out of the rates and counted."""
    said = (
        answers.where("error IS NULL")
        .select("ds", F.explode(F.split(text, r"[,\n]")).alias("name"))
        .select("ds", F.lower(F.trim("name")).alias("name"))
        .where("name <> ''")
        .distinct()
    )
    ok = answers.groupBy("ds").agg(F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    hits = truth.withColumn("name", F.lower("col")).join(said.withColumn("hit", F.lit(True)), ["ds", "name"], "left")
    per = hits.groupBy("ds").agg(
        F.count_if("hit").alias("recalled"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_pos") & F.col("hit")).alias("pos_recalled"),
        F.count_if("is_pos").alias("n_pos"),
    )
    live = F.col("answered") > 0
    out = ok.join(per, "ds").select(
        "ds",
        "errors",
        *[F.when(live, F.col(c)).otherwise(0).alias(c) for c in ("recalled", "n", "pos_recalled", "n_pos")],
    )
    return out.withColumns({"rate": ratio(F.col("recalled"), F.col("n")), "pos_rate": ratio(F.col("pos_recalled"), F.col("n_pos"))})


CSV_LINE = r"^[^\s,]*(,[^,]*){3,}$"


def row_match(pairs: DataFrame, true: str = "true", got: str = "got") -> DataFrame:
    """Was a data row reproduced: exact on the first len(true) characters, and the
    edit-distance similarity. The answer is the last line that looks like CSV;
    without one the whole text is taken and the row is marked."""
    lines = F.transform(F.split(F.coalesce(F.col(got), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^`+|`+$", "")))
    hits = F.filter(lines, lambda x: x.rlike(CSV_LINE))
    t = F.trim(F.col(true))
    answer = F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise(F.trim(F.coalesce(F.col(got), F.lit(""))))
    out = pairs.withColumns({"_t": t, "_a": answer, "mined": F.size(hits) > 0})
    out = out.withColumn("_a", F.expr("left(_a, length(_t))"))
    longest = F.greatest(F.length("_t"), F.length("_a"))
    return out.withColumns(
        {
            "exact": (F.length("_t") > 0) & (F.col("_t") == F.col("_a")),
            "similarity": F.when(F.length("_t") > 0, 1 - ratio(F.levenshtein("_t", "_a"), longest)).otherwise(0.0),
        }
    ).drop("_t", "_a")
