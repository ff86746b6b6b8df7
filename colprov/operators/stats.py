"""Uncertainty and agreement: McNemar, cluster bootstrap, kappas, relabelling.

Every resampling works on counts: a draw of the bootstrap touches one row per
dataset, a relabelling one row per flipped label and model, never the verdicts.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.functions.joins import SALTS, join_dim
from colprov.functions.ranks import dense_codes
from colprov.functions.special import binomial_two_sided, ratio, t_two_sided
from colprov.operators.score import count_if
from colprov.session import cut

# ---------------------------------------------------------------- McNemar


def mcnemar(right: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """b = a right and b wrong, c = the reverse, exact two-sided p."""
    g = right.groupBy(*by).agg(
        count_if(F.col(a) & ~F.col(b)).alias("b"), count_if(F.col(b) & ~F.col(a)).alias("c")
    )
    return g.withColumn("p", binomial_two_sided(F.least("b", "c"), F.col("b") + F.col("c")))


def mcnemar_conditions(verdicts: DataFrame, truth: DataFrame, cells: DataFrame, a: int, b: int) -> DataFrame:
    """McNemar of two conditions per model over matched cells. A column flagged in
    both or in neither is no discordant pair, so unanswered columns need no rows."""
    key = ["model", "ds", "seed"]
    flags = verdicts.where("verdict = 'UNAVAILABLE'").join(cells.select("model", "ds", "cond", "seed"), ["model", "ds", "cond", "seed"], "left_semi")
    per = flags.groupBy(*key, "col").agg(
        F.bool_or(F.col("cond") == a).alias("fa"), F.bool_or(F.col("cond") == b).alias("fb")
    ).where("fa <> fb")
    known = join_dim(per, truth.select("ds", "col", "is_pos"), ["ds", "col"])
    out = known.select("model", (F.col("fa") == F.col("is_pos")).alias("right_a"), (F.col("fb") == F.col("is_pos")).alias("right_b"))
    counts = mcnemar(out, "right_a", "right_b", ["model"])
    every = cells.select("model").distinct()
    return every.join(counts, "model", "left").select(
        "model", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("p", F.lit(1.0)).alias("p")
    )


# ---------------------------------------------------------- cluster bootstrap


def hashed_pick(draw: Column, slot: Column, n: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(draw, slot, F.lit(seed)), n)


def digest_order(draw: Column, slot: Column) -> Column:
    """32 bits of md5 over draw and slot: uniform, and another engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", draw.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long")


def digest_pick(draw: Column, slot: Column, n: Column) -> Column:
    return digest_order(draw, slot) % n


def cluster_bootstrap(
    matched: DataFrame, a: int, b: int, draws: int = 2000, pick: Callable[[Column, Column, Column], Column] = hashed_pick
) -> DataFrame:
    """95% interval of F1(b) - F1(a) per model, resampling whole datasets.

    Percentiles are taken by index int(.025 n), int(.975 n). Draws without a
    positive have no F1 and are left out. Models need two datasets.
    """
    counts = ["tp", "fp", "fn"]
    per = matched.groupBy("model", "ds").agg(
        *[F.coalesce(F.sum(F.when(F.col("cond") == c, F.col(x))), F.lit(0)).alias(f"{x}_{c}") for c in (a, b) for x in counts]
    )
    # one short row per dataset, read four times below
    per = cut(dense_codes(cut(per), ["model"], ["ds"], "slot"))
    n = per.groupBy("model").agg(F.count(F.lit(1)).alias("n_ds")).where("n_ds > 1")
    slots = per.select("model", "slot").join(n, "model")
    drawn = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
        "model", "draw", "n_ds", pick(F.col("draw").cast("long"), F.col("slot"), F.col("n_ds")).alias("slot")
    )
    # equal picks of a draw fold before the join
    folded = drawn.groupBy("model", "draw", "n_ds", "slot").agg(F.count(F.lit(1)).alias("k"))
    sums = (
        folded.join(per.drop("ds"), ["model", "slot"])
        .groupBy("model", "draw", "n_ds")
        .agg(*[F.sum(F.col("k") * F.col(f"{x}_{c}")).alias(f"{x}_{c}") for c in (a, b) for x in counts])
    )

    def f1(c):
        tp, fp, fn = (F.col(f"{x}_{c}") for x in counts)
        return F.when(tp + fn > 0, ratio(2 * tp, 2 * tp + fp + fn))

    deltas = sums.withColumn("delta", f1(b) - f1(a)).where("delta IS NOT NULL")
    g = deltas.groupBy("model", "n_ds").agg(F.sort_array(F.collect_list("delta")).alias("d"))
    m = F.size("d")
    return g.select(
        "model",
        F.element_at("d", (F.floor(0.025 * m) + 1).cast("int")).alias("lo"),
        F.element_at("d", F.least(m, F.floor(0.975 * m) + 1).cast("int")).alias("hi"),
        "n_ds",
        m.cast("long").alias("n_draws"),
    )


# -------------------------------------------------------- paired differences


def paired_delta(rates: DataFrame, clean: str, leak: str, by: list[str] | None = None, scale: float = 100.0) -> DataFrame:
    """Mean difference over partitions with its 95% interval, paired t-test and the
    three-way verdict (p < .05 decides, then the sign)."""
    d = (F.col(leak) - F.col(clean)) * scale
    g = rates.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = F.try_divide(F.col("mean"), se)
    out = g.withColumns({"lo": F.col("mean") - 1.96 * se, "hi": F.col("mean") + 1.96 * se})
    out = out.withColumn("p", F.when(F.col("n") < 2, F.lit(None)).when(t.isNull(), F.lit(1.0)).otherwise(t_two_sided(t, F.col("n") - 1)))
    return out.withColumn(
        "verdict", F.when(F.col("p") >= 0.05, "no change").when(F.col("mean") > 0, "degrades").otherwise("improves")
    )


def pair_rates(df: DataFrame, y: str, pred: str, marked: str, pair: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Of the true members of the pair: sent to the marked class (escaped), kept on
    the axis, and of those wrong. The label must have exactly these three classes."""
    classes = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    ok = classes.agg(F.coalesce(F.bool_and(F.col(y).isin(marked, *pair)), F.lit(False)) & (F.count(F.lit(1)) == 3)).scalar()
    inside = F.col(y).isin(*pair)
    kept = inside & (F.col(pred) != marked)
    g = df.groupBy(*(by or [])).agg(
        count_if(inside & (F.col(pred) == marked)).alias("escaped"),
        count_if(kept).alias("kept"),
        count_if(kept & (F.col(pred) != F.col(y))).alias("wrong"),
    )
    checked = F.when(ok, F.col("wrong")).otherwise(F.raise_error(F.lit("the matched denominator needs exactly three classes")))
    return g.withColumn("wrong", checked.cast("long")).withColumn("rate", F.col("wrong") / F.greatest("kept", F.lit(1)))


def pair_common(df: DataFrame, y: str, clean: str, leak: str, marked: str, pair: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Both arms on the members both kept on the axis, with the discordant counts."""
    c, f = F.col(clean), F.col(leak)
    common = F.col(y).isin(*pair) & (c != marked) & (f != marked)
    ok_c, ok_f = c == F.col(y), f == F.col(y)
    return df.groupBy(*(by or [])).agg(
        count_if(common).alias("common"),
        count_if(common & ~ok_c).alias("wrong_clean"),
        count_if(common & ~ok_f).alias("wrong_leak"),
        count_if(common & ok_c & ~ok_f).alias("broke"),
        count_if(common & ~ok_c & ok_f).alias("fixed"),
    )


def object_level(common: DataFrame) -> DataFrame:
    """Median over partitions of (b-c)/n and its interval, McNemar per partition and
    the share of partitions where it is significant. One row per partition comes in."""
    n = F.col("common").cast("double")
    delta = (F.col("broke") - F.col("fixed")) / n
    se = F.sqrt((F.col("broke") + F.col("fixed")).cast("double")) / n
    p = binomial_two_sided(F.least("broke", "fixed"), F.col("broke") + F.col("fixed"))
    per = common.select(delta.alias("d"), (delta - 1.96 * se).alias("l"), (delta + 1.96 * se).alias("h"), p.alias("p"))
    return per.agg(
        F.median("d").alias("delta"),
        F.median("l").alias("lo"),
        F.median("h").alias("hi"),
        F.median("p").alias("p_median"),
        count_if(F.col("p") < 0.05).alias("n_significant"),
        F.count(F.lit(1)).alias("n_partitions"),
    )


# ----------------------------------------------------------------- agreement

BANDS = [(0.0, "poor"), (0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial")]


def band(k: Column) -> Column:
    out = F.when(k.isNull() | F.isnan(k), "undefined")
    for limit, name in BANDS:
        out = out.when(k <= limit, name)
    return out.otherwise("almost perfect")


def cohen(cells: DataFrame, a: str, b: str, n: str, by: list[str], degenerate: float | None = 1.0) -> DataFrame:
    """Raw agreement and Cohen's kappa from contingency counts (by.., a, b, n).
    When chance agreement is total kappa is ``degenerate`` (1, or None for undefined)."""
    whole = cells.groupBy(*by).agg(F.sum(n).alias("N"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col(n))), F.lit(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("_k")).agg(F.sum(n).alias("_l"))
    right = cells.groupBy(*by, F.col(b).alias("_k")).agg(F.sum(n).alias("_r"))
    chance = left.join(right, by + ["_k"]).groupBy(*by).agg(F.sum(F.col("_l") * F.col("_r")).alias("chance")) if by else (
        left.join(right, "_k").agg(F.sum(F.col("_l") * F.col("_r")).alias("chance"))
    )
    j = whole.join(chance, by, "left") if by else whole.withColumn("chance", chance.scalar())
    pe = F.coalesce("chance", F.lit(0)) / (F.col("N") * F.col("N"))
    po = F.col("same") / F.col("N")
    return j.select(
        *by,
        F.col("N").alias("n"),
        po.alias("raw"),
        F.when(pe >= 1, F.lit(degenerate).cast("double")).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"),
    )


def fleiss(ratings: DataFrame, item: list[str], category: str, n_raters: int, by: list[str] | None = None) -> DataFrame:
    """Fleiss' kappa and unanimity over items every one of ``n_raters`` rated."""
    by = by or []
    cells = ratings.groupBy(*by, *item, category).agg(F.count(F.lit(1)).alias("v"))
    per = cells.groupBy(*by, *item).agg(F.sum("v").alias("r"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.max("v").alias("top")).where(
        F.col("r") == n_raters
    )
    kept = cells.join(per.select(*by, *item), by + item, "left_semi")
    p_j = kept.groupBy(*by, category).agg(F.sum("v").alias("v"))
    r = float(n_raters)
    items = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg((F.col("sq") - r) / (r * (r - 1))).alias("p_bar"),
        F.avg((F.col("top") == n_raters).cast("double")).alias("unanimous"),
    )
    squares = p_j.groupBy(*by).agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("s"))
    j = items.join(squares, by) if by else items.withColumn("s", squares.scalar())
    pe = F.col("s") / F.pow(F.col("n_items") * r, F.lit(2))
    return j.select(*by, "n_items", "unanimous", F.when(pe < 1, (F.col("p_bar") - pe) / (1 - pe)).alias("kappa"))


def coder_pairs(answers: DataFrame, item: list[str], coder: str, category: str, subsets: dict[str, Column]) -> DataFrame:
    """Pairwise agreement of coders on each nested subset of items.

    Each item is answered by a handful of coders; its answers meet in one small map
    and only the coder pairs of that map are emitted.
    """
    flags = F.array(*[F.struct(F.lit(k).alias("subset"), F.coalesce(v, F.lit(False)).alias("in")) for k, v in subsets.items()])
    rows = answers.select(*item, coder, category, F.explode(flags).alias("f")).where("f.in").select("f.subset", *item, coder, category)
    per = rows.groupBy("subset", *item).agg(F.array_sort(F.collect_list(F.struct(F.col(coder).alias("c"), F.col(category).alias("k")))).alias("a"))
    paired = per.select(
        "subset",
        F.explode(
            F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b"), x["k"].alias("ka"), y["k"].alias("kb")))))
        ).alias("p"),
    )
    cells = paired.groupBy("subset", "p.a", "p.b", "p.ka", "p.kb").agg(F.count(F.lit(1)).alias("n"))
    out = cohen(cells, "ka", "kb", "n", ["subset", "a", "b"], degenerate=None)
    return out.withColumn("band", band(F.col("kappa")))


def category_agreement(answers: DataFrame, reference: DataFrame, item: list[str], coder: str, category: str) -> DataFrame:
    """Per reference category and coder: how many items the coder put there too."""
    j = answers.join(reference.select(*item, F.col(category).alias("ref")), item)
    return j.groupBy("ref", coder).agg(
        count_if(F.col(category) == F.col("ref")).alias("hit"), F.count(F.lit(1)).alias("n")
    ).withColumn("agreement", F.col("hit") / F.col("n"))


def disputes(answers: DataFrame, reference: DataFrame, item: list[str], category: str) -> DataFrame:
    """Items where a coder leaves the reference category or denies the licence."""
    j = answers.join(reference.select(*item, F.col(category).alias("ref")), item)
    return j.where((F.col(category) != F.col("ref")) | ~F.col("licensed")).withColumn(
        "dispute", F.when(~F.col("licensed"), "licence").otherwise("category")
    )


def source_agreement(records: DataFrame, salts: int = SALTS) -> DataFrame:
    """Do independent sources name the same columns: kappa, Jaccard, only-A, only-B
    per pair of sources of a dataset. Pairs of different scope are skipped with the
    reason: their silence does not answer the same question.

    Counts come from sources that meet on a (dataset, column) they both name, lists from the
    pairs' own columns; a dataset or a column with very many sources is dealt over ``salts`` tasks.
    """
    universe = records.groupBy("dataset_id").agg(F.count_distinct("column").alias("universe"))
    scopes = records.groupBy("dataset_id", "source_citation").agg(F.max("scope").alias("scope"))
    named = records.where("label = 'LABEL_DERIVED'").select("dataset_id", F.col("source_citation").alias("src"), F.col("column").alias("col")).distinct()
    named = cut(named)
    size = named.groupBy("dataset_id", "src").agg(F.count("col").alias("n")).join(scopes.withColumnRenamed("source_citation", "src"), ["dataset_id", "src"])

    def meet(df: DataFrame, on: list[str]) -> DataFrame:
        """Rows a < b that agree on ``on``, each unordered pair once."""
        rest = [c for c in df.columns if c not in on]
        left = df.select(*on, *[F.col(c).alias(f"{c}_a") for c in rest], F.pmod(F.xxhash64("src"), F.lit(salts)).cast("int").alias("_salt"))
        right = df.select(*on, *[F.col(c).alias(f"{c}_b") for c in rest], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        return left.join(right, [*on, "_salt"]).where("src_a < src_b").drop("_salt")

    pair = ["dataset_id", "src_a", "src_b"]
    pairs = cut(meet(size, ["dataset_id"]))
    both = meet(named, ["dataset_id", "col"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("both"))

    def only(own: str, other: str, name: str) -> DataFrame:
        own_cols = pairs.where("scope_a = scope_b").select(*pair).join(named.withColumnRenamed("src", own), ["dataset_id", own])
        alone = own_cols.join(named.withColumnRenamed("src", other), ["dataset_id", other, "col"], "left_anti")
        return alone.groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_list("col")), ",").alias(name))

    j = pairs.join(both, pair, "left").join(universe, "dataset_id")
    for own, other, name in (("src_a", "src_b", "only_a"), ("src_b", "src_a", "only_b")):
        j = j.join(only(own, other, name), pair, "left")
    n = F.col("universe").cast("double")
    inter, na, nb = F.coalesce("both", F.lit(0)), F.col("n_a"), F.col("n_b")
    po = (inter + (n - (na + nb - inter))) / n
    pe = (na / n) * (nb / n) + ((n - na) / n) * ((n - nb) / n)
    same = F.col("scope_a") == F.col("scope_b")
    return j.select(
        "dataset_id",
        F.col("src_a").alias("a"),
        F.col("src_b").alias("b"),
        F.when(same, F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))).alias("kappa"),
        F.when(same, ratio(inter, na + nb - inter)).alias("jaccard"),
        *[F.when(same, F.coalesce(c, F.lit(""))).alias(c) for c in ("only_a", "only_b")],
        F.when(~same, "scope mismatch -- silence is not comparable").alias("skipped"),
    )


# ----------------------------------------------------- relabelling sensitivity

REASON, CONSEQUENCE = "REASON", "CONSEQUENCE"


def recall_tallies(verdicts: DataFrame, truth: DataFrame, cells: DataFrame, cond: int) -> DataFrame:
    """(model, ds, col, subtype, h, n) at one condition for the positives on the
    REASON / CONSEQUENCE boundary."""
    edge = truth.where("is_pos").where(F.col("subtype").isin(REASON, CONSEQUENCE)).select("ds", "col", "subtype")
    asked = cells.where(F.col("cond") == cond).groupBy("model", "ds").agg(F.count(F.lit(1)).alias("n"))
    flags = (
        verdicts.where((F.col("cond") == cond) & (F.col("verdict") == "UNAVAILABLE"))
        .join(cells.select("model", "ds", "cond", "seed"), ["model", "ds", "cond", "seed"], "left_semi")
        .groupBy("model", "ds", "col")
        .agg(F.count(F.lit(1)).alias("h"))
    )
    return (
        edge.join(asked, "ds").join(flags, ["model", "ds", "col"], "left").select("model", "ds", "col", "subtype", F.coalesce("h", F.lit(0)).alias("h"), "n")
    )


def gap_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """Mean over models of CONSEQUENCE recall less REASON recall from rh, rn, ch, cn."""
    return sums.groupBy(*by).agg(
        (F.avg(F.when(F.col("cn") > 0, F.col("ch") / F.col("cn"))) - F.avg(F.when(F.col("rn") > 0, F.col("rh") / F.col("rn")))).alias("gap")
    )


def base_sums(tallies: DataFrame) -> DataFrame:
    r, c = F.col("subtype") == REASON, F.col("subtype") == CONSEQUENCE
    return tallies.groupBy("model").agg(
        *[F.coalesce(F.sum(F.when(k, F.col(x))), F.lit(0)).alias(f"{p}{x}") for p, k in (("r", r), ("c", c)) for x in ("h", "n")]
    )


def random_relabel(
    tallies: DataFrame, shares: list[float], draws: int = 2000, order: Callable[[Column, Column], Column] | None = None, seed: int = 0
) -> DataFrame:
    """Gap when a random share of the boundary labels is flipped: mean and 95% range
    over draws, one row per share. ``order(draw, slot)`` ranks the labels within a
    draw; every share flips the head of the same ranking. Draws that leave a side
    without labels have no gap and are left out of the range."""
    tallies = cut(tallies)
    items = cut(dense_codes(tallies.select("ds", "col").distinct(), [], ["ds", "col"], "slot"))
    n = items.agg(F.count(F.lit(1))).scalar()
    order = order or (lambda d, s: F.xxhash64(d, s, F.lit(seed)))
    each_share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    each_draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    k = F.greatest(F.lit(1), F.round(F.col("share") * F.col("_n")).cast("int"))
    ranked = items.withColumn("_n", n).withColumn("draw", each_draw).withColumn("_o", order(F.col("draw").cast("long"), F.col("slot")))
    places = dense_codes(ranked, ["draw"], ["_o", "slot"], "_rank").withColumn("share", each_share)
    flips = places.where(F.col("_rank") < k).select("share", "draw", "ds", "col")
    toward = F.when(F.col("subtype") == REASON, -1).otherwise(1)
    moved = flips.join(tallies, ["ds", "col"]).groupBy("share", "draw", "model").agg(
        F.sum(toward * F.col("h")).alias("dh"), F.sum(toward * F.col("n")).alias("dn")
    )
    models = base_sums(tallies).withColumn("draw", each_draw).withColumn("share", each_share)
    every = models.join(moved, ["share", "draw", "model"], "left")
    dh, dn = F.coalesce("dh", F.lit(0)), F.coalesce("dn", F.lit(0))
    sums = every.select(
        "share", "draw", "model",
        (F.col("rh") + dh).alias("rh"), (F.col("rn") + dn).alias("rn"), (F.col("ch") - dh).alias("ch"), (F.col("cn") - dn).alias("cn"),
    )
    gaps = gap_of(sums, ["share", "draw"]).groupBy("share")
    d = gaps.agg(F.avg("gap").alias("mean_gap"), F.sort_array(F.collect_list("gap")).alias("g"))
    m = F.size("g")
    return d.select(
        "share",
        "mean_gap",
        F.get("g", F.floor(0.025 * m).cast("int")).alias("lo"),
        F.get("g", F.least(m - 1, F.floor(0.975 * m).cast("int"))).alias("hi"),
    )


def greedy_relabel(tallies: DataFrame, k: int, pool: DataFrame | None = None) -> DataFrame:
    """The worst k flips, one round each: every candidate flip of the pool is scored
    in one aggregate and the one that lowers the gap most is taken. ``pool``
    restricts the adversary, for example to weakly evidenced labels.

    One row comes back to the driver per round.
    """
    spark = tallies.sparkSession
    items = tallies.withColumn("key", F.concat_ws(".", "ds", "col"))
    if pool is not None:
        items = items.join(pool.select("ds", "col").distinct().withColumn("open", F.lit(True)), ["ds", "col"], "left")
    else:
        items = items.withColumn("open", F.lit(True))
    items = cut(items.withColumn("open", F.coalesce("open", F.lit(False))))
    current = gap_of(base_sums(items), []).first()["gap"]
    steps = []
    flipped = F.col("subtype")
    for i in range(k):
        now = items.withColumn("subtype", flipped)
        sums = base_sums(now)
        toward = F.when(F.col("subtype") == REASON, -1).otherwise(1)
        cand = now.where("open").groupBy("key", "model").agg(F.sum(toward * F.col("h")).alias("dh"), F.sum(toward * F.col("n")).alias("dn"))
        # models without the candidate's dataset keep their sums
        whole = cand.join(sums, "model").select(
            "key", "model", (F.col("rh") + F.col("dh")).alias("rh"), (F.col("rn") + F.col("dn")).alias("rn"), (F.col("ch") - F.col("dh")).alias("ch"), (F.col("cn") - F.col("dn")).alias("cn"),
            ratio(F.col("rh"), F.col("rn")).alias("r0"), ratio(F.col("ch"), F.col("cn")).alias("c0"),
            F.col("rn").alias("rn0"), F.col("cn").alias("cn0"),
        )
        base = sums.agg(
            F.sum(ratio(F.col("rh"), F.col("rn"))).alias("r"), F.count_if(F.col("rn") > 0).alias("kr"),
            F.sum(ratio(F.col("ch"), F.col("cn"))).alias("c"), F.count_if(F.col("cn") > 0).alias("kc"),
        ).first()
        moved = whole.groupBy("key").agg(
            F.sum(ratio(F.col("rh"), F.col("rn")) - F.col("r0")).alias("dr"),
            (F.count_if(F.col("rn") > 0) - F.count_if(F.col("rn0") > 0)).alias("dkr"),
            F.sum(ratio(F.col("ch"), F.col("cn")) - F.col("c0")).alias("dc"),
            (F.count_if(F.col("cn") > 0) - F.count_if(F.col("cn0") > 0)).alias("dkc"),
        )
        scored = moved.select(
            "key",
            (
                ratio(F.lit(base["c"]) + F.col("dc"), F.lit(base["kc"]) + F.col("dkc"))
                - ratio(F.lit(base["r"]) + F.col("dr"), F.lit(base["kr"]) + F.col("dkr"))
            ).alias("gap"),
        )
        best = scored.agg(F.min_by(F.struct("key", "gap"), F.struct(F.round("gap", 12), F.col("key"))).alias("b")).first()["b"]
        if best is None or best["gap"] >= current:
            break
        current = best["gap"]
        steps.append((i + 1, best["key"], float(current)))
        flipped = relabelled(steps)
    return spark.createDataFrame(steps, "step int, flipped string, gap double")


def relabelled(steps: list) -> Column:
    """The subtype after an odd number of flips of a key is the other one."""
    odd = [k for k in {s[1] for s in steps} if sum(1 for s in steps if s[1] == k) % 2]
    other = F.when(F.col("subtype") == REASON, CONSEQUENCE).otherwise(REASON)
    return F.when(F.col("key").isin(odd), other).otherwise(F.col("subtype")) if odd else F.col("subtype")


# ------------------------------------------------------------- null subsets


def subset_at(columns: list[str], k: int, rank: int) -> list[str]:
    """The subset with number ``rank`` when all k-subsets stand in lexicographic order."""
    out: list[str] = []
    for i, name in enumerate(columns):
        if len(out) == k:
            break
        with_it = comb(len(columns) - i - 1, k - len(out) - 1)
        if rank < with_it:
            out.append(name)
        else:
            rank -= with_it
    return out


def reference_subsets(columns: list[str], k: int, most: int, seed: int = 0) -> list[list[str]]:
    """All k-subsets where there are at most ``most``, else that many different ones at random."""
    total = comb(len(columns), k)
    draw, places = random.Random(seed), set(range(total) if total <= most else ())
    while len(places) < min(total, most):
        places.add(draw.randrange(total))
    return [subset_at(columns, k, i) for i in sorted(places)]


def subset_z(f1s: DataFrame, floor: float = 0.01) -> DataFrame:
    """Per class z of the leaky subset against its own null, the spread floored;
    detected when it beats every null subset. ``f1s``: (subset, is_leak, y, f1)."""
    null = F.when(~F.col("is_leak"), F.col("f1"))
    g = f1s.groupBy("y").agg(
        F.max(F.when(F.col("is_leak"), F.col("f1"))).alias("leak_f1"),
        F.avg(null).alias("null_mean"),
        F.stddev_samp(null).alias("null_sd"),
        F.max(null).alias("null_max"),
        F.count(null).alias("n_null"),
    )
    return g.withColumns(
        {
            "z": (F.col("leak_f1") - F.col("null_mean")) / F.greatest(F.coalesce("null_sd", F.lit(0.0)), F.lit(floor)),
            "detected": F.col("leak_f1") > F.col("null_max"),
        }
    )


def partition_summary(pred: DataFrame, partition: str, y: str, p: str, arm: list[str] | None = None) -> DataFrame:
    """Per-class F1 and its spread over partitions, with accuracy and macro F1 as
    the classes ACCURACY and MACRO."""
    arm = arm or []
    cells = pred.groupBy(*arm, partition, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by = arm + [partition]
    tp = cells.where("y = p").groupBy(*by, "y").agg(F.sum("n").alias("tp"))
    sup = cells.groupBy(*by, "y").agg(F.sum("n").alias("sup"))
    said = cells.groupBy(*by, F.col("p").alias("y")).agg(F.sum("n").alias("said"))
    per = sup.join(said, by + ["y"], "left").join(tp, by + ["y"], "left").select(
        *by, "y", ratio(2 * F.coalesce("tp", F.lit(0)), F.col("sup") + F.coalesce("said", F.lit(0))).alias("v")
    )
    macro = per.groupBy(*by).agg(F.avg("v").alias("v")).select(*by, F.lit("MACRO").alias("y"), "v")
    acc = cells.groupBy(*by).agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("v")).select(
        *by, F.lit("ACCURACY").alias("y"), "v"
    )
    return per.unionByName(macro).unionByName(acc).groupBy(*arm, "y").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n_partitions")
    )
