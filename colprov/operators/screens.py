"""Statistical screens: how strongly does each column, alone, tell the label.

The unit is the column. A table is turned long, ``(keys.., col, v, y)``, and every
screen starts by collapsing it: the moments per (column, class) for correlation
and missingness, the distinct values per (column, value, class) for the AUC.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.ranks import bottom_rows, default_ranges, exact_median, with_range
from colprov.functions.special import normal_upper, ratio
from colprov.operators.score import count_if, prf, with_prf
from colprov.session import cut

KEYS = ["ds", "col"]

# ---- fixed values: wording that places a field at or after the outcome
MARKERS = [
    r"\bpost[- ]?charge",
    r"\bpost[- ]",
    r"\bafter\b",
    r"\bfollowing\b",
    r"\bsubsequent",
    r"\bfollow[- ]?up\b",
    r"\bcause of death\b",
    r"\bat discharge\b",
    r"\bdischarge\b",
    r"\boutcome\b",
    r"\brecover",
    r"\bcollection",
    r"\bsettle",
    r"\bfinal\b",
    r"\bresulted\b",
    r"\bclosed\b",
    r"\bterminated\b",
    r"\bwrite[- ]?off",
    r"\bcharged[- ]?off",
    r"\bdefault(ed)?\b",
    r"\bdeceased\b",
    r"\bexpired\b",
    r"\bsurviv",
    r"\blast payment\b",
    r"\bto date\b",
    r"\bso far\b",
    r"\bever\b",
]
# ---- fixed values: name patterns added with hindsight (an upper bound)
TUNED_EXTRA = [
    r"days?_to_",
    r"_outcome$",
    r"^outcome",
    r"^body$",
    r"^discharge",
    r"_flag$",
    r"^koi_fpflag",
    r"fpflag",
    r"_status$",
    r"^status",
    r"total_",
    r"_total$",
    r"^is_",
    r"_id$",
    r"recover",
    r"settle",
    r"charge_?off",
    r"writeoff",
    r"death|died|mort|expire|surviv|alive",
    r"readmi",
    r"relapse",
    r"cured|healed",
    r"^n_days$",
    r"_days$",
    r"duration",
    r"time_to",
    r"result",
    r"score$",
    r"grade$",
    r"class$",
    r"label$",
    r"target$",
    r"fault|failure|_fail",
    r"casual|registered",
]


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)


def name_pattern(patterns: list[str]) -> str:
    """The same patterns for column names: an underscore also ends a word."""
    return any_of([p.replace(r"\b", r"(?:\b|_)") for p in patterns])


def to_long(df: DataFrame, cols: list[str], label: str, ids: list[str]) -> DataFrame:
    """(ids.., y, col, v): one row per cell, values as double."""
    pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("double"))]
    return df.select(*ids, F.col(label).alias("y"), F.stack(F.lit(len(cols)), *pairs).alias("col", "v"))


# --------------------------------------------------------------- moments


def class_moments(df: DataFrame, cols: list[str], label: str, ids: list[str]) -> DataFrame:
    """Per (ids.., col, y): rows, nulls, mean, squared deviation and span of the values.

    The table is folded as it stands, all columns in one pass; only the few
    folded rows are turned long.
    """
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.count(v).alias("n_val"),
                F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
                F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"),
                F.min(v).alias("lo"),
                F.max(v).alias("hi"),
                F.count_if(v != 0).alias("n_nonzero"),
            ).alias(f"m{i}")
        )
    wide = df.groupBy(*ids, F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"m{i}").alias("m")) for i, c in enumerate(cols)])
    return wide.select(*ids, "y", "n", F.explode(each).alias("e")).select(*ids, "e.col", "y", "n", "e.m.*")


def filled(moments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The moments as they would be with every null set to the column's ``median``."""
    med = F.coalesce("median", F.lit(0.0))
    k = F.col("n") - F.col("n_val")
    mean = ratio(F.col("mean") * F.col("n_val") + med * k, F.col("n"))
    m2 = F.col("m2") + ratio(F.col("n_val") * k, F.col("n")) * F.pow(F.col("mean") - med, F.lit(2))
    return moments.select(
        *keys,
        "y",
        "n",
        "n_val",
        mean.alias("mean"),
        m2.alias("m2"),
        F.when(k > 0, F.least("lo", med)).otherwise(F.col("lo")).alias("lo"),
        F.when(k > 0, F.greatest("hi", med)).otherwise(F.col("hi")).alias("hi"),
    )


def class_association(moments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """|covariance| and |correlation| of each column with each class indicator;
    0 for a column or class that does not vary."""
    w = Window.partitionBy(*keys)
    t = moments.select("*", F.sum("n").over(w).alias("rows")).withColumn(
        "mu", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("rows")
    )
    t = t.withColumns(
        {
            "total_m2": F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("mu"), F.lit(2))).over(w),
            "live": F.min("lo").over(w) < F.max("hi").over(w),
        }
    )
    lift = F.col("n") * F.abs(F.col("mean") - F.col("mu"))
    spread = F.sqrt(F.col("total_m2") * F.col("n") * (1 - F.col("n") / F.col("rows")))
    return t.select(
        *keys,
        "y",
        "n",
        F.when(F.col("live"), ratio(lift, F.col("rows") - 1)).otherwise(0.0).alias("cov"),
        F.when(F.col("live"), ratio(lift, spread)).otherwise(0.0).alias("cor"),
    )


def missing_asymmetry(moments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Range over classes of the null rate; 0 unless both nulls and values occur."""
    rate = (F.col("n") - F.col("n_val")) / F.col("n")
    both = (F.sum("n_val") > 0) & (F.sum("n_val") < F.sum("n"))
    return moments.groupBy(*keys).agg(F.when(both, F.max(rate) - F.min(rate)).otherwise(0.0).alias("miss"))


# ------------------------------------------------------------------- AUC


def value_counts(long: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return long.groupBy(*keys, "v", "y").agg(F.count(F.lit(1)).alias("n"))


def rank_sums(counts: DataFrame, keys: list[str] = KEYS, sample: DataFrame | None = None) -> DataFrame:
    """Per (keys, y): rows ``n`` and the sum of their average ranks within the key.

    ``counts`` holds (keys, v, y, n) without null v. Ranks are taken inside
    contiguous ranges of values and shifted by the rows in earlier ranges.
    """
    b = with_range(counts, keys + ["v"], sample=sample)
    upto = Window.partitionBy("_range", *keys).orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_range", *keys, "v")
    ranked = b.select(
        "_range",
        *keys,
        "v",
        "y",
        "n",
        (F.sum("n").over(upto) - (F.sum("n").over(same) - 1) / 2.0).alias("_rank"),
    )
    part = ranked.groupBy("_range", *keys, "y").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("_rank")).alias("_s"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    return (
        part.withColumn("_off", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .groupBy(*keys, "y")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("_s") + F.col("n") * F.col("_off")).alias("rank_sum"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )


def class_auc(counts: DataFrame, keys: list[str] = KEYS, sample: DataFrame | None = None) -> DataFrame:
    """One-vs-rest AUC per (keys, y) from average ranks; null with one class only."""
    w = Window.partitionBy(*keys)
    s = rank_sums(counts, keys, sample).withColumn("_rows", F.sum("n").over(w))
    neg = F.col("_rows") - F.col("n")
    u = F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2.0
    return s.select(*keys, "y", "n", "lo", "hi", F.try_divide(u, (F.col("n") * neg).cast("double")).alias("auc"))


def medians(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """The exact median of each column; reads no other columns."""
    pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("double"))]
    long = df.select(*ids, F.stack(F.lit(len(cols)), *pairs).alias("col", "v"))
    return exact_median(long, ids + ["col"], "v")


def column_moments(
    df: DataFrame, cols: list[str], label: str, ids: list[str], impute: list[str] | None = None
) -> DataFrame:
    """``class_moments`` with the ``median`` of the columns that hold nulls (among
    ``impute``, default all).

    The moments, a few rows per column, are kept by a checkpoint, since several
    screens read them. They tell which columns need a median at all; their names are
    what comes back to the driver.
    """
    m = cut(class_moments(df, cols, label, ids))
    holes = {r["col"] for r in m.where("n_val < n").select("col").distinct().collect()}
    need = [c for c in (cols if impute is None else impute) if c in holes]
    if not need:
        return m.withColumn("median", F.lit(None).cast("double"))
    return cut(m.join(medians(df, need, ids), ids + ["col"], "left"))


def filled_counts(df: DataFrame, cols: list[str], label: str, ids: list[str], moments: DataFrame) -> DataFrame:
    """(keys, v, y, n) with every null counted at its column's median.

    The nulls arrive as a handful of extra rows, so the value counts themselves
    are never joined to anything.
    """
    counts = value_counts(to_long(df, cols, label, ids).where(F.col("v").isNotNull()), ids + ["col"])
    nulls = moments.where((F.col("n") > F.col("n_val")) & F.col("median").isNotNull())
    return counts.unionByName(
        nulls.select(*ids, "col", F.col("median").alias("v"), "y", (F.col("n") - F.col("n_val")).alias("n"))
    )


def auc_from(
    df: DataFrame, cols: list[str], label: str, ids: list[str], moments: DataFrame, flat: float = 0.0, counts: DataFrame | None = None
) -> DataFrame:
    """max over classes of |auc - .5| + .5 given ``column_moments``; ``flat`` for a
    column that does not vary. ``counts`` from an earlier ``filled_counts`` saves its scan."""
    keys = ids + ["col"]
    if counts is None:
        rows = max(1, math.ceil(2 * default_ranges(df) / len(cols)))
        sample = to_long(bottom_rows(df.select(*ids, label, *cols), rows), cols, label, ids)
        best = class_auc(filled_counts(df, cols, label, ids, moments), keys, sample)
    else:
        best = class_auc(counts, keys)
    return best.groupBy(*keys).agg(
        F.when(F.min("lo") < F.max("hi"), F.coalesce(F.max(F.abs(F.col("auc") - 0.5) + 0.5), F.lit(flat)))
        .otherwise(F.lit(flat))
        .alias("auc")
    )


def auc_screen(
    df: DataFrame, cols: list[str], label: str, ids: list[str], impute: list[str] | None = None, flat: float = 0.0
) -> DataFrame:
    """The AUC screen on its own. ``impute`` names the columns that may hold nulls
    (default: all), so that medians are only worked out for those."""
    return auc_from(df, cols, label, ids, column_moments(df, cols, label, ids, impute), flat)


def association(
    df: DataFrame, cols: list[str], label: str, ids: list[str], impute: list[str] | None = None
) -> DataFrame:
    """|covariance| and |correlation| of every column with every class indicator."""
    keys = ids + ["col"]
    return class_association(filled(column_moments(df, cols, label, ids, impute), keys), keys)


def column_features(
    df: DataFrame,
    cols: list[str],
    label: str,
    ids: list[str],
    truth: DataFrame | None = None,
    impute: list[str] | None = None,
    moments: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Every screen of every column in one table: auc, cor, miss, regex (+ truth).
    ``moments`` from an earlier ``column_moments`` and ``counts`` from an earlier
    ``filled_counts`` save their scans."""
    keys = ids + ["col"]
    moments = column_moments(df, cols, label, ids, impute) if moments is None else moments
    cor = class_association(filled(moments, keys), keys).groupBy(*keys).agg(F.max("cor").alias("cor"))
    out = (
        auc_from(df, cols, label, ids, moments, counts=counts)
        .join(cor, keys)
        .join(missing_asymmetry(moments, keys), keys)
        .withColumn("regex", F.regexp_replace("col", "_", " ").rlike(any_of(MARKERS)))
    )
    return out if truth is None else out.join(truth, keys)


def two_way_screen(
    df: DataFrame, cols: list[str], label: str, ids: list[str], impute: list[str] | None = None
) -> DataFrame:
    """AUC of the values or of the missingness, whichever is better, and which.

    Values need 10 non-nulls and 2 distinct values. The AUC of a 0/1 indicator is
    .5 + half the difference of its rates, so missingness needs no ranking.
    """
    keys = ids + ["col"]
    w = Window.partitionBy(*keys)
    null = F.col("n") - F.col("n_val")
    rest = F.sum("n").over(w) - F.col("n")
    gap = F.abs(ratio(null, F.col("n")) - ratio(F.sum(null).over(w) - null, rest))
    moments = column_moments(df, cols, label, ids, impute)
    miss = (
        moments.withColumn("gap", F.when(rest > 0, gap).otherwise(0.0))
        .groupBy(*keys)
        .agg(
            (0.5 + F.max("gap") / 2).alias("a_miss"),
            F.sum("n_val").alias("nv"),
            (F.min("lo") < F.max("hi")).alias("live"),
        )
    )
    j = miss.join(auc_from(df, cols, label, ids, moments, flat=0.5), keys, "left")
    a_val = F.when((F.col("nv") >= 10) & F.col("live"), F.greatest("auc", F.lit(0.5))).otherwise(0.5)
    return j.select(
        *keys,
        a_val.alias("a_val"),
        "a_miss",
        F.greatest(a_val, F.col("a_miss")).alias("score"),
        F.when(F.col("a_miss") > a_val, "missingness").otherwise("values").alias("how"),
    )


def screen_rank(screen: DataFrame, score: str, truth: DataFrame, top: int = 3) -> DataFrame:
    """Rank of every column within its dataset and whether the top-k rule catches it."""
    w = Window.partitionBy("ds").orderBy(F.col(score).desc())
    return (
        screen.withColumn("rank", F.rank().over(w))
        .join(truth.select("ds", "col", "is_pos"), ["ds", "col"])
        .withColumn("caught", F.col("is_pos") & (F.col("rank") <= top))
    )


def name_screen(columns: DataFrame, name: str = "col") -> DataFrame:
    """Marker hits of the frozen and the tuned vocabulary on column names."""
    return columns.withColumns(
        {
            "frozen": F.col(name).rlike(name_pattern(MARKERS)),
            "tuned": F.col(name).rlike(name_pattern(MARKERS + TUNED_EXTRA)),
        }
    )


def best_threshold(scored: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """The threshold among the 4-decimal rounded scores that maximises F1.

    The test is ``score >= round(score, 4)``, so a score rounded up fails its own
    threshold; the lowest best threshold wins. Scores fold onto the 0.0001 grid
    (10,001 steps on [0, 1]), so the running counts never see single rows.
    """
    by = by or []
    t = F.round(F.col(score), 4)
    step = F.round(t * 10000).cast("long")
    cell = F.when(F.col(score) >= t, step).otherwise(step - 1)
    base = scored.where(F.col(score).isNotNull())
    pts = (
        base.select(
            *by,
            F.explode(
                F.array(
                    F.struct(cell.alias("g"), F.col(y).cast("long").alias("pos"), F.lit(1).cast("long").alias("all"), F.lit(False).alias("cand")),
                    F.struct(step.alias("g"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("all"), F.lit(True).alias("cand")),
                )
            ).alias("e"),
        )
        .groupBy(*by, F.col("e.g").alias("g"))
        .agg(F.sum("e.pos").alias("pos"), F.sum("e.all").alias("all"), F.bool_or("e.cand").alias("cand"))
    )
    down = Window.partitionBy(*by).orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    swept = pts.select(
        *by,
        "cand",
        (F.col("g") / 10000.0).alias("threshold"),
        F.sum("pos").over(down).alias("tp"),
        (F.sum("all").over(down) - F.sum("pos").over(down)).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(down)).alias("fn"),
        F.sum("all").over(whole).alias("total"),
    ).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    graded = with_prf(swept.where("cand"), mcc="tn")
    pick = F.max_by(
        F.struct("threshold", "tp", "fp", "fn", "p", "r", "f1", "mcc"),
        F.struct(F.round("f1", 12), -F.col("threshold")),
    )
    return graded.groupBy(*by).agg(pick.alias("b")).select(*by, "b.*")


def grid_threshold(scored: DataFrame, score: str, y: str, grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best-F1 threshold among a quantile grid (``q`` array per ``by``), for
    row-level scores: rows fold onto the at most 100 grid intervals."""
    by = by or []
    ts = F.array_sort(F.array_distinct(F.transform("q", lambda x: F.round(x, 4))))
    g = grid.select(*by, ts.alias("_ts"))
    rows = join_dim(scored, g, by) if by else scored.withColumn("_ts", g.select("_ts").scalar())
    slot = F.size(F.filter("_ts", lambda x: x <= F.col(score)))
    counts = rows.groupBy(*by, "_ts", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("all"), F.sum(F.col(y).cast("long")).alias("pos")
    )
    per = counts.groupBy(*by, "_ts").agg(
        F.sum("all").alias("total"),
        F.sum("pos").alias("n_pos"),
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("all", "pos")))).alias("m"),
    )

    def upward(i, field):
        return F.aggregate(
            F.filter(F.map_entries("m"), lambda e: e["key"] > i),
            F.lit(0).cast("long"),
            lambda acc, e: acc + e["value"][field],
        )

    swept = (
        per.select("*", F.posexplode("_ts").alias("i", "threshold"))
        .withColumns({"tp": upward(F.col("i"), "pos"), "_n": upward(F.col("i"), "all")})
        .withColumns({"fp": F.col("_n") - F.col("tp"), "fn": F.col("n_pos") - F.col("tp")})
    )
    pick = F.max_by(
        F.struct("threshold", "tp", "fp", "fn", "p", "r", "f1"), F.struct(F.round("f1", 12), -F.col("threshold"))
    )
    return with_prf(swept).groupBy(*by).agg(pick.alias("b")).select(*by, "b.*")


def association_ranks(assoc: DataFrame, width: int | None = None) -> DataFrame:
    """Rank by covariance and by correlation per class, S = 1 - (rank-1)/|F|, and
    the best rank over classes; golden when the correlation rank is at most 3."""
    per = Window.partitionBy("ds", "y")
    n = F.lit(width) if width else F.count(F.lit(1)).over(per)
    ranked = assoc.select(
        "ds",
        "col",
        "y",
        n.alias("n_features"),
        F.rank().over(per.orderBy(F.round("cov", 9).desc())).alias("rank_cov"),
        F.rank().over(per.orderBy(F.round("cor", 9).desc())).alias("rank_cor"),
    )
    best = ranked.groupBy("ds", "col").agg(
        F.max("n_features").cast("long").alias("n_features"),
        F.min("rank_cov").cast("long").alias("rank_cov"),
        F.min("rank_cor").cast("long").alias("rank_cor"),
    )
    return best.withColumns(
        {
            "s_cov": 1 - (F.col("rank_cov") - 1) / F.col("n_features"),
            "s_cor": 1 - (F.col("rank_cor") - 1) / F.col("n_features"),
            "golden": F.col("rank_cor") <= 3,
        }
    )


def n_values(df: DataFrame, cols: list[str], label: str, ids: list[str], moments: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Number of distinct values per column; a median that stands in for nulls counts.
    ``counts`` from an earlier ``filled_counts`` saves its scan."""
    keys = ids + ["col"]
    counts = filled_counts(df, cols, label, ids, moments) if counts is None else counts
    return counts.groupBy(*keys, "v").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("nun"))


def rank_gap(features: DataFrame, distinct: DataFrame) -> DataFrame:
    """AUC rank minus correlation rank per column, with its number of values."""
    w = Window.partitionBy("ds")
    return features.join(distinct, ["ds", "col"]).select(
        "ds",
        "col",
        "nun",
        (F.col("nun") <= 2).alias("binary"),
        F.rank().over(w.orderBy(F.round("auc", 9).desc())).alias("rank_auc"),
        F.rank().over(w.orderBy(F.round("cor", 9).desc())).alias("rank_cor"),
    ).withColumn("gap", F.col("rank_auc") - F.col("rank_cor"))


def mann_whitney(df: DataFrame, value: str, first: str) -> DataFrame:
    """U of the rows where ``first`` holds against the rest, one-sided p (greater)
    by the normal approximation with tie and continuity correction."""
    counts = df.groupBy(F.col(value).cast("double").alias("v"), F.col(first).alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = rank_sums(counts, []).agg(
        F.sum(F.when(F.col("y"), F.col("n"))).alias("n1"),
        F.sum(F.when(~F.col("y"), F.col("n"))).alias("n2"),
        F.sum(F.when(F.col("y"), F.col("rank_sum"))).alias("r1"),
    )
    ties = counts.groupBy("v").agg(F.sum("n").alias("t")).agg(
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties")
    )
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n12 = F.col("n1") * F.col("n2")
    var = n12 / 12.0 * ((n + 1) - ratio(F.col("ties"), n * (n - 1)))
    z = ratio(F.col("u") - n12 / 2.0 - 0.5, F.sqrt(var))
    return (
        sums.withColumn("ties", ties.scalar())
        .withColumn("u", u)
        .select("n1", "n2", "u", normal_upper(z).alias("p"))
    )


# ------------------------------------------------------ value-level checks


def active(col: str, has_null: Column, levels: list | None = None) -> Column:
    """A field is active when it is in ``levels``, or non-null if it has nulls, or non-zero."""
    if levels is not None:
        return F.coalesce(F.col(col).isin(levels), F.lit(False))
    return F.when(has_null, F.col(col).isNotNull()).otherwise(F.coalesce(F.col(col) != 0, F.lit(False)))


def activation(moments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per (keys, y): rows, and rows where the column is active: non-null if the
    column has nulls anywhere, else non-zero."""
    nulls = F.sum(F.col("n") - F.col("n_val")).over(Window.partitionBy(*keys)) > 0
    return moments.select(*keys, "y", "n", F.when(nulls, F.col("n_val")).otherwise(F.col("n_nonzero")).alias("n_active"))


def one_sidedness(act: DataFrame, keys: list[str] = KEYS, floor: float = 0.7) -> DataFrame:
    """The class a column concentrates on when active, and its share."""
    top = F.max_by(F.struct("y", "n_active"), F.struct("n_active", "y"))
    return act.groupBy(*keys).agg(F.sum("n_active").alias("n_active"), top.alias("t")).select(
        *keys,
        "n_active",
        F.when(F.col("n_active") > 0, F.col("t.y")).alias("top_class"),
        F.try_divide(F.col("t.n_active"), F.col("n_active")).alias("share"),
        F.coalesce(F.try_divide(F.col("t.n_active"), F.col("n_active")) >= floor, F.lit(False)).alias("one_sided"),
    )


def pair_silence(act: DataFrame, pair: tuple[str, str], keys: list[str] = KEYS, ceiling: float = 0.1) -> DataFrame:
    """Activation rate inside each class of the pair; silent when both are below ``ceiling``."""
    rate = F.col("n_active") / F.col("n")
    return act.where(F.col("y").isin(*pair)).groupBy(*keys).agg(
        F.max(F.when(F.col("y") == pair[0], rate)).alias("rate_a"),
        F.max(F.when(F.col("y") == pair[1], rate)).alias("rate_b"),
        (F.max(rate) < ceiling).alias("silent"),
    )


def duplicate_checks(df: DataFrame, cols: list[str], label: str, bar: float = 0.99) -> DataFrame:
    """Constant columns, and columns equal to the label as text on > ``bar`` of rows."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("string")
        aggs += [
            F.coalesce(F.min(v).eqNullSafe(F.max(v)), F.lit(True)).alias(f"k{i}"),
            F.avg(F.coalesce(v == F.col(label).cast("string"), F.lit(False)).cast("double")).alias(f"e{i}"),
        ]
    row = df.agg(*aggs)
    each = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(f"k{i}").alias("constant"), F.col(f"e{i}").alias("same")) for i, c in enumerate(cols)]
    )
    return row.select(F.explode(each).alias("e")).select("e.*", (F.col("e.same") > bar).alias("duplicates_label"))


# ---- fixed value: generated column names
PLACEHOLDER = r"(?i)^(attribute|attr|var|col|feature|[avxf])\s*_?\d+$"


def anonymous_names(columns: DataFrame, by: list[str], name: str = "col", bar: float = 0.6) -> DataFrame:
    """Datasets whose column names are mostly placeholders or at most 3 characters."""
    hit = F.col(name).rlike(PLACEHOLDER) | ((F.length(name) <= 3) & F.col(name).rlike("^[A-Za-z]"))
    return columns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cols"), F.avg(hit.cast("double")).alias("anon_share")
    ).withColumn("anonymous", F.col("anon_share") > bar)


def fuse(judged: DataFrame, a: str, b: str, y: str = "is_pos", by: list[str] | None = None) -> DataFrame:
    """Two screens side by side: each alone, their union, their agreement."""
    views = F.array(
        F.struct(F.lit("A").alias("screen"), F.col(a).alias("pred")),
        F.struct(F.lit("B").alias("screen"), F.col(b).alias("pred")),
        F.struct(F.lit("UNION").alias("screen"), (F.col(a) | F.col(b)).alias("pred")),
        F.struct(F.lit("AGREE").alias("screen"), (F.col(a) & F.col(b)).alias("pred")),
    )
    long = judged.select(*(by or []), F.col(y).alias("_y"), F.explode(views).alias("e"))
    return prf(long, F.col("_y"), F.col("e.pred"), (by or []) + [F.col("e.screen").alias("screen")])


def fusion_gaps(judged: DataFrame, a: str, b: str, y: str = "is_pos", by: list[str] | None = None) -> DataFrame:
    """Positives found by only one screen, by neither, and the cost of checking the union."""
    A, B, Y = F.col(a), F.col(b), F.col(y)
    return judged.groupBy(*(by or [])).agg(
        count_if(Y & A & ~B).alias("only_a"),
        count_if(Y & B & ~A).alias("only_b"),
        count_if(Y & ~A & ~B).alias("missed_by_both"),
        count_if(A | B).alias("flagged"),
        F.count(F.lit(1)).alias("n"),
        count_if(Y).alias("n_pos"),
    )


def triage(judged: DataFrame, semantic: str, statistical: str) -> DataFrame:
    """Bucket A both flags, B semantic only, C statistical only, D neither."""
    s, t = F.col(semantic), F.col(statistical)
    return judged.withColumn("bucket", F.when(s & t, "A").when(s, "B").when(t, "C").otherwise("D"))


def constant_baselines(features: DataFrame, t: float) -> DataFrame:
    """B0, which never flags, and B5, which flags on the name or on auc >= t."""
    preds = F.array(
        F.struct(F.lit("B0 never").alias("screen"), F.lit(False).alias("pred")),
        F.struct(F.lit("B5 regex or auc").alias("screen"), (F.col("regex") | (F.col("auc") >= t)).alias("pred")),
    )
    long = features.select("is_pos", F.explode(preds).alias("e"))
    return prf(long, F.col("is_pos"), F.col("e.pred"), [F.col("e.screen").alias("screen")])
