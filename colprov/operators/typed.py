"""Screens over tables of any column types, from one pass over the rows.

Every cell is read twice at once: as a number (text without %, $ and commas) and as text.
The pass folds equal cells of a column and class to one row with a count; what a column is
(numbers, text that parses, text that needs codes), its codes, moments, median and ranks are
all worked out from the folded rows, so the table itself is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.ranks import dense_codes, exact_median
from colprov.functions.special import ratio
from colprov.operators.encode import is_numeric, parsed
from colprov.operators.screens import MARKERS, any_of, class_association, class_auc, filled, missing_asymmetry
from colprov.session import cut


def number(x: Column) -> Column:
    """A value as a double; NaN is no value."""
    v = x.cast("double")
    return F.when(~F.isnan(v), v)


def cells(df: DataFrame, cols: list[str], label: str, ids: list[str]) -> DataFrame:
    """(ids.., y, col, written, num, txt, n): equal cells of a class folded to one row.

    ``num`` is what the cell is as a number, ``txt`` what is written in it; a column of
    numbers or booleans has no text.
    """
    each = []
    for c in cols:
        text = not is_numeric(df, c)
        raw = F.col(f"`{c}`")
        num = number(parsed(c)) if text else number(raw.cast("int") if dict(df.dtypes)[c] == "boolean" else raw)
        each += [F.lit(c), F.lit(text), num, raw.cast("string") if text else F.lit(None).cast("string")]
    long = df.select(*ids, F.col(label).alias("y"), F.stack(F.lit(len(cols)), *each).alias("col", "written", "num", "txt"))
    return long.groupBy(*ids, "y", "col", "written", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def encoded(counts: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """(keys.., y, v, missing, n) of folded ``cells``.

    Numbers stay, text of which more than ``share`` parses becomes numbers, other text codes
    in sorted order per key, null -1. ``missing`` says that the cell was empty before.
    """
    kinds = counts.groupBy(*keys).agg(
        (F.first("written") & (F.sum(F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)) <= share * F.sum("n"))).alias("_coded")
    )
    known = join_dim(counts, cut(kinds), keys)
    missing = F.when(F.col("written"), F.col("txt").isNull()).otherwise(F.col("num").isNull())
    plain = known.where("NOT _coded").select(*keys, "y", F.col("num").alias("v"), missing.alias("missing"), "n")
    text = known.where("_coded")
    codes = dense_codes(text.where("txt IS NOT NULL").select(*keys, "txt").distinct(), keys, ["txt"])
    coded = join_dim(text, codes, [*keys, "txt"], "left")
    return plain.unionByName(coded.select(*keys, "y", F.coalesce(F.col("code").cast("double"), F.lit(-1.0)).alias("v"), missing.alias("missing"), "n"))


def count_moments(values: DataFrame, keys: list[str]) -> DataFrame:
    """``screens.column_moments`` of counted values, with the cells that were missing."""
    by = [*keys, "y"]
    known = F.col("v").isNotNull()
    first = cut(
        values.groupBy(*by).agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_val"),
            F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("n_missing"),
            F.coalesce(ratio(F.sum(F.col("n") * F.col("v")), F.sum(F.when(known, F.col("n")))), F.lit(0.0)).alias("mean"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
    )
    around = join_dim(values.where(known), first.select(*by, "mean"), by)
    m2 = around.groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("m2"))
    holes = first.where("n_val < n").select(*keys).distinct()
    med = exact_median(join_dim(values, holes, keys, "left_semi"), keys, "v", "n")
    return first.join(m2, by, "left").join(med, keys, "left").withColumn("m2", F.coalesce("m2", F.lit(0.0)))


def column_features(df: DataFrame, cols: list[str], label: str, ids: list[str], truth: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """Every screen of every column of any type: auc, cor, miss, regex (+ truth).

    A column without values, or with one value only, has auc and cor 0; a null is screened at
    the median of its column, or as a code of its own where the column is coded.
    """
    keys = [*ids, "col"]
    folded = cut(cells(df, cols, label, ids))
    if all(is_numeric(df, c) for c in cols):
        values = folded.select(*keys, "y", F.col("num").alias("v"), F.col("num").isNull().alias("missing"), "n")
    else:
        values = cut(encoded(folded, keys, share))
    moments = cut(count_moments(values, keys))
    nulls = moments.where("n > n_val AND median IS NOT NULL").select(*keys, F.col("median").alias("v"), "y", (F.col("n") - F.col("n_val")).alias("n"))
    full = values.where("v IS NOT NULL").select(*keys, "v", "y", "n").unionByName(nulls)
    spread = F.min("lo") < F.max("hi")
    auc = class_auc(full, keys).groupBy(*keys).agg(F.when(spread, F.max(F.abs(F.col("auc") - 0.5) + 0.5)).alias("auc"))
    cor = class_association(filled(moments, keys), keys).groupBy(*keys).agg(F.max("cor").alias("cor"))
    miss = missing_asymmetry(moments.withColumn("n_val", F.col("n") - F.col("n_missing")), keys)
    out = miss.join(cor, keys, "left").join(auc, keys, "left").fillna(0.0, ["auc", "cor"])
    out = out.withColumn("regex", F.regexp_replace("col", "_", " ").rlike(any_of(MARKERS)))
    return out if truth is None else out.join(truth, keys)
