"""Encodings, binarisers, cohort filters and renames.

The four encoders differ in how they code nulls and text, so all four exist:
``encode_sorted`` (null text -1), ``encode_first_seen`` (null text a level of its
own, numeric nulls to the median or to -1) and ``encode_strict`` (no text, -999).
Category codes come from the distinct values, ranked without a one-task window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprov.functions.joins import join_dim
from colprov.functions.ranks import dense_codes, exact_median
from colprov.operators.score import count_if
from colprov.session import cut

NUMERIC = (T.NumericType, T.BooleanType)


# ------------------------------------------------------------ column names


def dead_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n_values, dead) from one pass over the table."""
    row = df.agg(*[F.count(F.col(c)).alias(f"k{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"k{i}").alias("n_values")) for i, c in enumerate(cols)])
    return row.select(F.explode(each).alias("e")).select("e.*").withColumn("dead", F.col("n_values") == 0)


def drop_dead(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """The table without its all-null columns, and which those were."""
    dead = [r["col"] for r in dead_report(df, cols).where("dead").collect()]
    return df.drop(*dead), dead


def safe(name: Column) -> Column:
    """Every character that is no letter, digit or underscore becomes one underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def safe_names(df: DataFrame) -> DataFrame:
    new = [re.sub(r"[^\w]", "_", c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"names collide once made safe: {sorted(c for c in new if new.count(c) > 1)}")
    return df.toDF(*new)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def bare(name: Column) -> Column:
    """A name without byte-order mark and surrounding white space."""
    return F.regexp_replace(F.regexp_replace(name, "﻿", ""), r"^\s+|\s+$", "")


# --------------------------------------------------------------- encoders


def parsed(c: str) -> Column:
    return F.expr(f"try_cast(regexp_replace(cast(`{c}` as string), '[%$,]', '') as double)")


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def attach_codes(df: DataFrame, c: str, codes: DataFrame, missing: Column) -> DataFrame:
    """Replace text column ``c`` by the code of its value, ``missing`` where null."""
    keyed = cut(codes.select(F.col("_value").alias(c), F.col("code").cast("double").alias("_code")))
    out = join_dim(df, keyed, [c], "left").withColumn(c, F.coalesce("_code", missing)).drop("_code")
    return out.select(*df.columns)


def encode_sorted(df: DataFrame, cols: list[str], share: float = 0.9) -> DataFrame:
    """Numbers stay; text of which more than ``share`` parses (after dropping %, $
    and commas) becomes numbers; other text becomes codes in sorted order, null -1."""
    text = [c for c in cols if not is_numeric(df, c)]
    rates = df.agg(
        F.lit(0).alias("_"), *[F.avg(parsed(c).isNotNull().cast("double")).alias(f"p{i}") for i, c in enumerate(text)]
    ).first()
    for c in cols:
        if c not in text:
            df = df.withColumn(c, F.col(c).cast("double"))
        elif (rates[f"p{text.index(c)}"] or 0.0) > share:
            df = df.withColumn(c, parsed(c))
        else:
            values = df.select(F.col(c).alias("_value")).where(F.col(c).isNotNull()).distinct()
            df = attach_codes(df, c, dense_codes(values, [], ["_value"]), F.lit(-1.0))
    return df


def encode_first_seen(df: DataFrame, cols: list[str], row_id: str, numeric_null: float | None = None) -> DataFrame:
    """Text becomes codes in order of first appearance by ``row_id``, null a level
    of its own; numeric nulls take the column's median, 0 if it has no value, or
    ``numeric_null`` when that is given."""
    for c in cols:
        if is_numeric(df, c):
            x = F.col(c).cast("double")
            fill = F.lit(numeric_null) if numeric_null is not None else F.coalesce(
                exact_median(df.select(x.alias("_x")), [], "_x").select("median").scalar(), F.lit(0.0)
            )
            df = df.withColumn(c, F.coalesce(x, fill))
        else:
            df = df.withColumn(c, F.coalesce(c, F.lit("nan")))
            first = df.groupBy(F.col(c).alias("_value")).agg(F.min(row_id).alias("_first"))
            df = attach_codes(df, c, dense_codes(first, [], ["_first"]), F.lit(None).cast("double"))
    return df


def encode_strict(df: DataFrame, cols: list[str], fill: float = -999.0) -> DataFrame:
    """Booleans and numbers only; anything else is refused rather than coerced."""
    bad = [c for c in cols if not is_numeric(df, c)]
    if bad:
        raise TypeError(f"non-numeric columns survived the exclusions: {bad}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("int" if isinstance(df.schema[c].dataType, T.BooleanType) else "double").cast("double"), F.lit(fill)) for c in cols})


# ------------------------------------------------------------- binarisers


def binarise(df: DataFrame, target: str, out: str = "y01") -> DataFrame:
    """Text: the most frequent level (ties: the smallest) is 1. Two numeric levels:
    the larger is 1. More: above the median is 1. Fewer than two levels: null."""
    if not is_numeric(df, target):
        v = F.col(target).cast("string")
        counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        s = counts.agg(F.count(F.lit(1)).alias("levels"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"))
        pick = s.select(F.when(F.col("levels") > 1, F.col("top"))).scalar()
        return df.withColumn(out, (v == pick).cast("int"))
    x = F.col(target).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    # two levels exactly when every value is the smallest or the largest
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    between = df.select(x.alias("_x")).where((F.col("_x") != lo) & (F.col("_x") != hi)).limit(1)
    n_between = between.agg(F.count(F.lit(1))).scalar()
    med = exact_median(df.select(x.alias("_x")), [], "_x").select("median").scalar()
    return df.withColumn(
        out,
        F.when(lo == hi, F.lit(None)).when(n_between == 0, (x == hi).cast("int")).otherwise((x > med).cast("int")),
    )


def last_level(df: DataFrame, col: str) -> Column:
    """1 on the last level in sorted order."""
    return (F.col(col) == df.agg(F.max(col)).scalar()).cast("int")


YES = ["YES", "1", "TRUE"]


def yes(col: str) -> Column:
    return F.coalesce(F.upper(F.trim(F.col(col).cast("string"))).isin(YES), F.lit(False)).cast("int")


def binarise_by_rule(df: DataFrame, rules: dict[str, tuple[str, str]], dataset: str, out: str = "y01") -> DataFrame:
    """Binarise by the SQL expression recorded for ``dataset``; the sentence that
    states the rule travels with it, so the two cannot drift apart."""
    if dataset not in rules:
        raise KeyError(f"no binarisation rule for {dataset}")
    expression, text = rules[dataset]
    return df.withColumns({out: F.expr(expression).cast("int"), "rule": F.lit(text)})


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_ordinal(text: Column, pivot_year: int = 69) -> Column:
    """year * 12 + month of 'Dec-11'; years from ``pivot_year`` on are 19xx."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(F.regexp_extract(text, r"^([A-Za-z]{3})-\d{2}$", 1)))
    yy = F.regexp_extract(text, r"^[A-Za-z]{3}-(\d{2})$", 1).try_cast("int")
    year = F.when(yy >= pivot_year, yy + 1900).otherwise(yy + 2000)
    return F.when(month > 0, year * 12 + month).cast("int")


# ------------------------------------------------------ filters and renames


def level_set(df: DataFrame, source: str, levels: list, out: str) -> DataFrame:
    """Indicator of a set of levels; the source column leaves with it."""
    return df.withColumn(out, F.coalesce(F.col(source).isin(levels), F.lit(False)).cast("int")).drop(source)


def filter_report(df: DataFrame, **conditions: Column) -> DataFrame:
    """n before, n after each condition alone, and n after all of them."""
    every = F.lit(True)
    for c in conditions.values():
        every = every & F.coalesce(c, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_before"),
        *[count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in conditions.items()],
        count_if(every).alias("n_after"),
    )


def keep_valid(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def exclude(df: DataFrame, identifiers: list[str], free_text: list[str], target: str) -> DataFrame:
    return df.drop(*identifiers, *free_text, target)


def fixed_sample(df: DataFrame, ids: list[str], n: int, seed: int = 0, hashed: Column | None = None) -> DataFrame:
    """Exactly n rows, the same on every run: those with the smallest seeded hash."""
    return df.withColumn("_h", F.xxhash64(*ids, F.lit(seed)) if hashed is None else hashed).orderBy("_h", *ids).limit(n).drop("_h")


def rename_by_alias(rows: DataFrame, aliases: DataFrame, keys: list[str], name: str = "col") -> DataFrame:
    """Replace column names by their alias; an unmapped name becomes an error row
    rather than slipping through under its own name."""
    j = join_dim(rows, aliases.select(*keys, name, "alias"), keys + [name], "left")
    return j.withColumn("unmapped", F.col("alias").isNull())


def require_mapped(renamed: DataFrame) -> DataFrame:
    left = [r[0] for r in renamed.where("unmapped").select("col").distinct().limit(20).collect()]
    if left:
        raise KeyError(f"unmapped columns {left}")
    return renamed.drop("unmapped")


def shuffled_order(columns: DataFrame, by: list[str], name: str = "col", seed: int = 0, hashed: Column | None = None) -> DataFrame:
    """The columns of each dataset in a seeded order, as one array."""
    h = F.xxhash64(F.col(name), F.lit(seed)) if hashed is None else hashed
    keyed = F.struct(h.alias("h"), F.col(name).alias("c"))
    return columns.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["c"]).alias("order"))


def content_id(*cols: Column, length: int = 20) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256), F.lit(length))
