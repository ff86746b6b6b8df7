"""Order statistics without a one-task window.

A running total over ``partitionBy(column).orderBy(value)`` puts every value of a
column into one task. Here the ordered rows are first dealt into contiguous
ranges of roughly equal size over (keys, order); a window runs inside each range
and the totals of the earlier ranges, one short row per range, are added. The
range borders come from a bottom-k sample by hash. They are a pure function of
the data, so a lost executor recomputes the same borders, and they only balance
the work: any borders give the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_ranges(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, 2 * parts)


def bottom_rows(df: DataFrame, k: int) -> DataFrame:
    """The k rows with the smallest hash: a sample that is a function of the data."""
    return df.select("*", F.xxhash64(*df.columns).alias("_sample_hash")).orderBy("_sample_hash", *df.columns).limit(k).drop("_sample_hash")


def with_range(
    df: DataFrame, order: list[str], n: int | None = None, name: str = "_range", sample: DataFrame | None = None
) -> DataFrame:
    """Add the number of the contiguous range of ``order`` that a row falls in.

    ``sample`` holds rows with the ``order`` columns to take the borders from; by
    default they are drawn from ``df``. A sample taken further up, before an
    aggregate, saves running that aggregate twice.
    """
    n = n or default_ranges(df)
    sample = bottom_rows(df.select(*order), n) if sample is None else sample.select(*order)
    borders = sample.agg(F.array_sort(F.collect_set(F.struct(*order))).alias("b")).scalar()
    out = df.withColumns({"_point": F.struct(*order), "_borders": borders, name: F.lit(0)})
    # binary search, one step per projection
    half = 1 << max(0, math.ceil(math.log2(n + 1)) - 1)
    while half:
        at = F.get("_borders", F.col(name) + (half - 1))
        out = out.withColumn(name, F.col(name) + F.when(at <= F.col("_point"), half).otherwise(0))
        half //= 2
    return out.drop("_point", "_borders")


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weights: dict[str, Column],
    n: int | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """For rows unique on keys + order: the summed weight of all earlier rows of
    the key as ``<name>_before`` and of the whole key as ``<name>_total``."""
    for name, w in weights.items():
        df = df.withColumn(name, w)
    b = with_range(df, keys + order, n, sample=sample)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per_range = b.groupBy("_range", *keys).agg(*[F.sum(w).alias(f"_{w}_r") for w in weights])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_range.select(
        "_range",
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_{w}_r").over(earlier), F.lit(0)).alias(f"_{w}_off") for w in weights],
        *[F.sum(f"_{w}_r").over(whole).alias(f"{w}_total") for w in weights],
    ).withColumnRenamed("_range", "_range_o")
    cond = F.col("_range") == F.col("_range_o")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = b.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_in") for w in weights]
    )
    return local.join(offsets, cond).select(
        *df.columns,
        *[(F.col(f"_{w}_in") + F.col(f"_{w}_off")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], n: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles ``q`` (array, in the order of ``probs``) per key.

    ``df`` may carry a count column ``n``; nulls in ``value`` are left out. The
    totals of the ranges tell which few of them hold a wanted position, and only
    those are ordered. Exact, and no task ever holds a whole key.
    """
    weight = F.sum(n) if n else F.count(F.lit(1))
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    distinct = rows.groupBy(*keys, "_v").agg(weight.cast("long").alias("_n"))
    borders = bottom_rows(distinct, default_ranges(df))
    b = with_range(distinct, keys + ["_v"], sample=borders)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    grid = F.array(*[F.lit(float(p)) for p in probs])

    def place(p, last):
        return F.round(p * last, 9)

    last = F.col("_total") - 1
    wanted = F.array_distinct(
        F.flatten(F.transform(grid, lambda p: F.array(F.floor(place(p, last)), F.ceil(place(p, last)))))
    )
    targets = (
        b.groupBy("_range", *keys)
        .agg(F.sum("_n").alias("_size"))
        .select(
            F.col("_range").alias("_range_t"),
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            "_size",
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off"),
            F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"),
        )
        .withColumn(
            "_pos", F.filter(wanted, lambda x: (x >= F.col("_off")) & (x < F.col("_off") + F.col("_size")))
        )
        .where(F.size("_pos") > 0)
    )
    cond = F.col("_range") == F.col("_range_t")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_range", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = b.join(targets, cond).withColumn("_b", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hits = at.select(
        *keys,
        "_total",
        "_v",
        F.explode(F.filter("_pos", lambda x: (x >= F.col("_b")) & (x < F.col("_b") + F.col("_n")))).alias("_x"),
    )
    g = hits.groupBy(*keys).agg(
        F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_x", "_v"))).alias("_m")
    )

    def value_at(p):
        x = place(p, last)
        low, high = F.element_at("_m", F.floor(x)), F.element_at("_m", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return g.select(*keys, F.transform(grid, value_at).alias("q"))


def exact_median(df: DataFrame, keys: list[str], value: str, n: str | None = None, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], n).select(*keys, F.col("q")[0].alias(name))


def dense_codes(df: DataFrame, keys: list[str], order: list[str], name: str = "code") -> DataFrame:
    """0-based position of each row (unique on keys + order) within its key."""
    return running_before(df, keys, order, {"_one": F.lit(1).cast("long")}).select(
        *df.columns, F.col("_one_before").cast("long").alias(name)
    )
