"""Joins against a dimension whose size is looked at before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 8


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows that take at most ``max_bytes``
    bytes as JSON, so rows with long arrays or texts count as what they are; reads no
    further than that many rows."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    n, taken = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= max_rows and taken <= max_bytes


def join_dim(
    big: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large frame to a dimension.

    A dimension that ``is_small`` is broadcast. A larger one is joined
    on the keys plus a salt, so that a key holding a third of the large side is
    spread over ``salts`` tasks; each large row meets exactly one salted copy, so
    the result is that of the plain join for inner, left, left_semi and left_anti.
    The copies ask for a merge join: Spark's size estimate does not see the explode
    and would take them for small enough to broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_dim cannot do a {how} join")
    if is_small(dim, max_rows):
        return big.join(F.broadcast(dim), on, how)
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), on + ["_salt"], how).drop("_salt")


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
