"""Shards by vector bin packing: bytes, tokens and rows balanced jointly, equal texts together.

The unit is a group of equal texts. A group larger than a shard's fair share is cut into
pieces by document id. Units of at least ``1 / fine`` of a share (there can be no more
than 3 * shards * fine of them) are packed one by one; all smaller ones first fall into
a fixed number of bundles by the hash of their text, some bundles much finer than the
others to level the end. Packing takes units by falling size and puts each where the dot
product of its (bytes, tokens, rows) with the shard's residual capacity is highest. So
what the driver sees has a fixed bound whatever the corpus, while sums and the final
join are distributed. Slots number a shard's rows without gaps from counts per (shard,
range) and a rank inside each range, so that no task sorts a shard.

A null text has no bytes, no tokens, checksum 0, and is a group of its own apart from
the empty text. Repeated rows are separate rows. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprov.session import cut

ROW_BYTES = 16
FINE = 250
COARSE_BUNDLES, FINE_BUNDLES, FINE_SHARE = 4000, 8000, 10
PIECES = 8
RANGE_ROWS = 50_000


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows), highest dot product with residual capacity."""
    if not len(items):
        return np.zeros(0, np.int32)
    total = np.maximum(items.sum(axis=0), 1e-9)
    share = items / (total / shards)
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = at = int(np.argmax(residual @ share[i]))
        residual[at] -= share[i]
    return out


def features(docs: DataFrame) -> DataFrame:
    """Per row: id, size, tokens, checksum and text hash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("g"),
    )


def assign(docs: DataFrame, shards: int = 40, fine: int = FINE) -> DataFrame:
    """Rows (doc_id, size, tokens, text_crc32, shard, slot), one per row of ``docs``."""
    spark = docs.sparkSession
    rows = cut(features(docs))
    n, size, tokens = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    n, size, tokens = n or 0, size or 0, tokens or 0
    fair = [max(x, 1) / shards for x in (size, tokens, n)]
    weight = F.greatest(F.col("size") / fair[0], F.col("tokens") / fair[1], F.col("rows") / fair[2])
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    key = ["g", "text_crc32"]

    # at most 3 * shards groups weigh more than a fair share
    large = rows.groupBy(*key).agg(*sums).withColumn("weight", weight).where("weight > 1")
    large = large.select(*key, F.ceil(F.col("weight") * PIECES).cast("int").alias("pieces"))
    large = spark.createDataFrame([tuple(r) for r in large.collect()], large.schema)
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(large), key, "left").withColumn("piece", piece).drop("pieces")

    units = rows.groupBy(*key, "piece").agg(*sums).withColumn("big", weight >= 1 / fine)
    units = cut(units)
    high = F.shiftrightunsigned("g", 20)
    bundle = F.when(
        F.pmod("g", F.lit(FINE_SHARE)) > 0, F.pmod(high, F.lit(COARSE_BUNDLES))
    ).otherwise(COARSE_BUNDLES + F.pmod(high, F.lit(FINE_BUNDLES))).cast("int")
    big = units.where("big").select(*key, "piece", "size", "tokens", "rows").toPandas()  # at most 3 * shards * fine
    small = (
        units.where("not big").groupBy(bundle.alias("bundle"))
        .agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        .toPandas()  # at most COARSE_BUNDLES + FINE_BUNDLES
    )
    items = pd.concat([big, small], ignore_index=True)[["size", "tokens", "rows"]].to_numpy(float)
    at = pack(items, shards)
    big["shard"], small["shard"] = at[: len(big)], at[len(big) :]
    to_big = spark.createDataFrame(list(big[[*key, "piece", "shard"]].itertuples(index=False, name=None)), "g long, text_crc32 long, piece int, own int")
    to_small = spark.createDataFrame(list(small[["bundle", "shard"]].itertuples(index=False, name=None)), "bundle int, shared int")
    placed = (
        rows.join(F.broadcast(to_big), [*key, "piece"], "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(to_small), "bundle", "left")
        .select("doc_id", "size", "tokens", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    )
    return number(placed, max(8, n // shards // RANGE_ROWS + 1))


def number(placed: DataFrame, ranges: int) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 inside each shard."""
    placed = cut(placed.withColumn("range", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(ranges)).cast("int")))
    counts = placed.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(counts, ["shard", "range"])
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
    )
