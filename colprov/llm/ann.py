"""Nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; its
bucket in a table is the nearest signed axis, the largest coordinate by size. Rows are
put into one bucket of each of ``tables`` tables; queries look into their ``probes``
nearest axes. A bucket is worked on in blocks: rows of it against queries that probe it,
one matrix product each, never more than ``BLOCK`` of either, so a bucket with a third
of all rows is many tasks. Blocks give their best vectors per query, which are
reranked by the exact inner product in double precision, summed in one fixed order.

Nearness is the inner product of the original vectors. Rows are dealt into norm bands, whose
longest norm is at most ``BAND`` times the shortest, and every query looks into all bands of
its length. Each band has its own tables; vectors shorter than the band's longest are
extended by one more coordinate before rotation, which makes unit vectors whose angles
follow inner products. Bands of at most ``block`` vectors have no tables: all queries are
compared with all of their vectors. Equal vectors are indexed once, with their smallest ids:
only the ``k + 1`` smallest ids of equal vectors can be among anyone's ``k`` nearest.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids; vectors of different length never meet. Rows repeated under an id count once.
A query whose probes hold fewer than ``k`` is compared with all vectors of its length, so
it misses none where there are fewer. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprov.llm.common import prepare
from colprov.session import cut

TABLES, PROBES = 20, 6
BLOCK = 4096
BAND = 1.1
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(width: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.where(np.random.default_rng(seed).random((tables, 3, width)) < 0.5, -1.0, 1.0)


def axes(v: np.ndarray, longest: float, even: bool, signs: np.ndarray, query: bool) -> np.ndarray:
    """Rotated coordinates of each vector and their negatives: column 2i is axis i, 2i + 1 its opposite."""
    n, d = v.shape
    width = signs.shape[1]
    x = np.zeros((n, width))
    if query or even:
        v = v / np.abs(v).max(axis=1)[:, None]  # squares stay finite
        x[:, :d] = v / np.linalg.norm(v, axis=1)[:, None]
    else:
        norm = np.linalg.norm(v, axis=1)
        x[:, :d] = v / longest
        x[:, d] = np.sqrt(np.maximum(1 - (norm / longest) ** 2, 0))
    for s in signs:
        x = hadamard(x * s)
    out = np.empty((n, 2 * width))
    out[:, 0::2], out[:, 1::2] = x, -x
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part; v is an array of doubles."""
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(good)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, v, ids): every distinct vector with its ``most`` smallest ids, in three salted rounds."""
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("key")).dropDuplicates(["vec_id", "key"])
    for salts in (64, 8, 1):
        near = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
        rows = rows.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
    return rows.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Bands:
    """Norm bands of one vector length, shortest first, from (count, low, high) of narrow cells of norms."""

    def __init__(self, d: int, cells: list[tuple[int, float, float]], full: float):
        bands = []
        for n, low, high in sorted(cells, key=lambda c: -c[1]):
            if bands and low * BAND >= bands[-1][2]:
                bands[-1] = (bands[-1][0] + n, low, bands[-1][2])
            else:
                bands.append((n, low, high))
        n, self.low, self.high = (np.array(x, float) for x in zip(*reversed(bands)))
        self.even = self.low >= 0.999 * self.high
        self.width = np.array([1 << max(1, (d - 1 if even else d).bit_length()) for even in self.even])
        # norms that left the range of doubles cannot be scaled
        self.hashed = (n > full) & (self.low > 0) & (self.high < np.inf)


class Plan:
    """Norm bands and rotations for each vector length; small and fixed by the parameters and the norms.

    Table t of band b is number ``b * tables + t``; -1 is the list of all vectors in bands
    of at most ``full``, a single bucket.
    """

    def __init__(self, rows: DataFrame, tables: int, full: float, seed: int):
        cell = F.floor(F.log("norm") * 100)
        stats = rows.groupBy(F.size("v").alias("d"), cell.alias("cell")).agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()
        cells: dict[int, list] = {}
        for d, _, n, low, high in stats:
            cells.setdefault(d, []).append((n, low, high))
        self.tables = tables
        self.of = {d: Bands(d, c, full) for d, c in cells.items()}
        widths = {int(w) for b in self.of.values() for w in b.width[b.hashed]}
        self.signs = {w: rotations(w, tables, seed) for w in widths}

    def buckets(self, batch: pa.RecordBatch, probes: int, query: bool):
        """(row, table, axis) for the nearest ``probes`` axes of every row, in its own band or, for a query, in all."""
        lists = batch.column("v")
        flat, size, norm = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), batch.column("norm").to_numpy()
        begin = np.cumsum(size) - size
        rows, tables, found = [], [], []

        def look(at: np.ndarray, v: np.ndarray, bands: Bands, like: int, into: list[int]):
            signs = self.signs[int(bands.width[like])]
            for t in range(len(signs)):
                x = axes(v, bands.high[like], bands.even[like], signs[t], query)
                k = min(probes, x.shape[1])
                best = np.argpartition(-x, k - 1, axis=1)[:, :k] if k > 1 else np.argmax(x, axis=1)[:, None]
                for band in into:
                    rows.append(np.repeat(at, k))
                    tables.append(np.full(len(at) * k, band * self.tables + t, np.int32))
                    found.append(best.reshape(-1))

        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            v = flat[begin[at][:, None] + np.arange(d)]
            bands = self.of[int(d)]
            band = np.searchsorted(bands.low, norm[at], side="right") - 1
            listed = np.full(len(at), not bands.hashed.all()) if query else ~bands.hashed[band]
            rows.append(at[listed])
            tables.append(np.full(int(listed.sum()), -1, np.int32))
            found.append(np.zeros(int(listed.sum()), np.int64))
            if query:
                for width in np.unique(bands.width[bands.hashed]):
                    into = np.flatnonzero(bands.hashed & (bands.width == width)).tolist()
                    look(at, v, bands, into[0], into)
            else:
                for b in np.unique(band[~listed]).tolist():
                    look(at[band == b], v[band == b], bands, b, [b])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (rows, tables, found))


def bucketed(rows: DataFrame, plan: Plan, probes: int, query: bool, split: dict | None) -> DataFrame:
    """Rows (d, t, bucket) of every row, or with ``split`` also the block numbers and the vector.

    ``split`` has how many row blocks and query blocks a crowded bucket is cut into.
    """
    shared = rows.sparkSession.sparkContext.broadcast((plan, split))

    def work(batches):
        plan, split = shared.value
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                row, t, b = plan.buckets(batch, probes, query)
                d = batch.column("v").value_lengths().to_numpy()[row]
                if split is None:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (d, t, b)], names=["d", "t", "bucket"])
                    continue
                key = batch.column("key").to_numpy()
                mine, other = (1, 0) if query else (0, 1)
                cuts = np.array([split.get(k, (1, 1)) for k in zip(d.tolist(), t.tolist(), b.tolist())], np.int64).reshape(-1, 2)
                own = (key[row].view(np.uint64) % cuts[:, mine].astype(np.uint64)).astype(np.int32)
                times = cuts[:, other]
                take = np.repeat(np.arange(len(row)), times)
                copy = (np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                block = (own[take], copy) if not query else (copy, own[take])
                for start in range(0, len(take), 16384):
                    part = slice(start, start + 16384)
                    at = take[part]
                    source = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.astype(np.int32)) for x in (d[at], t[at], b[at], block[0][part], block[1][part])] + [batch.column(c).take(source) for c in ("key", "low", "v")],
                        names=["d", "t", "bucket", "row_block", "query_block", "key", "low", "v"],
                    )

    schema = "d int, t int, bucket int" + (", row_block int, query_block int, key long, low long, v array<double>" if split is not None else "")
    columns = ["v", "norm"] if split is None else ["key", "low", "v", "norm"]
    return prepare(rows.select(*columns)).mapInArrow(work, schema)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def candidates(vectors: DataFrame, searched: DataFrame, plan: Plan, k: int, probes: int, block: int) -> DataFrame:
    """Rows (query, score, vec_id): the ``k + 1`` nearest found of every searched vector, itself among them."""
    counts = (
        bucketed(vectors, plan, 1, False, None).groupBy("d", "t", "bucket").agg(F.count("*").alias("rows"))
        .join(bucketed(searched, plan, probes, True, None).groupBy("d", "t", "bucket").agg(F.count("*").alias("queries")), ["d", "t", "bucket"])
        .where((F.col("rows") > block) | (F.col("queries") > block))
        .collect()  # at most tables * axes rows for each vector length
    )
    split = {(r.d, r.t, r.bucket): (-(-r["rows"] // block), -(-r["queries"] // block)) for r in counts}
    group = ["d", "t", "bucket", "row_block", "query_block"]

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            v, q = matrix(left.column("v")), matrix(right.column("v"))
            ids, low, qid = left.column("key").to_numpy(), left.column("low").to_numpy(), right.column("key").to_numpy()
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                rough = part @ v.T
                m = min(len(v), k + 1)
                # rows within rounding of the last place are kept for the exact rerank
                edge = -np.partition(-rough, m - 1, axis=1)[:, m - 1] - 1e-9 * np.linalg.norm(part, axis=1) * np.linalg.norm(v, axis=1).max()
                i, j = np.nonzero(rough >= edge[:, None])
                score = (part[i] * v[j]).sum(axis=1)
                by = np.lexsort((low[j], -score, i))
                i, j, score = i[by], j[by], score[by]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < m
                out.append((qid[lo + i[keep]], ids[j[keep]], low[j[keep]], score[keep]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query", "key", "low", "score"), cols)))

    left = bucketed(vectors, plan, 1, False, split).groupBy(*group)
    right = bucketed(searched, plan, probes, True, split).groupBy(*group)
    found = left.cogroup(right).applyInArrow(search, "query long, key long, low long, score double")
    found = found.groupBy("query", "key").agg(F.max("score").alias("score"), F.min("low").alias("low"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = found.join(vectors.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")


def nearest(embeddings: DataFrame, queries: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``queries`` holds."""
    rows = cut(usable(embeddings).select("vec_id", "v", F.xxhash64("v").alias("key")).dropDuplicates(["vec_id", "key"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors = cut(distinct_vectors(rows, k + 1).withColumns({"low": F.element_at("ids", 1), "norm": norm}))
    asked = cut(rows.where(queries).select(F.col("vec_id").alias("query_id"), "key"))
    searched = cut(vectors.join(asked.select("key").distinct(), "key", "left_semi"))
    lists = cut(candidates(vectors, searched, Plan(vectors, tables, block, seed), k, probes, block))
    size = F.size("v").alias("d")
    totals = rows.groupBy(size).agg(F.count("*").alias("total"))
    held = lists.groupBy(F.col("query").alias("key")).agg(F.count("*").alias("held"))
    short = searched.withColumn("d", size).join(held, "key", "left").join(F.broadcast(totals), "d")
    short = cut(short.where(F.coalesce("held", F.lit(0)) < F.least(F.lit(k + 1), "total")).select(*searched.columns))
    if not short.isEmpty():
        lengths = short.select(size).distinct()
        every = vectors.withColumn("d", size).join(F.broadcast(lengths), "d", "left_semi").select(*vectors.columns)
        exact = candidates(every, short, Plan(every, tables, np.inf, seed), k, probes, block)
        lists = lists.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionByName(exact)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(lists, F.col("key") == F.col("query"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
