"""Shared helpers: Arrow text buffers, word and gram hashes, components of a graph.

All hashing is 64-bit arithmetic on whole Arrow buffers, so a task never makes a
Python object per word. Work is done in slices of about ``SLICE`` bytes of text;
one longer text is a slice of its own.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.session import scratch

SLICE = 1 << 20
ROWS = 2000

#: White space between words.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

U = np.uint64
M1, M2, P = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def prepare(df: DataFrame) -> DataFrame:
    """Bound the rows of an Arrow batch, since texts may be long, and let workers find this package."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * P)


def white_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(WHITE)] = True
    return t


SPACE = white_table()
#: Byte hashes that see A-Z as a-z.
FOLDED = BYTE.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts. Null is empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or offs[0] == offs[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()``, kept in this Python worker for later tasks in place of what was kept before."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Free what another operator has kept: workers serve the tasks of all operators of a session."""
    if _kept:
        _kept.clear()
        gc.collect()


_powers = np.zeros(0, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(256, n + (n >> 2)), P, U))
    return _powers


class Words:
    """Words of a slice of texts: where they start and end, and the first word of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
        n = len(data)
        self.data, self.offs, self.space = data, offs, space
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            gap = space[data]
            first, last = np.ones(n, bool), np.ones(n, bool)
            first[1:] = gap[:-1]
            last[:-1] = gap[1:]
            inner = offs[(offs > 0) & (offs < n)]
            first[inner] = True
            last[inner - 1] = True
            self.starts = np.flatnonzero(first & ~gap)
            self.ends = np.flatnonzero(last & ~gap) + 1
        self.row_of = np.searchsorted(offs, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, offs[:-1])
        self.stop = np.searchsorted(self.starts, offs[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, table: np.ndarray = BYTE) -> np.ndarray:
        """One 64-bit value per word; equal words have equal values."""
        if not len(self):
            return np.zeros(0, U)
        lens = self.ends - self.starts
        spans = np.diff(np.append(self.starts, self.ends[-1]))
        inside = np.arange(self.starts[0], self.ends[-1]) - np.repeat(self.starts, spans)
        far = np.repeat(lens, spans)
        term = table[self.data[self.starts[0] : self.ends[-1]]] * powers(int(spans.max()))[inside]
        term[inside >= far] = 0
        return mix(np.add.reduceat(term, self.starts - self.starts[0]) + lens.astype(U))


def grams(h: np.ndarray, k: int, rolled: int = 1) -> np.ndarray:
    """Order-dependent hash of ``k`` values from each position on; short by k - 1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * P + h[j : j + n]
    return mix(out)


def byte_grams(data: np.ndarray, k: int = 32) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on, k a power of two from 8; short by k - 1."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    flat = np.ascontiguousarray(data)
    h = mix(np.lib.stride_tricks.as_strided(flat[: len(flat) - 7].view(), (len(flat) - 7, 8), (1, 1)).copy().view("<u8").reshape(-1))
    step = 8
    while step < k:
        h = mix(h[: len(h) - step] * P + h[step:])
        step *= 2
    return h[:n]


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of ``w`` consecutive values from each position on, in a few passes."""
    n = len(key)
    if n < w:
        return np.zeros(0, key.dtype)
    pad = -n % w
    full = np.concatenate([key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def bitmap(df: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A fixed-size bitmap of the values of a long column, as bytes; ``bits`` bounds what is sent.

    A test against it may say yes to other values, never no to one of ``df``.
    """
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = (
        df.select((slot / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 32) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    words = np.zeros(bits // 32, "<u4")
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return words


def in_bitmap(words: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = (value & U(len(words) * 32 - 1)).astype(np.int64)
    return (words[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) > 0


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a table in the shared folder, for what a loop carries on.

    A checkpoint keeps the estimated size of the plan it cuts, which a join in every round
    raises to a power; a table has its real size.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove a stored table that no later step reads."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Edges that one task joins by itself.
EDGES = 1 << 17


def joined_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: every node with the smallest node it reaches there."""
    let_go()
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    node, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    low = np.arange(len(node))
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low != low[low]).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[low[moved]])], names=["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the smallest node.

    Tasks of at most about ``EDGES`` edges first reduce theirs to stars, as long as that
    halves them; what fits one such task is settled by it. For the others there are
    large-star and small-star rounds; each node's smallest neighbour is a partial
    aggregate, and a hub's edges are split by the join, so no task holds a
    component. Each round is stored, and ends when the edges no longer change.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    n, settled = edges.count(), False
    while n and not settled:
        parts = -(-n // EDGES)
        before, edges = edges, stored(prepare(edges).repartition(parts).mapInArrow(joined_edges, "u long, v long"))
        drop(before)
        was, n, settled = n, edges.count(), parts == 1
        if 2 * n > was:
            break
    if n and not settled:
        edges = star_rounds(edges, max_rounds)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def star_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The edges (u, v) as one star around the smallest node of each component."""
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, stored(small)
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen = now
    raise RuntimeError("components did not settle")
