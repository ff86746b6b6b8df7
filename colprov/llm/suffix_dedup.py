"""Remove byte strings that occur twice or more, from a column-wise multi-document suffix order.

``repeated_windows`` decides, for every ``length``-byte window of every text, whether the
same bytes also start anywhere else. Windows meet by anchor (see ``anchors``); each
block of anchored pieces then gets its collection structure column by column:
``ColumnOrder`` inserts one symbol of every piece each round, from the right end to
the left, and updates the order of all suffixes that start in that column (the
Burrows-Wheeler column is the symbols in that order) together with the common
prefix of neighbours. Pieces lie with their anchors in one column, so equal windows
always start in the same round and only the newest column must be in memory; older
columns are not rewritten. A window repeats when its common prefix with a neighbour
reaches ``length``, or its whole piece occurs twice.

Columns are a sequential file read once, backwards: in memory up to ``HELD`` bytes,
beyond that in the task's own unnamed scratch file, which vanishes with the task.

Nulls are empty texts; texts shorter than a window lose nothing; equal rows are two
documents, so both lose what they repeat. Extra columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.anchors import blocks, pieces, shared_runs
from colprov.llm.common import byte_grams, prepare, slices, text_bytes

LENGTH = 200
GRAM = 32
BLOCK = 8192
HELD = 64 << 20


def byte_units(data: np.ndarray, offs: np.ndarray, gram: int):
    return byte_grams(data, gram), offs[:-1], offs[1:]


def cut_bytes(data, offs, row, start, n, length=LENGTH):
    """The bytes of each run, as one binary array."""
    begin = offs[row] + start
    size = n.astype(np.int64) + length - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take]))]
    ).cast(pa.binary())


class ColumnFile:
    """Symbols of many pieces by column, written in groups of pieces and read column by column."""

    def __init__(self, width: int):
        self.width = width
        self.parts: list[tuple[int, int]] = []
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, table: np.ndarray) -> None:
        """``table``: one row of symbols for each column of the alignment."""
        self.parts.append((self.file.seek(0, 2), table.shape[1]))
        self.file.write(np.ascontiguousarray(table).tobytes())

    def column(self, k: int) -> np.ndarray:
        out = []
        for at, rows in self.parts:
            self.file.seek(at + k * rows)
            out.append(np.frombuffer(self.file.read(rows), np.uint8))
        return np.concatenate(out)


class ColumnOrder:
    """Suffix order and common prefixes of the pieces that are open in the current column.

    ``order`` lists pieces by their suffix from the current column on; ``ends[i]`` is the
    column in which the match of piece i with piece i - 1 of the order ends.
    """

    def __init__(self):
        self.order = np.zeros(0, np.int32)
        self.ends = np.zeros(0, np.int16)

    def leave(self, gone: np.ndarray) -> None:
        """Drop pieces whose first symbol was inserted; a gap keeps the shortest match it spans."""
        keep = np.flatnonzero(~gone[self.order])
        if len(keep) == len(self.order):
            return
        if len(keep):
            from_ = np.concatenate([[0], keep[:-1] + 1])
            self.ends = np.minimum.reduceat(self.ends[: keep[-1] + 1], from_)
        else:
            self.ends = self.ends[:0]
        self.order = self.order[keep]

    def enter(self, new: np.ndarray, column: int) -> None:
        """Pieces that end here start as empty suffixes, before all others."""
        if not len(new):
            return
        if len(self.order):
            self.ends[0] = column
        self.order = np.concatenate([new, self.order])
        self.ends = np.concatenate([np.full(len(new), column, np.int16), self.ends])

    def insert(self, symbols: np.ndarray, column: int) -> np.ndarray:
        """One symbol of each piece goes in front of its suffix; returns the Burrows-Wheeler column."""
        bwt = symbols[self.order]
        to = np.argsort(bwt, kind="stable")
        moved = bwt[to]
        ends = np.full(len(to), column, np.int16)
        same = np.flatnonzero(moved[1:] == moved[:-1])
        if len(same):
            ends[same + 1] = range_min(self.ends, to[same] + 1, to[same + 1])
        self.order, self.ends = self.order[to], ends
        return bwt


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value of each closed range."""
    span = hi - lo + 1
    level = (np.frexp(span.astype(np.float32))[1] - 1).astype(np.int64)
    n, rows = len(values), int(level.max()) + 1
    table = np.empty((rows, n), values.dtype)
    table[0] = values
    for k in range(1, rows):
        step = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1][: n - step], table[k - 1][step:], out=table[k][: n - step])
    flat = table.reshape(-1)
    base = level * n
    return np.minimum(flat[base + lo], flat[base + hi + 1 - (1 << level)])


def settle_block(piece_bytes, offs, at, n, count, length=LENGTH, gram=GRAM) -> np.ndarray:
    """Which windows of each piece repeat: one row of bits per piece (packed, little end first)."""
    w = length - gram + 1
    m = len(at)
    first = (w - 1) - at.astype(np.int64)
    stop = first + n + length - 1
    width = int(stop.max())
    file = ColumnFile(width)
    group = max(1024, (16 << 20) // width)
    for lo in range(0, m, group):
        hi = min(m, lo + group)
        size = offs[lo + 1 : hi + 1] - offs[lo:hi]
        table = np.zeros((width, hi - lo), np.uint8)
        inside = np.arange(offs[hi] - offs[lo]) - np.repeat(offs[lo:hi] - offs[lo], size)
        table.reshape(-1)[(np.repeat(first[lo:hi], size) + inside) * (hi - lo) + np.repeat(np.arange(hi - lo), size)] = piece_bytes[offs[lo] : offs[hi]]
        file.add(table)
    marks = np.zeros((m, w), bool)
    marks[count > 1] = True
    by_stop, by_first = np.argsort(stop, kind="stable").astype(np.int32), np.argsort(first, kind="stable")
    at_stop, at_first = np.searchsorted(stop[by_stop], np.arange(width + 2)), np.searchsorted(first[by_first], np.arange(width + 2))
    state, gone = ColumnOrder(), np.zeros(m, bool)
    for column in range(width - 1, -1, -1):
        done = by_first[at_first[column + 1] : at_first[column + 2]]
        if len(done):
            gone[done] = True
            state.leave(gone)
        state.enter(by_stop[at_stop[column + 1] : at_stop[column + 2]], column + 1)
        if not len(state.order):
            continue
        state.insert(file.column(column), column)
        if column < w:
            near = state.ends >= column + length
            near[0] = False
            if near.any():
                near[:-1] |= near[1:]
                found = state.order[near]
                marks[found, column - first[found]] = True
    marks &= np.arange(w) < n[:, None]
    return np.packbits(marks, axis=1, bitorder="little")


def settle(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK):
        block = block.combine_chunks()
        data, offs = text_bytes(block.column("piece").combine_chunks() if block.num_rows else block.column("piece"))
        bits = settle_block(data, offs, block.column("at").to_numpy(), block.column("n").to_numpy(), block.column("count").to_numpy(), length, gram)
        hit = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block.column("h").to_numpy()[hit]),
                pa.array(block.column("c").to_numpy()[hit]),
                pa.array([x.tobytes() for x in bits[hit]], pa.binary()),
            ],
            names=["h", "c", "bits"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): tid tells apart different texts under one doc_id; a null id is -1."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc_id"),
        F.xxhash64("text").alias("tid"),
        F.col("text"),
    )


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, tid, start, bits): bit i tells that the window at byte start + i repeats."""
    docs = keyed(docs)
    members = shared_runs(docs, byte_units, length, gram)
    contents = members.groupBy("h", "c", "at", "n").agg(
        F.count("*").alias("count"), F.min(F.struct("doc_id", "tid", "start")).alias("one")
    )
    wanted = contents.select("one.*", "h", "c", "count", F.lit(0).cast("long").alias("low"), "at", "n")
    cutter = lambda data, offs, row, start, n: cut_bytes(data, offs, row, start, n, length)
    rows = pieces(docs, wanted, cutter, "h long, c long, count long, low long, at short, n short, piece binary")
    settled = (
        rows.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: settle(it, length, gram), "h long, c long, bits binary")
    )
    return members.join(settled, ["h", "c"]).select("doc_id", "tid", "start", "bits")


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` plus ``_windows``: the list of (start, bits) of each row, null without any."""
    marks = repeated_windows(docs, length, gram).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "bits")).alias("__windows"))
    left = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))).withColumn("__tid", F.xxhash64("text"))
    right = marks.withColumnRenamed("doc_id", "__id").withColumnRenamed("tid", "__tid")
    return left.join(right, ["__id", "__tid"], "left").drop("__id", "__tid")


def cover(part: pa.RecordBatch, offs: np.ndarray, length: int) -> np.ndarray:
    """True for each byte of the slice that a repeated window covers."""
    edge = np.zeros(int(offs[-1]) + 1, np.int32)
    lists = part.column("__windows")
    lens = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    if len(flat):
        row = np.repeat(np.arange(part.num_rows), lens)
        raw, at = text_bytes(flat.field("bits"))
        bits = np.unpackbits(raw, bitorder="little")
        on = np.flatnonzero(bits)
        k = np.searchsorted(at * 8, on, side="right") - 1
        begin = offs[row[k]] + flat.field("start").to_numpy()[k] + (on - at[k] * 8)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: bytes, removed bytes, removed runs, and the digest of what is kept."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                gone = cover(part, offs, length)
                removed, spans, shas = [], [], []
                for a, b in zip(offs[:-1], offs[1:]):
                    g = gone[a:b]
                    removed.append(int(g.sum()))
                    spans.append(int((g[1:] & ~g[:-1]).sum() + (1 if b > a and g[0] else 0)))
                    shas.append(hashlib.sha256(data[a:b][~g].tobytes() if removed[-1] else data[a:b].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram)
    return prepare(rows.select("doc_id", "text", "__windows")).mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeated byte removed from ``text``, all other columns as they were.

    A character of which only some bytes were removed goes as a whole. A null text stays null.
    """
    names = docs.columns

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                gone = cover(part, offs, length)
                valid = part.column("text").is_valid().to_pylist()
                texts = [
                    data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if ok else None
                    for a, b, ok in zip(offs[:-1], offs[1:], valid)
                ]
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return prepare(with_spans(docs, length, gram).select(*names, "__windows")).mapInArrow(work, docs.schema)
