"""Remove passages already seen in an earlier document, by backward search over FM-indexes.

A window is ``length`` consecutive words. Windows meet by anchor (see ``anchors``), which
deals the corpus into shards. A shard holds every distinct piece once, with the smallest
document id that has it, as a compressed FM-index: the Burrows-Wheeler transform of the
pieces in a wavelet matrix of packed bits with sampled ranks. Pieces are then streamed
through it from right to left; backward search carries the suffix interval of what is
matched so far, dropped to ``length - 1`` words before each further one (all suffixes
that agree on that many words are neighbours). Each window whose matching statistic
reaches ``length`` reports the smallest document of its interval, and a document loses
the words of the windows that a smaller document has.

Words are runs of bytes other than ASCII white space, unchanged. A null text has no
words. A null document id takes no part and loses nothing; rows repeated under one id
are one document. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.anchors import blocks, pieces, shared_runs
from colprov.llm.common import U, Words, grams, prepare, slices, text_bytes

LENGTH = 50
GRAM = 8
BLOCK = 2500


def word_units(data: np.ndarray, offs: np.ndarray, gram: int):
    w = Words(data, offs)
    return grams(w.hashes(), gram), w.first, w.stop


def cut_words(data, offs, row, start, n, length=LENGTH):
    """The 32-bit word ids of each run, as one list array."""
    w = Words(data, offs)
    ids = (w.hashes() >> U(32)).astype(np.uint32).view(np.int32)
    begin = w.first[row] + start
    size = n.astype(np.int64) + length - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[take]))


class WaveletMatrix:
    """Rank of any symbol in packed bits: one bit vector per bit of the alphabet."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.size = len(values)
        self.words, self.ranks, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            packed = np.packbits(one.astype(bool), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int32))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[one == 0], values[one == 1]])
        self.base = np.zeros(sigma, np.int64)
        self.base = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, less a constant of the symbol until ``base`` is set."""
        pos = at
        for level in range(self.bits):
            word = pos >> 6
            inside = (U(1) << (pos & 63).astype(U)) - U(1)
            ones = self.ranks[level][word] + np.bitwise_count(self.words[level][word] & inside)
            pos = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, pos - ones)
        return pos - self.base[symbol]


class FMIndex:
    """Backward search over word sequences, with the smallest document of each suffix interval."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, low: np.ndarray, length: int):
        m = len(offs) - 1
        known, symbol = np.unique(ids, return_inverse=True)
        self.sigma = len(known) + 1
        text = np.zeros(len(ids) + m, np.int64)
        piece = np.repeat(np.arange(m), np.diff(offs))
        self.place = np.arange(len(ids)) + piece  # a separator, symbol 0, follows each piece
        text[self.place] = symbol + 1
        owner = np.zeros(len(text), np.int64)
        owner[self.place] = piece
        owner[np.append(self.place[1:][piece[1:] != piece[:-1]] - 1, len(text) - 1)] = np.arange(m)
        rank, depth, at = text.copy(), 1, {1: text}
        while depth < length:
            step = min(depth, length - depth)
            far = np.zeros_like(rank)
            far[: len(rank) - step] = rank[step:] + 1
            _, rank = np.unique(rank * (len(text) + 2) + far, return_inverse=True)
            depth += step
            if depth == length - 1:
                at[depth] = rank
            at[depth] = rank
        if length - 1 not in at:  # equal on length - 1 words: equal on a prefix and on the words that end there
            half = max(d for d in at if d < length)
            shift = length - 1 - half
            far = np.zeros_like(rank)
            far[: len(rank) - shift] = at[half][shift:] + 1
            _, at[length - 1] = np.unique(at[half] * (len(text) + 2) + far, return_inverse=True)
        sa = np.argsort(rank, kind="stable")
        self.text, self.length = text, length
        self.bwt = WaveletMatrix(text[sa - 1], self.sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        full, less = rank[sa], at[length - 1][sa]
        begin = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
        self.group = np.cumsum(np.append(False, full[1:] != full[:-1]))
        self.smallest = np.minimum.reduceat(low[owner[sa]], begin)
        begin = np.flatnonzero(np.append(True, less[1:] != less[:-1]))
        group = np.cumsum(np.append(False, less[1:] != less[:-1]))
        self.left, self.right = begin[group], np.append(begin[1:], len(text))[group]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The interval of what is matched with ``symbol`` in front of it."""
        return self.before[symbol] + self.bwt.rank(symbol, lo), self.before[symbol] + self.bwt.rank(symbol, hi)

    def stream(self, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window of every piece: words matched and the smallest document that has it."""
        m = len(offs) - 1
        size = np.diff(offs)
        n = size - self.length + 1
        out = np.concatenate([[0], np.cumsum(n)])
        stat, low = np.zeros(out[-1], np.int32), np.zeros(out[-1], np.int64)
        live = np.argsort(-size, kind="stable")
        size = size[live]
        end = (offs[:-1] + np.arange(m) + np.diff(offs) - 1)[live]
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.text), np.int64)
        for t in range(int(size[0]) if m else 0):
            k = int(np.searchsorted(-size, -t, side="left"))  # pieces longer than t
            lo, hi = lo[:k], hi[:k]
            if t >= self.length:
                lo, hi = self.left[lo], self.right[hi - 1]
            lo, hi = self.extend(self.text[end[:k] - t], lo, hi)
            if t >= self.length - 1:
                slot = out[live[:k]] + size[:k] - 1 - t
                stat[slot] = np.where(hi > lo, self.length, 0)
                low[slot] = self.smallest[self.group[lo]]
        return stat, low


def settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK):
        block = block.combine_chunks()
        lists = block.column("piece").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offs = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.flatten().to_numpy()
        offs = offs - offs[0]
        index = FMIndex(ids, offs, block.column("low").to_numpy(), length)
        stat, low = index.stream(offs)
        n = np.diff(offs) - length + 1
        found = np.where(stat >= length, low, np.iinfo(np.int64).max)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.column("h").to_numpy()), pa.array(block.column("c").to_numpy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))],
            names=["h", "c", "lows"],
        )


def seen_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, tid, start, bits): bit i tells that a smaller document has the window at word start + i."""
    if length - gram + 1 > 62:
        raise ValueError("a run's windows must fit the bits of a long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text").where("doc_id is not null")
    members = shared_runs(docs, word_units, length, gram)
    contents = members.groupBy("h", "c", "at", "n").agg(
        F.count("*").alias("count"), F.min(F.struct("doc_id", "tid", "start")).alias("one")
    )
    wanted = contents.select("one.*", "h", "c", "count", F.col("one.doc_id").alias("low"), "at", "n")
    cutter = lambda data, offs, row, start, n: cut_words(data, offs, row, start, n, length)
    rows = pieces(docs, wanted, cutter, "h long, c long, count long, low long, at short, n short, piece array<int>")
    settled = rows.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: settle(it, length), "h long, c long, lows array<long>")
    bits = F.expr("aggregate(transform(lows, (m, i) -> IF(m < doc_id, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    return members.join(settled, ["h", "c"]).select("doc_id", "tid", "start", bits.alias("bits")).where("bits <> 0")


def kept_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: words, removed words, and the digest of the kept words joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    marks = seen_windows(docs, length, gram).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "bits")).alias("seen"))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*text_bytes(part.column("text")))
                edge = np.zeros(len(w) + 1, np.int32)
                lists = part.column("seen")
                flat = lists.flatten()
                if len(flat):
                    row = np.repeat(np.arange(part.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                    on = (flat.field("bits").to_numpy()[:, None] >> np.arange(length - gram + 1)) & 1
                    k, i = np.nonzero(on)
                    begin = w.first[row[k]] + flat.field("start").to_numpy()[k] + i
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                # kept words, each followed by a space; a row's last space is left out
                keep = ~gone
                size = (w.ends - w.starts + 1)[keep]
                ends = np.concatenate([[0], np.cumsum(size)])
                line = np.full(int(ends[-1]), 32, np.uint8)
                inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
                letter = inside < np.repeat(size - 1, size)
                line[letter] = w.data[(np.repeat(w.starts[keep], size) + inside)[letter]]
                count = np.concatenate([[0], np.cumsum(keep)])
                a, b = ends[count[w.first]], ends[count[w.stop]]
                shas = [hashlib.sha256(line[x : max(x, y - 1)].tobytes()).hexdigest() for x, y in zip(a, b)]
                total = w.stop - w.first
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total), pa.array(total - (count[w.stop] - count[w.first])), pa.array(shas)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    joined = rows.join(marks, ["doc_id", "tid"], "left").select("doc_id", "text", "seen")
    return prepare(joined).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
