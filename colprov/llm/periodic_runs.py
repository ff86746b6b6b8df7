"""Periodic runs of words in whole texts, by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, at least ``least`` words and
``power`` periods long, that neither neighbour extends. Each of its words occurs in it
``power`` times or more, so a word found fewer times in a segment lies in no run of that
segment and splits it. Splitting goes on, each round over the segments that the round
before has changed, until no word splits. In each surviving segment, of length m, every
lag up to m / power is scanned: a run of lag q covers at least ``power - 1`` whole blocks
of those that start at multiples of q, and equal neighbouring blocks are found by their
residues (m / q comparisons for lag q, m log m for all). What they show is compared word
by word; a lag that is a multiple of the period is known by the residues of one block.

Words are compared by 64-bit hashes, periods inside a block by two residues of 31 bits.

Every row of the input gives one row. A null text, an empty one and one of white space
have no words: no runs, an empty collapsed text. Repeated rows and ids are rows like any
other, a null id stays null, an empty table gives none. Of runs that share words each is
reported; a stretch that has several periods counts once, with the smallest. Whole texts
are read; a long one is a slice of its own and takes about 100 bytes a word. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import P, U, Words, let_go, mix, prepare, slices, text_bytes

LEAST, POWER = 6, 4
MODULI = ((2147483647, 1103515245), (2147483629, 1181783497))
KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving(h: np.ndarray, row: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments start and end that no word splits: all runs lie inside one.

    ``h``: word hashes of consecutive texts, ``row``: the text of each word.
    """
    at, part = np.arange(len(h)), row
    starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        long = size >= least
        at = at[np.repeat(long, size)]
        if not len(at):
            break
        size = size[long]
        part = np.repeat(np.arange(len(size)), size)
        key = mix(h[at] + part.astype(U) * P)  # equal keys of unequal words would only split less
        order = np.argsort(key, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        count = np.diff(np.append(np.flatnonzero(new), len(at)))
        rare = np.empty(len(at), bool)
        rare[order] = np.repeat(count < power, count)
        begin = np.cumsum(size) - size
        split = np.add.reduceat(rare, begin, dtype=np.int64) > 0
        starts.append(at[begin[~split]])
        stops.append(at[begin[~split]] + size[~split])
        go = ~rare & split[part]
        at, part = at[go], part[go]
    return np.concatenate(starts), np.concatenate(stops)


class Residues:
    """Prefix sums of weighted word hashes modulo two primes."""

    def __init__(self, h: np.ndarray):
        self.power, self.sum = [], []
        for prime, base in MODULI:
            w, step = np.ones(1, np.int64), base
            while len(w) <= len(h):
                w = np.concatenate([w, w * step % prime])
                step = step * step % prime
            value = (h % U(prime)).astype(np.int64)
            self.power.append(w)
            self.sum.append(np.concatenate([[0], np.cumsum(value * w[: len(h)] % prime)]) % prime)

    def equal(self, a: int, b: int, n: int) -> bool:
        """Whether the ``n`` words from a are those from b, a <= b."""
        for (prime, _), w, s in zip(MODULI, self.power, self.sum):
            if int(s[a + n] - s[a]) * int(w[b - a]) % prime != int(s[b + n] - s[b]) % prime:
                return False
        return True

    def same_as_next(self, at: np.ndarray, q: int) -> np.ndarray:
        """Of blocks of q words that start at ``at`` and follow each other: is the next one the same? Short by two."""
        prime = MODULI[0][0]
        s = self.sum[0][at]
        d = s[1:] - s[:-1]
        return (d[:-1] * self.power[0][q] - d[1:]) % prime == 0


def prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def stretches(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last index of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], yes.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lag_scan(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) inside the given segments, by start, then period."""
    if not len(starts):
        return []
    size = stops - starts
    by = np.argsort(-size, kind="stable")
    starts, size = starts[by], size[by]
    found: dict[tuple[int, int], int] = {}
    sums = Residues(h)
    q = 0
    while True:
        q += 1
        live = int(np.searchsorted(-size, -max(least, power * q), side="right"))
        if not live:
            break
        blocks = size[:live] // q + 1
        ends = np.cumsum(blocks)
        at = np.repeat(starts[:live] - (ends - blocks) * q, blocks) + np.arange(ends[-1]) * q
        same = sums.same_as_next(at, q)
        for edge in (ends[:-1] - 1, ends[:-1] - 2):  # the next block lies in another segment
            same[edge] = False
        near = same
        for k in range(1, power - 2):
            near = near[:-1] & same[k:]
        if not near.any():
            continue
        factors = prime_factors(q)
        for a, b in zip(*(x.tolist() for x in stretches(same))):
            if b - a < power - 2:
                continue
            low, high = int(at[a]), int(at[b + 1])
            if any(sums.equal(low, low + q // r, q - q // r) for r in factors):
                continue  # a run of a shorter period
            owner = int(np.searchsorted(ends, a, side="right"))
            first, last = int(starts[owner]), int(starts[owner] + size[owner])
            lo, hi = max(first, low - q), min(last, high + q)
            eq = h[lo : hi - q] == h[lo + q : hi]
            inside = slice(low - lo, high - q - lo)
            if not eq[inside].all():  # equal residues of unequal words
                lo, hi = first, last
                eq, inside = h[lo : hi - q] == h[lo + q : hi], slice(0, last - first)
            for x, y in zip(*(x.tolist() for x in stretches(eq))):
                if y - x + q >= max(least, power * q) and x < inside.stop and y > inside.start:
                    found.setdefault((lo + x, lo + y + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    rows = len(words.offs) - 1
    row = words.row_of[keep]
    a, b = words.starts[keep], words.ends[keep]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    size = b - a + ~last
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(a - (ends - size), size)
    out = words.data[np.minimum(source, len(words.data) - 1)] if total else np.zeros(0, np.uint8)
    out[ends[~last] - 1] = 32
    offs = np.concatenate([[0], np.cumsum(np.bincount(row, size, rows).astype(np.int64))]).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(out)))


def collapse(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per row: doc_id, n_words, its ``runs`` by start, then period, and ``collapsed``, the text
    without what follows the first period of a run, words joined by one space."""
    if power < 3 or least < 1:
        raise ValueError("runs need a power of three or more")

    def work(batches: Iterator[pa.RecordBatch]):
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(*text_bytes(part.column("text")))
                h = w.hashes()
                runs = lag_scan(h, *surviving(h, w.row_of, least, power), least, power)
                gone = np.zeros(len(w) + 1, np.int64)
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                values = np.array(runs, np.int64).reshape(-1, 3)
                row = w.row_of[values[:, 0]]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                fields = [pa.array(values[:, 0] - w.first[row]), pa.array(values[:, 1]), pa.array(values[:, 2])]
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(KIND.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.stop - w.first), listed, joined(w, np.cumsum(gone[:-1]) == 0)],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<start: long, length: long, period: long>>"
    return prepare(rows).mapInArrow(work, f"doc_id long, n_words long, runs {kind}, collapsed string")


def rewound(docs: DataFrame) -> DataFrame:
    """The contract's texts: one document in ten, by the checksum of its id, repeats a stretch to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    texts = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words: Column = F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    texts = texts.select("doc_id", "text", "g", words.alias("w")).withColumn("n", F.size("w"))
    texts = texts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return texts.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of runs and texts."""
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return collapsed.withColumn("b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("-((1000 * b.length) div b.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
