"""Bring equal windows of long texts together without shipping the texts.

A window is ``length`` consecutive units (bytes or words). Its anchor is the gram of
``gram`` units with the smallest hash inside it, the leftmost of equal ones. Equal
windows have equal anchors at the same place, so a window can only repeat among the
windows of its anchor. Consecutive windows with one anchor make a run: a piece of
at most ``2 * length - gram`` units that holds the anchor at a known place.

``shared_runs`` keeps the runs whose anchor occurs in two runs or more; an anchor
that occurs once settles its windows as unique. Counts are partial aggregates, and
the join back is an ordinary join whose heavy keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import U, bitmap, in_bitmap, mix, prepare, sliding_min, slices, stored, text_bytes

RUN = "doc_id long, tid long, h long, c long, start int, at short, n short"


def find_runs(g: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int, gram: int):
    """Runs of a slice: row, first window, anchor hash, anchor's place in the run, windows, content hash.

    ``g`` holds the gram hash from each unit on; ``first`` and ``stop`` are the units of each row.
    """
    w = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(g) < w:
        return none, none, none.astype(U), none, none, none.astype(U)
    bits = U(max(1, int(len(g)).bit_length()))
    low = (U(1) << bits) - U(1)
    place = (sliding_min((g & ~low) | np.arange(len(g), dtype=U), w) & low).astype(np.int64)
    long = stop - first >= length
    edge = np.zeros(len(place) + 1, np.int32)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, stop[long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    new[first[long]] = True
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none, none.astype(U), none, none, none.astype(U)
    n = np.add.reduceat(valid.astype(np.int64), begin)
    row = np.searchsorted(np.where(long, first, -1)[long], begin, side="right") - 1
    row = np.flatnonzero(long)[row]
    n = np.minimum(n, stop[row] - length + 1 - begin)
    at = place[begin] - begin
    last = begin + n - 1 + length - gram
    c = mix(n.astype(U))
    for j in range(0, length + w, gram):
        c = mix(c * U(3) + g[np.minimum(begin + j, last)])
    return row, begin, g[place[begin]], at, n, c


def runs(docs: DataFrame, units: Callable, length: int, gram: int, named: Broadcast | None = None) -> DataFrame:
    """Every run of every row of ``docs`` (doc_id, tid, text), but for those whose anchor a bitmap does not name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                g, first, stop = units(*text_bytes(part.column("text")), gram)
                found = find_runs(g, first, stop, length, gram)
                if named is not None:
                    keep = in_bitmap(named.value, found[2])
                    found = tuple(x[keep] for x in found)
                row, begin, h, at, n, c = found
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        part.column("tid").take(pa.array(row)),
                        pa.array(h.view(np.int64)),
                        pa.array(c.view(np.int64)),
                        pa.array((begin - first[row]).astype(np.int32)),
                        pa.array(at.astype(np.int16)),
                        pa.array(n.astype(np.int16)),
                    ],
                    names=["doc_id", "tid", "h", "c", "start", "at", "n"],
                )

    return prepare(docs).mapInArrow(work, RUN)


def shared_runs(docs: DataFrame, units: Callable, length: int, gram: int) -> DataFrame:
    """The runs whose anchor occurs at least twice, cut."""
    often = stored(runs(docs, units, length, gram).groupBy("h").count().where("count > 1").select("h"))  # a plain table, so that the join can split
    named = docs.sparkSession.sparkContext.broadcast(bitmap(often, "h"))  # of fixed size
    return stored(runs(docs, units, length, gram, named).join(often, "h"))


def pieces(docs: DataFrame, wanted: DataFrame, extract: Callable, schema: str) -> DataFrame:
    """Rows (h, c, count, low, at, n, piece) for ``wanted`` runs, cut out of the texts.

    ``wanted`` has one run of each content; a text gets the list of its own runs only, and
    texts that a bitmap of fixed size tells to have none are not shuffled.
    """
    wanted = stored(wanted)
    named = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("tid").distinct(), "tid"))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(in_bitmap(named.value, batch.column("tid").to_numpy().view(U)))))

    docs = prepare(docs.select("doc_id", "tid", "text")).mapInArrow(only, "doc_id long, tid long, text string")
    lists = wanted.groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("start", "h", "c", "count", "low", "at", "n")).alias("runs")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lists = part.column("runs")
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                field = lambda k: flat.field(k)
                piece = extract(*text_bytes(part.column("text")), row, field("start").to_numpy(), field("n").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [field(k) for k in ("h", "c", "count", "low", "at", "n")] + [piece],
                    names=["h", "c", "count", "low", "at", "n", "piece"],
                )

    return prepare(docs.join(lists, ["doc_id", "tid"])).select("text", "runs").mapInArrow(work, schema)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows in which all rows of an anchor are together; input is sorted by h."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            h = batch.column("h").to_numpy()
            last = held[-1].column("h")[-1].as_py()
            same = int(np.searchsorted(h != last, True)) if h[0] == last else 0
            held.append(batch.slice(0, same))
            batch = batch.slice(same)
            if not batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, count = [], 0
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
