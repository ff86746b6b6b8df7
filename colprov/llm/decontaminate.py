"""Benchmark decontamination by spaced-seed hashing.

Each mask looks at ``SPAN`` consecutive words and ignores fixed positions, so a
substituted word does not hide a passage. The masked hashes of the benchmark are joined
with those of the documents; a fixed-size bitmap of the benchmark's hashes first drops
document positions that cannot meet any. A hit gives a document, an item and an
alignment. Each distinct alignment is then verified on the words themselves: any run on
it that holds at least ``min(item words, least)`` matching words at a similarity of
``num / den`` or more counts, and the run with most matches is reported. Items of up to
``least`` words must therefore match in every word.

Words are runs of ASCII letters and digits and of all non-ASCII characters, in lower case.
Items shorter than a span hash as a whole (exactly); items of fewer than five words and
null items match nothing. Null or empty texts are clean. Every row of the documents
comes back, repeated rows too; equal items count once per item id. A null document id
is an id like any other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import BYTE, P, U, Words, bitmap, in_bitmap, mix, prepare, slices, text_bytes
from colprov.session import cut

SPAN = 10
#: Fixed masks; 1 looks at a word, 0 ignores it.
MASKS = ("1101101011", "1011010111", "1110011011")
SHORTEST = 5
LEAST = 13
BITS = 1 << 26


def other_table() -> np.ndarray:
    t = np.ones(256, bool)
    for a, b in ("09", "AZ", "az"):
        t[ord(a) : ord(b) + 1] = False
    t[128:] = False
    return t


OTHER = other_table()


def seeds(span: int) -> list[list[int]]:
    """Positions that count, for each mask; a short item is one mask that sees all."""
    if span < SPAN:
        return [list(range(span))]
    return [[i for i, x in enumerate(m) if x == "1"] for m in MASKS]


def masked(h: np.ndarray, span: int, positions: list[int], number: int) -> np.ndarray:
    n = max(0, len(h) - span + 1)
    out = np.full(n, U(span * 16 + number))
    for i in positions:
        out = out * P + h[i : i + n]
    return mix(out)


def read_words(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    w = Words(*text_bytes(part.column("text")), OTHER)
    return w, w.hashes(BYTE)


def lowered(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias(key), F.xxhash64("text").alias("tid"), F.lower("text").alias("text"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, words): the word hashes of every item of at least five words."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w, h = read_words(part)
                keep = np.flatnonzero(w.stop - w.first >= SHORTEST)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(keep)), pa.array([h[w.first[i] : w.stop[i]].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                    names=["item_id", "words"],
                )

    return prepare(lowered(benchmark, "item_id")).mapInArrow(work, "item_id long, words array<long>").distinct()


def item_seeds(items: DataFrame) -> DataFrame:
    """Rows (g, item_id, version, place) of every masked hash of every item."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for item, version, words in zip(batch.column("item_id").to_pylist(), batch.column("version").to_pylist(), batch.column("words")):
                h = words.values.to_numpy().view(U)
                span = min(SPAN, len(h))
                g = [masked(h, span, at, k) for k, at in enumerate(seeds(span))]
                place = np.concatenate([np.arange(len(x)) for x in g]).astype(np.int32)
                g = np.concatenate(g).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(np.full(len(g), item)), pa.array(np.full(len(g), version)), pa.array(place)],
                    names=["g", "item_id", "version", "place"],
                )

    return items.mapInArrow(work, "g long, item_id long, version long, place int")


def alignments(docs: DataFrame, items: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct rows (doc_id, tid, item_id, version, shift) on which a masked hash agrees."""
    tests = cut(item_seeds(items))
    spans = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN))).distinct().collect())  # at most six values
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(tests, "g", bits))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w, h = read_words(part)
                for span in spans:
                    for k, at in enumerate(seeds(span)):
                        g = masked(h, span, at, k)
                        hit = np.flatnonzero(in_bitmap(shared.value, g))
                        row = w.row_of[hit]
                        inside = hit + span <= w.stop[row]
                        hit, row = hit[inside], row[inside]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc_id").take(pa.array(row)),
                                part.column("tid").take(pa.array(row)),
                                pa.array((hit - w.first[row]).astype(np.int32)),
                                pa.array(g[hit].view(np.int64)),
                            ],
                            names=["doc_id", "tid", "at", "g"],
                        )

    hits = prepare(lowered(docs, "doc_id")).mapInArrow(work, "doc_id long, tid long, at int, g long")
    return hits.join(tests, "g").select("doc_id", "tid", "item_id", "version", (F.col("at") - F.col("place")).alias("shift")).distinct()


def best_run(same: np.ndarray, num: int = 4, den: int = 5) -> tuple[int, int]:
    """Matching words and length of the run with most matches, then the shortest, of all at a similarity of ``num / den`` or more."""
    matches = np.concatenate([[0], np.cumsum(same)])
    spare = den * matches - num * np.arange(len(same) + 1)
    # for each end, the first begin that leaves the run at the similarity; matches only grow with the length
    begin = np.searchsorted(-np.minimum.accumulate(spare), -spare)
    held = matches - matches[begin]
    most = int(held.max())
    if not most:
        return 0, 0
    end, at = np.flatnonzero(held == most), np.flatnonzero(same)
    return most, int((at[matches[end] - 1] - at[matches[begin[end]]]).min()) + 1


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, num: int = 4, den: int = 5) -> DataFrame:
    """Verified rows (doc_id, tid, item_id, matched, length), one per document text and item."""
    items = cut(item_words(benchmark).withColumn("version", F.xxhash64("words")))
    found = cut(alignments(docs, items))
    per_doc = found.join(items, ["item_id", "version"]).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("hits"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("tid"), "tid"))

    def only(batches):
        for batch in batches:
            tid = batch.column("tid").to_numpy().view(U)
            yield batch.take(pa.array(np.flatnonzero(in_bitmap(wanted.value, tid))))

    def verify(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w, h = read_words(part)
                out = []
                for row, hits in enumerate(part.column("hits")):
                    own = h[w.first[row] : w.stop[row]]
                    ids, shifts = hits.values.field("item_id").to_numpy(), hits.values.field("shift").to_numpy()
                    for item, shift, words in zip(ids.tolist(), shifts.tolist(), hits.values.field("words")):
                        q = words.values.to_numpy().view(U)
                        lo, hi = max(0, -shift), min(len(q), len(own) - shift)
                        matched, length = best_run(own[lo + shift : hi + shift] == q[lo:hi], num, den)
                        if matched >= min(-(-len(q) * num // den), least):
                            out.append((row, item, matched, length))
                row, item, matched, length = (np.array(x, np.int64) for x in (zip(*out) if out else ([], [], [], [])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("tid").take(pa.array(row)), pa.array(item), pa.array(matched), pa.array(length)],
                    names=["doc_id", "tid", "item_id", "matched", "length"],
                )

    texts = prepare(lowered(docs, "doc_id")).mapInArrow(only, "doc_id long, tid long, text string")
    rows = prepare(texts.join(per_doc, ["doc_id", "tid"])).mapInArrow(verify, "doc_id long, tid long, item_id long, matched long, length long")
    return rows.groupBy("doc_id", "tid", "item_id").agg(F.max("matched").alias("matched"), F.max_by("length", "matched").alias("length"))


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with contaminated, n_items, item_id (longest overlap, then smallest id) and matched,
    which take the place of columns that are called so."""
    docs = docs.drop("contaminated", "n_items", "item_id", "matched")
    best = (
        overlaps(docs, benchmark, **options)
        .groupBy("doc_id", "tid")
        .agg(F.count("*").alias("n_items"), F.max(F.struct("matched", (-F.col("item_id")).alias("low"))).alias("best"))
        .select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), "n_items", (-F.col("best.low")).alias("item_id"), F.col("best.matched").alias("matched"))
    )
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__tid": F.xxhash64("text")})
    return own.join(best, ["__id", "__tid"], "left").drop("__id", "__tid").withColumns(
        {"contaminated": F.col("n_items").isNotNull(), "n_items": F.coalesce("n_items", F.lit(0)), "matched": F.coalesce("matched", F.lit(0))}
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, columns unchanged."""
    found = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct()
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__tid": F.xxhash64("text")})
    return own.join(found, ["__id", "__tid"], "left_anti").select(*docs.columns)
