"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

A document's set is its distinct ``n``-word shingles. Documents with equal sets are one
class from the start, so copies never meet. The n-grams have one global order: those
found often (``frequent``, counted over all documents) last, hash order within; the
order only steers cost, any order gives the same links. A pair that links must share
an n-gram among the first ``prefix`` of both sets.

* Candidates. In each bucket (prefix n-gram) every class meets one hub, ``STARS`` times
  over. Components of the links found so far then leave few classes open; those meet all classes of their
  buckets that are not yet in the same component. Size bounds and a bitmap bound (the
  parity sketches of two sets differ in at most as many bits as the sets differ in
  members) discard pairs before they leave the join; both are exact.
* Counting. The global order is cut into ``fragments``. The overlap of a pair is counted
  in each fragment by itself and summed per pair; the link test is integer arithmetic.
* Components run on the links (see ``common.components``).

Every document keeps its row. Null or empty texts, and texts without words, have empty
sets and link with nothing. Rows with equal texts, also under one id, are one class; a
null id never names a component unless it has no other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import FOLDED, P, U, Words, bitmap, components, in_bitmap, let_go, mix, prepare, slices, text_bytes
from colprov.session import cut

FRAGMENTS = 8
SKETCH = 32  # longs in the short bitmap
WIDE = 2500  # members from which a set has wide bitmaps too
LOCAL, OFTEN = 4, 48
STARS = 2
PARTNERS = 256  # pairs of one hub that meet in one task


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and where each row starts.

    A row of fewer than ``n`` words but at least one has its whole sequence as one shingle.
    """
    w = Words(data, offs)
    h = w.hashes(FOLDED)
    words = w.stop - w.first
    full = max(0, len(h) - n + 1)
    rolled = np.zeros(len(h), U)
    for j in range(n):
        rolled[:full] = rolled[:full] * P + h[j : j + full]
    rolled[:full] = mix(rolled[:full])
    valid = np.zeros(len(h), bool)
    inside = np.arange(len(h)) - np.repeat(w.first, words)
    valid[inside <= np.repeat(words, words) - n] = True
    for row in np.flatnonzero((words > 0) & (words < n)):
        x = words[row : row + 1].astype(U)
        for v in h[w.first[row] : w.stop[row]]:
            x = mix(x * P + v)
        rolled[w.first[row]] = x[0]
        valid[w.first[row]] = True
    value = rolled[valid]
    count = np.maximum(words - n + 1, (words > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[begin[:-1][count > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[begin]


def signature(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each set."""
    total = np.diff(np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ U(0x5851F42D4C957F2D)), dtype=U)])[begin])
    return mix(total + np.diff(begin).astype(U))


def sketch(value: np.ndarray, begin: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Parity bitmap of each set: bit i is the parity of the members that hash to i."""
    rows = len(begin) - 1
    bit = (mix(value ^ U(0x2545F4914F6CDD1D)) >> U(40)).astype(np.int64) % (longs * 64)
    row = np.repeat(np.arange(rows), np.diff(begin))
    odd = np.bincount(row * (longs * 64) + bit, minlength=rows * longs * 64).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, -1), axis=1, bitorder="little").view("<i8")


def set_parts(batches: Iterator[pa.RecordBatch], n: int):
    let_go()
    for batch in batches:
        for part in slices(batch, "text"):
            value, begin = shingle_sets(*text_bytes(part.column("text")), n)
            yield part, value, begin


def level(size: np.ndarray) -> np.ndarray:
    """Sketch level of a set: level l has ``1024 << l`` bits, at least about as many as members."""
    return np.maximum(np.ceil(np.log2(np.maximum(size, 1) / 1024)), 0).astype(np.int64)


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, the set's signature s (null for empty sets), its size and its bitmap ``k0 ...``.

    ``wide`` has bitmaps of sets too large for the short one, at their level and the one below.
    """
    names = [f"k{i}" for i in range(SKETCH)]

    def work(batches):
        for part, value, begin in set_parts(batches, n):
            s = signature(value, begin)
            size = np.diff(begin)
            bits = sketch(value, begin)
            wide = [[] for _ in size]
            for row in np.flatnonzero(size > WIDE):
                own, top = value[begin[row] : begin[row + 1]], int(level(size[row : row + 1])[0])
                wide[row] = [
                    {"level": at, "bits": sketch(own, np.array([0, len(own)]), 16 << at)[0].tobytes()} for at in {top, max(0, top - 1)}
                ]
            columns = [part.column("doc_id"), pa.array(s.view(np.int64), mask=size == 0), pa.array(size)]
            columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)]
            kind = pa.list_(pa.struct([("level", pa.int32()), ("bits", pa.binary())]))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(wide, kind)], names=["doc_id", "s", "n_shingles", *names, "wide"])

    schema = "doc_id long, s long, n_shingles long, " + ", ".join(f"{k} long" for k in names)
    return prepare(docs).mapInArrow(work, schema + ", wide array<struct<level: int, bits: binary>>")


def frequent(docs: DataFrame, n: int, local: int = LOCAL, often: int = OFTEN) -> DataFrame:
    """Shingles found often: partial counts over all documents, those of ``local`` or more summed.

    Which shingles are named here changes only the order, never a link.
    """

    def work(batches):
        held, size = [], 0

        def flush():
            value = np.concatenate(held)
            held.clear()
            value.sort()  # in place: a run of ``local`` equal values starts where the value as far on is the same
            run = np.zeros(len(value), bool)
            run[: max(0, len(value) - local + 1)] = value[local - 1 :] == value[: max(0, len(value) - local + 1)]
            run[1:] &= value[1:] != value[:-1]
            first = np.flatnonzero(run)
            found = value[first]
            count = np.searchsorted(value, found, side="right") - first
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["g", "count"])

        for _, value, _ in set_parts(batches, n):
            held.append(value)
            size += len(value)
            if size > 4_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    counts = prepare(docs).mapInArrow(work, "g long, count long")
    return counts.groupBy("g").agg(F.sum("count").alias("count")).where(F.col("count") >= often).select("g")


def prefix_size(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """First members that a set must share one of with any set it links to."""
    return size - -(-size * num // den) + 1


def prefix_rows(docs: DataFrame, n: int, num: int, den: int, late: np.ndarray) -> DataFrame:
    """Rows (g, s, size): the prefix of every set in the global order (frequent last, then by hash)."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(late)  # a bitmap of fixed size

    def work(batches):
        for _, value, begin in set_parts(batches, n):
            size = np.diff(begin)
            s = signature(value, begin)
            row = np.repeat(np.arange(len(size)), size)
            value = (value >> U(1)) | (in_bitmap(shared.value, value).astype(U) << U(63))
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                value[a:b].sort()
            take = np.arange(len(value)) - np.repeat(begin[:-1], size) < np.repeat(prefix_size(size, num, den), size)
            value, row = value[take], row[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(s[row].view(np.int64)), pa.array(size[row].astype(np.int32))],
                names=["g", "s", "size"],
            )

    return prepare(docs).mapInArrow(work, "g long, s long, size int")


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Size and bitmap bounds of a pair: false only where the pair cannot link.

    A pair links when ``den * common >= num * (na + nb - common)``; the sets differ in
    ``na + nb - 2 * common`` members, at least as many as their bitmaps differ in bits.
    """
    na, nb = F.col(f"{a}.size").cast("long"), F.col(f"{b}.size").cast("long")
    differ = sum((F.bit_count(F.col(f"{a}.k{i}").bitwiseXOR(F.col(f"{b}.k{i}"))) for i in range(SKETCH)), F.lit(0))
    sizes = (na * den >= nb * num) & (nb * den >= na * num)
    return sizes & (differ * (num + den) <= (na + nb) * (den - num))


def wide_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose wide bitmaps allow a link; pairs of sets without wide bitmaps pass."""
    wide = cut(classes.select("s", "size", F.explode("wide").alias("w")).select("s", "size", "w.*"))
    sizes = classes.where(F.size("wide") > 0).select("s", F.array_max("wide.level").alias("top"))
    named = pairs.join(sizes.toDF("a", "ta"), "a", "left").join(sizes.toDF("b", "tb"), "b", "left")
    level_of = F.least("ta", "tb")
    named = cut(named.select("a", "b", F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull(), level_of).alias("level")))

    def far(batches):
        for batch in batches:
            x = [np.frombuffer(v, np.uint8) for v in batch.column("x").to_pylist()]
            y = [np.frombuffer(v, np.uint8) for v in batch.column("y").to_pylist()]
            differ = np.array([int(np.bitwise_count(p ^ q).sum()) for p, q in zip(x, y)], np.int64)
            both = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            keep = differ * (num + den) <= both * (den - num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = (
        named.where("level is not null")
        .join(wide.toDF("a", "na", "level", "x"), ["a", "level"])
        .join(wide.toDF("b", "nb", "level", "y"), ["b", "level"])
        .select("a", "b", "na", "nb", "x", "y")
    )
    return named.where("level is null").select("a", "b").unionByName(prepare(both).mapInArrow(far, "a long, b long"))


def overlaps(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, fragments: int) -> DataFrame:
    """Common members of each pair (a, b): counted in every fragment of the order, summed per pair.

    A pair gets its sets once, cut into fragments; the pairs of a hub are dealt over many tasks.
    """
    nodes = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = cut(classes.join(nodes, "s").select("s", F.coalesce("doc_id", F.lit(0)).alias("doc_id")))
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((bitmap(wanted, "s"), bitmap(wanted, "doc_id")))

    def work(batches):
        step = np.iinfo(np.uint64).max // fragments + 1
        names = held.value[1]
        chosen = lambda b: b.take(pa.array(np.flatnonzero(in_bitmap(names, b.column("doc_id").fill_null(0).to_numpy().view(U)))))
        for _, value, begin in set_parts(map(chosen, batches), n):
            s = signature(value, begin)
            rows = np.flatnonzero(in_bitmap(held.value[0], s) & (np.diff(begin) > 0))
            if not len(rows):
                continue
            size = np.diff(begin)[rows]
            ends = np.concatenate([[0], np.cumsum(size)])
            value = value[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin[rows], size)]
            owner = np.repeat(np.arange(len(rows)), size)
            piece = owner * fragments + (value // U(step)).astype(np.int64)
            bounds = np.searchsorted(piece, np.arange(len(rows) * fragments + 1)).astype(np.int32)
            cuts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * fragments), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(s[rows].view(np.int64)), whole], names=["s", "members"])

    sets = prepare(docs).mapInArrow(work, "s long, members array<array<long>>")
    # a set goes once to each pair that it is the a of; a b goes once to every ``PARTNERS`` of its pairs
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    copies = parts.select(F.col("b").alias("s"), F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = sets.join(dealt.select(F.col("a").alias("s"), "a", "b", "part").unionByName(copies), "s")
    left = sent.where("a <> b").select("a", "b", "part", F.col("members").alias("x"))
    right = sent.where("a = b").select("b", "part", F.col("members").alias("y"))
    common = sum((F.size(F.array_intersect(F.col("x")[i], F.col("y")[i])).cast("long") for i in range(fragments)), F.lit(0).cast("long"))
    return left.join(right, ["b", "part"]).groupBy("a", "b").agg(F.max(common).alias("common"))  # a set may have come twice


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, fragments: int = FRAGMENTS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(summaries(docs, n))
    classes = cut(
        rows.where("s is not null")
        .groupBy("s")
        .agg(
            F.min(F.col("n_shingles").cast("int")).alias("size"),
            *[F.min(f"k{i}").alias(f"k{i}") for i in range(SKETCH)],
            F.first("wide").alias("wide"),
            F.min("doc_id").alias("doc_id"),
        )
    )
    every = prefix_rows(docs, n, num, den, bitmap(frequent(docs, n), "g"))
    met = cut(every.groupBy("g").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("g"))
    buckets = cut(every.join(met, "g").distinct())

    def links(pairs: DataFrame) -> DataFrame:
        found = cut(wide_pairs(pairs, classes, num, den))
        common = overlaps(docs, found, classes, n, fragments)
        sizes = classes.select("s", "size")
        return cut(
            common.join(sizes.toDF("a", "na"), "a")
            .join(sizes.toDF("b", "nb"), "b")
            .where(f"common * {den} >= (na + nb - common) * {num}")
            .select("a", "b")
        )

    # in each round every class of a bucket meets one hub of its size band that it is not yet connected to
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num))).cast("int")
    banded = cut(buckets.withColumn("band", band))
    label, found = None, None
    for turn in range(STARS):
        part = banded.withColumn("component", F.col("s")) if label is None else banded.join(label, "s", "left").withColumn("component", F.coalesce("component", "s"))
        hubs = part.groupBy("g", "band").agg(
            F.min(F.struct(F.xxhash64("s", F.lit(turn)).alias("by"), F.col("s").alias("b"), F.col("component").alias("hub"))).alias("h"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        )
        hubs = hubs.where("low <> high").select("g", "band", "h.b", "h.hub")
        star = part.join(hubs, ["g", "band"]).where("component <> hub").select(F.col("s").alias("a"), "b").distinct()
        c, d = classes.drop("wide").alias("c"), classes.drop("wide").alias("d")
        star = star.join(c, F.col("a") == F.col("c.s")).join(d, F.col("b") == F.col("d.s")).where(may_link("c", "d", num, den)).select("a", "b")
        new = links(star)
        found = new if found is None else cut(found.unionByName(new))
        label = cut(components(found).toDF("s", "component"))

    # what is still apart meets all of its buckets
    known = classes.drop("wide").join(label, "s", "left").withColumn("component", F.coalesce("component", "s"))
    open_rows = buckets.join(known.select("s", "component"), "s")
    mixed = open_rows.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    inner = cut(buckets.select("g", "s").join(mixed, "g"))
    # buckets with one head are worked on as one, so that a pair seldom meets twice
    heads = inner.groupBy("g").agg(F.min(F.struct(F.xxhash64("s").alias("by"), F.col("s").alias("head"))).alias("h")).select("g", "h.head")
    met = cut(inner.join(heads, "g").select("head", "s").distinct())
    parts = met.join(known.select("s", "component"), "s").groupBy("head", "component").count()
    parts = parts.groupBy("head").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    full = cut(met.join(parts.select("head", "main"), "head").join(known.drop("doc_id"), "s"))
    x, y = full.where("component <> main").alias("x"), full.alias("y")
    apart = F.col("x.component") != F.col("y.component")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.s") < F.col("y.s"))
    rest = (
        x.join(y, (F.col("x.head") == F.col("y.head")) & apart & once & may_link("x", "y", num, den))
        .select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"))
        .distinct()
    )
    second = links(rest)
    label = components(found.unionByName(second)).toDF("s", "component")
    node = classes.select("s", F.col("doc_id").alias("low")).join(label, "s", "left").withColumn("component", F.coalesce("component", "s"))
    node = cut(node)
    lowest = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(lowest, "component").select("s", "component_id")
    return rows.select("doc_id", "s", "n_shingles").join(named, "s", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
