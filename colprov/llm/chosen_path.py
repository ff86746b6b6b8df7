"""Near-duplicate groups by a chosen-path similarity join.

A document's set is its distinct ``n``-word shingles; documents with equal sets are one
class, so copies never meet. Each class has ``TREES * OWN`` minwise tokens (the least hash
of its set under as many functions). A tree starts with all classes in one node. A node
chooses, by its own name, one or (one time in four, ``1 / 0.8`` on average) two of the
functions; each member goes to one child per chosen function, named by the node, the
function and the member's token. Two sets of similarity 0.8 so share about one child per
node at any depth. Trees are independent; a pair is found if any tree brings it to the end.

* Large nodes. Every member meets ``HUBS`` hubs of its node, and the components of the links
  so found are kept. A node whose members outside its main component are ``SMALL`` or fewer is
  small; others branch on (by two tokens a round), until their tokens are used up.
* Small nodes are compared exhaustively: every member outside the main component with every
  member of another component. A node that has no tokens left is compared in the same way,
  whatever its size, so none is given up.
* A candidate pair must pass the bounds of sizes and of parity bitmaps (both exact; the short
  bitmap is the wide one folded) and share so many tokens, seen by 8 bits each, that a pair at
  the threshold fails with a probability of ``MISS``. What is left is confirmed on the full
  sets, counted exactly.

At the first level a pair has 8 to 16 tokens to meet by, of which it shares 8 of 10 at
similarity 0.8: if its nodes are small it is missed three times in 10^6. Below a large node a
tree keeps it with a probability of about one half, all trees with more than 0.99. Links
that are reported are always true. A component also needs only some of its links.

Every row keeps its row. Null or empty texts, and texts without words, have empty sets and
link with nothing, so they are their own component. Rows with equal sets, also under one id,
are one class; a null id names no component unless it has no other. Whole texts are read.
Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import U, bitmap, components, drop, in_bitmap, let_go, mix, prepare, slices, stored, text_bytes
from colprov.llm.jaccard_join import shingle_sets, signature, sketch

TREES, OWN = 8, 5
SMALL, HUBS = 256, 8
LONGS, SHORT = 32, 8
MISS = 1e-6
PARTNERS = 256
TOKENS = TREES * OWN
SEEN, WIDE = [f"t{i}" for i in range(TOKENS // 8)], [f"k{i}" for i in range(LONGS)]
A = mix(np.arange(1, TOKENS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
B = mix(np.arange(1, TOKENS + 1, dtype=U) * U(0xD1B54A32D192ED03))


def minwise(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Tokens of each set, one row a set; empty sets have zeros."""
    size = np.diff(begin)
    out = np.zeros((len(size), TOKENS), np.uint32)
    full = size > 0
    if full.any():
        at = begin[:-1][full]
        for k in range(TOKENS):
            out[full, k] = np.minimum.reduceat((((value ^ B[k]) * A[k]) >> U(32)).astype(np.uint32), at)
    return out


def described(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, s (the set's name, null if empty), its size, tokens m, 8 bits of each in t0 ...,
    and the parity bitmap k0 ..."""

    def work(batches):
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                value, begin = shingle_sets(*text_bytes(part.column("text")), n)
                size = np.diff(begin)
                m = minwise(value, begin).view(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * TOKENS), pa.array(m.reshape(-1)))
                bits = sketch(value, begin, LONGS)
                columns = [part.column("doc_id"), pa.array(signature(value, begin).view(np.int64), mask=size == 0), pa.array(size), tokens]
                low = m.astype(np.uint8).view("<i8")
                columns += [pa.array(np.ascontiguousarray(low[:, i])) for i in range(len(SEEN))]
                columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(LONGS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "s", "n_shingles", "m", *SEEN, *WIDE])

    bits = ", ".join(f"{k} long" for k in SEEN + WIDE)
    return prepare(docs).mapInArrow(work, f"doc_id long, s long, n_shingles long, m array<int>, {bits}")


def fewest_shared(num: int, den: int) -> int:
    """Most tokens that a pair at the threshold may be asked to share, so that it fails with ``MISS`` at most."""
    p, below = num / den, 0.0
    for t in range(TOKENS + 1):
        below += comb(TOKENS, t) * p**t * (1 - p) ** (TOKENS - t)
        if below > MISS:
            return t
    return TOKENS


def short(classes: DataFrame) -> DataFrame:
    """What the first bounds need: s, size, the tokens' 8 bits and the bitmap folded to ``SHORT`` longs."""
    fold = lambda i: reduce(lambda p, q: p.bitwiseXOR(q), [F.col(k) for k in WIDE[i::SHORT]])
    return classes.select("s", "size", *SEEN, *[fold(i).alias(f"k{i}") for i in range(SHORT)])


def near(bitmap_longs: int, num: int, den: int) -> Column:
    """Bounds on a pair (x, y) by sizes and bitmaps."""
    na, nb = F.col("x.size"), F.col("y.size")
    differ = sum((F.bit_count(F.col(f"x.k{i}").bitwiseXOR(F.col(f"y.k{i}"))) for i in range(bitmap_longs)), F.lit(0))
    return (na * den >= nb * num) & (nb * den >= na * num) & (differ * (num + den) <= (na + nb) * (den - num))


def may_link(num: int, den: int) -> Column:
    """Bounds on a pair (x, y) by sizes, the short bitmaps and tokens."""
    unlike = F.lit(0)
    for t in SEEN:
        v = F.col(f"x.{t}").bitwiseXOR(F.col(f"y.{t}"))
        for k in (4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, k))
        unlike = unlike + F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))
    return near(SHORT, num, den) & (F.lit(TOKENS) - unlike >= fewest_shared(num, den))


def children(node: Column, tree: Column, level: int, m: Column) -> Column:
    """The children a member goes to: one or two, by the node's own choice."""
    at = (tree * OWN + 2 * level) % TOKENS
    child = lambda k: F.xxhash64(node, at + k, F.get(m, at + k))
    return F.when(F.pmod(F.xxhash64(node, F.lit("two")), F.lit(4)) == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those that link, counted on full sets.

    A set goes to each pair it is the smaller name of. The other one goes once to every
    ``PARTNERS`` of its pairs, so a hub's pairs are dealt over many tasks.
    """
    roles = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = stored(classes.join(roles, "s").select("s", "doc_id"))
    names = docs.sparkSession.sparkContext.broadcast((bitmap(wanted, "s"), bitmap(wanted.where("doc_id is not null"), "doc_id")))

    def work(batches):
        let_go()
        for batch in batches:
            ids = batch.column("doc_id")
            chosen = in_bitmap(names.value[1], ids.fill_null(0).to_numpy().view(U)) | ids.is_null().to_numpy(zero_copy_only=False)
            for part in slices(batch.take(pa.array(np.flatnonzero(chosen))), "text"):
                value, begin = shingle_sets(*text_bytes(part.column("text")), n)
                s, size = signature(value, begin), np.diff(begin)
                rows = np.flatnonzero(in_bitmap(names.value[0], s) & (size > 0))
                ends = np.concatenate([[0], np.cumsum(size[rows])])
                members = value[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin[rows], size[rows])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(members.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), pa.array(s[rows].view(np.int64)), lists], names=["id", "s", "members"])

    sets = prepare(docs).mapInArrow(work, "id long, s long, members array<long>")
    sets = sets.join(wanted, (sets["s"] == wanted["s"]) & sets["id"].eqNullSafe(wanted["doc_id"])).select(sets["s"], "members")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    copies = parts.select(F.col("b").alias("s"), F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = sets.join(dealt.select(F.col("a").alias("s"), "a", "b", "part").unionByName(copies), "s")
    x = sent.where("a <> b").select("a", "b", "part", F.col("members").alias("x"))
    y = sent.where("a = b").select("b", "part", F.col("members").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = (F.size("x") + F.size("y")).cast("long")
    return x.join(y, ["b", "part"]).where(common * den >= (both - common) * num).select("a", "b").distinct()


def groups(docs: DataFrame, n: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(described(docs, n))
    one_each = [F.min("n_shingles").alias("size"), F.first("m").alias("m"), *[F.min(k).alias(k) for k in SEEN + WIDE], F.min("doc_id").alias("doc_id")]
    classes = stored(rows.where("s is not null").groupBy("s").agg(*one_each))
    facts, wide = short(classes), classes.select("s", "size", *WIDE)
    label: DataFrame | None = None

    def labelled(df: DataFrame) -> DataFrame:
        if label is None:
            return df.withColumn("component", F.col("s"))
        return df.join(label, "s", "left").withColumn("component", F.coalesce("component", "s"))

    def link(pairs: DataFrame) -> DataFrame | None:
        """Confirm the pairs and join the components of those that link: rows (component, to), None where no pair does."""
        nonlocal label
        x = pairs.join(wide.withColumnRenamed("s", "a"), "a").alias("x")
        pairs = stored(x.join(wide.alias("y"), F.col("x.b") == F.col("y.s")).where(near(LONGS, num, den)).select("x.a", "x.b"))
        if pairs.isEmpty():
            return None
        found = stored(confirmed(docs, pairs, classes, n, num, den))
        drop(pairs)
        if found.isEmpty():
            return None
        old = label
        if old is None:
            label = stored(components(found).toDF("s", "component"))
            moved = label.toDF("component", "to")
        else:
            ends = found.join(old.toDF("a", "ca"), "a", "left").join(old.toDF("b", "cb"), "b", "left")
            moved = stored(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("component", "to"))
            new = moved.join(old.select("s").union(old.select("component")).distinct().toDF("component"), "component", "left_anti")
            kept = old.join(moved, "component", "left").select("s", F.coalesce("to", "component").alias("component"))
            label = stored(kept.unionByName(new.select(F.col("component").alias("s"), F.col("to").alias("component"))))
        drop(found)
        drop(old)
        return moved

    def state(members: DataFrame) -> DataFrame:
        """Per open node: its main component and the number of members outside it."""
        parts = members.groupBy("node", "component").agg(F.count("*").alias("n"))
        whole = parts.groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
        return whole.where("outside > 0")

    def hubs(members: DataFrame) -> DataFrame:
        """The hubs of each node, one by each of some hash orders, with their components."""
        hub = lambda i: F.min(F.struct(F.xxhash64("s", F.lit(i)).alias("by"), "s", "component"))
        return members.groupBy("node").agg(F.array(*[hub(i) for i in range(HUBS)]).alias("hubs")).select("node", F.explode("hubs").alias("hub"))

    # a member carries its component, which changes only where a round has joined components
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    members = classes.select("s", "m", trees).select("s", "tree", F.explode(children(F.xxhash64("tree"), F.col("tree"), 0, F.col("m"))).alias("node"))
    shared = members.groupBy("node").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high")
    members = stored(members.join(shared, "node", "left_semi").withColumn("component", F.col("s")))
    level, rest = 1, None
    while True:
        before, members = members, stored(members.join(state(members).select("node", "outside"), "node"))
        drop(before)
        large = members.where(F.col("outside") > SMALL)
        small = members.where(F.col("outside") <= SMALL).select("node", "s")
        rest = small if rest is None else rest.unionByName(small)
        if large.isEmpty():
            break
        x = large.select("node", "s", "component").join(facts, "s").alias("x")
        y = hubs(large).select("node", F.col("hub.s").alias("s"), F.col("hub.component").alias("component")).join(facts, "s").alias("y")
        apart = F.col("x.component") != F.col("y.component")
        met = x.join(y, (F.col("x.node") == F.col("y.node")) & apart & may_link(num, den))
        moved = link(met.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct())
        if moved is not None:
            now = large.join(moved, "component", "left").select("s", "tree", "node", F.coalesce("to", "component").alias("component"))
            large = stored(now.join(state(now).select("node", "outside"), "node"))
            rest = rest.unionByName(large.where(F.col("outside") <= SMALL).select("node", "s"))
            large = large.where(F.col("outside") > SMALL)
        if 2 * level >= TOKENS:
            rest = rest.unionByName(large.select("node", "s"))
            break
        down = large.join(classes.select("s", "m"), "s")
        down = down.select("s", "m", "tree", "component", F.explode(children(F.col("node"), F.col("tree"), level, F.col("m"))).alias("node"))
        members = stored(down.select("s", "tree", F.explode(children(F.col("node"), F.col("tree"), level + 1, F.col("m"))).alias("node"), "component"))
        level += 2

    rest = stored(labelled(rest))
    known = state(rest).select("node", "main")
    full = stored(rest.join(known, "node")).join(facts, "s")
    x, y = full.where("component <> main").alias("x"), full.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.s") < F.col("y.s"))
    apart = F.col("x.component") != F.col("y.component")
    pairs = x.join(y, (F.col("x.node") == F.col("y.node")) & apart & once & may_link(num, den))
    link(pairs.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct())

    node = stored(labelled(classes.select("s", F.col("doc_id").alias("low"))))
    lowest = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(lowest, "component").select("s", "component_id")
    out = rows.select("doc_id", "s", "n_shingles").join(named, "s", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
