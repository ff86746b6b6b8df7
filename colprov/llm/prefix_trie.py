"""A trie of conversations by their common beginnings, from sorted neighbours.

A conversation is a sequence of turns, each named by 16 bytes of a hash of role and text,
so the sequence is a byte string and its order is Spark's. Sorted, every subtree of the
trie is a stretch of neighbours, and neighbours are joined by an edge as deep as their
longest common prefix (LCP).

* Inside a partition union-find takes the edges in descending depth. A merge makes the
  branching node at that depth (or adds to it, if the depth is the same); the turns between
  a component and the node it goes under are its chain. Nodes that hold neither the first
  nor the last sequence of the partition are complete and are written.
* What is left of a partition is its forest: the nodes above its first and its last
  sequence, each with the sums of its complete children. Forests of neighbouring
  partitions, ``FAN`` at a time, are merged across their boundary, which is again an edge
  with an LCP; nodes that no boundary crosses any more are complete. Rounds go on until one
  forest is left. A forest holds two sequences, whatever the size of the partition.

The partitions are ranges of (sequence, id), so copies of one conversation are dealt over
many. Their ids go on as chunks of text, one digest being one stream by definition.

Rows with a null conv_id belong to no conversation and are left out. A null role or text
is empty, null turns come first, turns of equal number are ordered by their hash, and a
repeated row is one more turn. A conversation is held as one row of 20 bytes a turn,
whatever the length of its texts. An empty table has no trie, not even a root. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.llm.common import let_go, prepare
from colprov.session import cut

WIDTH = 16
FAN = 64
CHUNK = 1 << 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: ``key`` names a node that was on a boundary, ``parent`` its parent's key if that was on one.
OUT = f"kind string, {NODE}, key binary, parent binary, pid long, place long, body binary"
ARROW = pa.schema(
    [("kind", pa.string())]
    + [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")]
    + [("key", pa.binary()), ("parent", pa.binary()), ("pid", pa.int64()), ("place", pa.int64()), ("body", pa.binary())]
)
#: ends_sha256 of a node whose enders may lie in several partitions.
LATER = "later"
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, seq, words): the turns of each conversation as bytes, and the words of each."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    listed = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "words"))).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join("t.key", "")).alias("seq"), F.col("t.words").alias("words"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from c - c % every; h is the checksum of c modulo ``most``."""
    heads = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"),
        F.substring("seq", 1, WIDTH * (most - 1)).alias("head"),
        F.slice("words", 1, most - 1).alias("head_words"),
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    return own.join(heads, "base", "left").select(
        "conv_id",
        F.concat(F.coalesce(F.expr(f"substring(head, 1, {WIDTH} * h)"), F.lit(b"")), F.expr(f"substring(seq, {WIDTH} * h + 1)")).alias("seq"),
        F.concat(F.coalesce(F.expr("slice(head_words, 1, h)"), F.array().cast("array<int>")), F.expr("slice(words, h + 1, greatest(size(words) - h, 0))")).alias("words"),
    )


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


def keys_of(seq: bytes) -> list[bytes]:
    """A name for every prefix of a sequence."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.digest()]
    for k in range(0, len(seq), WIDTH):
        h.update(seq[k : k + WIDTH])
        out.append(h.copy().digest())
    return out


class Node:
    """A node while it grows: all its members, but sums over its complete children only."""

    __slots__ = ("depth", "n", "low", "kids", "leaves", "saved", "ends")

    def __init__(self, depth: int, n: int, low: int, kids: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None):
        self.depth, self.n, self.low, self.kids, self.leaves, self.saved, self.ends = depth, n, low, kids, leaves, saved, ends

    def __reduce__(self):
        return Node, (self.depth, self.n, self.low, self.kids, self.leaves, self.saved, self.ends)

    def total(self, words: int) -> int:
        return self.saved + (self.n - 1) * words

    def take(self, child: Node, words: int) -> None:
        """Add a complete child, whose last turn has so many words."""
        self.kids += 1
        self.leaves += child.leaves if child.kids else 1
        self.saved += child.total(words)

    def join(self, other: Node) -> None:
        """Add another part of the same node."""
        self.n += other.n
        self.low = min(self.low, other.low)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


class Rows:
    """Output rows as columns."""

    def __init__(self):
        self.rows: list[list] = []

    def node(self, node: Node, words: int, parent: int | None, key: bytes | None = None, parent_key: bytes | None = None) -> int:
        leaves = node.leaves if node.kids else 1
        self.rows.append(["node", node.low, node.depth, parent, node.n, node.kids, leaves, node.total(words), node.ends or NOBODY, key, parent_key, None, None, None])
        return len(self.rows) - 1

    def other(self, kind: str, key: bytes | None, pid: int, place: int, body: bytes) -> None:
        self.rows.append([kind, *[None] * 8, key, None, pid, place, body])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.rows), 10_000):
            part = list(zip(*self.rows[k : k + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, ARROW)], schema=ARROW)
        self.rows = []


class Forest:
    """The nodes above the first and the last sequence of a stretch of neighbours.

    ``left``: by depth, those above the first; ``right``: those above the last, from the depth
    ``shared`` on, up to which both are the same.
    """

    def __init__(self, first: bytes, first_words: list[int], last: bytes, last_words: list[int], left: list[Node], right: list[Node]):
        self.first, self.first_words, self.last, self.last_words = first, first_words, last, last_words
        self.shared = common_turns(first, last)
        self.left, self.right = left, right

    def above_last(self, depth: int) -> Node:
        return self.left[depth] if depth <= self.shared else self.right[depth - self.shared - 1]

    def merge(self, other: Forest, rows: Rows) -> Forest:
        """The forest of this stretch and the next one; what is complete then is written."""
        k = common_turns(self.last, other.first)
        for depth in range(k + 1):
            self.above_last(depth).join(other.left[depth])
        close(rows, self.last, self.last_words, self.above_last, len(self.last) // WIDTH, max(k, self.shared))
        mine = lambda d: self.above_last(d) if d <= k else other.left[d]
        close(rows, other.first, other.first_words, mine, len(other.first) // WIDTH, max(k, other.shared))
        close(rows, other.first, other.first_words, mine, k, max(self.shared, other.shared))
        shared = min(self.shared, k, other.shared)
        last = lambda d: mine(d) if d <= other.shared else other.above_last(d)
        right = [last(d) for d in range(shared + 1, len(other.last) // WIDTH + 1)]
        return Forest(self.first, self.first_words, other.last, other.last_words, self.left, right)

    def finish(self, rows: Rows) -> None:
        close(rows, self.last, self.last_words, self.above_last, len(self.last) // WIDTH, self.shared)
        close(rows, self.first, self.first_words, self.left.__getitem__, len(self.first) // WIDTH, 0)
        rows.node(self.left[0], 0, None, keys_of(b"")[0])


def close(rows: Rows, seq: bytes, words: list[int], at, deep: int, stop: int) -> None:
    """Write the nodes above a sequence from depth ``deep`` up to just below ``stop``, each added to the one above."""
    if deep <= stop:
        return
    keys = keys_of(seq)
    for depth in range(deep, stop, -1):
        at(depth - 1).take(at(depth), words[depth - 1])
        rows.node(at(depth), words[depth - 1], None, keys[depth], keys[depth - 1])


def partition_forest(seqs: list[bytes], words: list[list[int]], counts: list[int], lows: list[int], ends: list[str], rows: Rows) -> Forest:
    """Union-find over the edges between sorted, distinct sequences; complete nodes are written."""
    m = len(seqs)
    depth = np.array([common_turns(a, b) for a, b in zip(seqs[:-1], seqs[1:])], np.int64)
    up = list(range(m))
    top = [Node(len(s) // WIDTH, n, low, ends=e) for s, n, low, e in zip(seqs, counts, lows, ends)]
    first, last = [i == 0 for i in range(m)], [i == m - 1 for i in range(m)]
    waiting: list[list[int]] = [[] for _ in range(m)]  # rows whose parent is the top and may still grow
    left: list[Node] = []
    right: list[Node] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def lift(i: int, to: int) -> None:
        """Take the top of component i up to a depth, along its chain."""
        node = top[i]
        if node.depth == to:
            return
        above = Node(to, node.n, node.low)
        if first[i] or last[i]:
            at = 0 if first[i] else m - 1
            keys = keys_of(seqs[at])
            for r in waiting[i]:
                rows.rows[r][10] = keys[node.depth]
            (left if first[i] else right).append(node)
            for d in range(node.depth - 1, to, -1):
                (left if first[i] else right).append(Node(d, node.n, node.low))
            waiting[i] = []
        else:
            for r in waiting[i]:
                rows.rows[r][3] = node.low
            for d in range(node.depth, to, -1):
                over = above if d == to + 1 else Node(d - 1, node.n, node.low)
                r = rows.node(node, words[i][d - 1], node.low)
                over.take(node, words[i][d - 1])
                node = over
            waiting[i] = [r]
        top[i] = above

    for e in np.argsort(-depth, kind="stable").tolist():
        a, b, d = find(e), find(e + 1), int(depth[e])
        lift(a, d)
        lift(b, d)
        if len(waiting[a]) < len(waiting[b]):
            waiting[a], waiting[b] = waiting[b], waiting[a]
        waiting[a] += waiting[b]
        waiting[b] = []
        top[a].join(top[b])
        first[a], last[a] = first[a] or first[b], last[a] or last[b]
        up[b] = a
    if m > 1:
        root = find(0)
        for r in waiting[root]:  # the top lies above both ends
            rows.rows[r][10] = keys_of(seqs[0])[top[root].depth]
        waiting[root] = []
    else:
        root = 0
    lift(root, -1)
    return Forest(seqs[0], words[0], seqs[-1], words[-1], left[::-1], right[::-1])


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, seq, words), ids unique."""

    def grow(batches: Iterator[pa.RecordBatch]):
        let_go()
        pid = TaskContext.get().partitionId()
        rows = Rows()
        seqs: list[bytes] = []
        words: list[list[int]] = []
        counts, lows, ends = [], [], []
        held, size, place, digest = [], 0, 0, None

        def group_over(boundary: bool):
            nonlocal held, size, place
            ends.append(LATER if boundary else digest.hexdigest())
            if boundary:
                rows.other("ids", keys_of(seqs[-1])[-1], pid, place, ",".join(held).encode())
            held, size, place = [], 0, 0

        for batch in batches:
            for seq, w, i in zip(*(batch.column(c).to_pylist() for c in ("seq", "words", "conv_id"))):
                name = str(i)
                if not seqs or seq != seqs[-1]:
                    if seqs:
                        group_over(len(seqs) == 1)
                    seqs.append(seq)
                    words.append(w)
                    counts.append(0)
                    lows.append(i)
                    digest = hashlib.sha256()
                elif size > CHUNK:  # only read if the group turns out to lie on a boundary
                    rows.other("ids", keys_of(seqs[-1])[-1], pid, place, ",".join(held).encode())
                    held, size, place = [], 0, place + 1
                digest.update((name if not counts[-1] else "," + name).encode())
                counts[-1] += 1
                held.append(name)
                size += len(name) + 1
        if seqs:
            group_over(True)
            forest = partition_forest(seqs, words, counts, lows, ends, rows)
            rows.other("forest", None, pid, 0, pickle.dumps(forest))
        yield from rows.batches()

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        rows, forest = Rows(), None
        for body in table.column("body").to_pylist():
            part = pickle.loads(body)
            forest = part if forest is None else forest.merge(part, rows)
        if table.column("one")[0].as_py():
            forest.finish(rows)
        else:
            rows.other("forest", None, table.column("pid")[0].as_py() // FAN, 0, pickle.dumps(forest))
        return pa.Table.from_batches(list(rows.batches()), ARROW)

    def digests(batches: Iterator[pa.RecordBatch]):
        now, digest = None, None
        for batch in batches:
            keys, shas = [], []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if key != now:
                    if digest:
                        keys.append(now)
                        shas.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(body)
                else:
                    digest.update(b"," + body)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "sha"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "sha"])

    ordered = convs.select("seq", "words", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = cut(prepare(ordered).mapInArrow(grow, OUT))
    nodes = parts.where("kind = 'node'")
    forests = parts.where("kind = 'forest'")
    most = forests.agg(F.max("pid")).first()[0] or 0
    while True:
        one = most < FAN
        step = forests.select("pid", "body", (F.col("pid") / FAN).cast("long").alias("group"), F.lit(one).alias("one"))
        merged = cut(step.groupBy("group").applyInArrow(merge, OUT))
        nodes = nodes.unionByName(merged.where("kind = 'node'"))
        if one:
            break
        forests, most = merged.where("kind = 'forest'"), most // FAN
    chunks = parts.where("kind = 'ids'").select("key", "pid", "place", "body").repartition("key").sortWithinPartitions("key", "pid", "place")
    shas = prepare(chunks).mapInArrow(digests, "key binary, sha string")
    nodes = nodes.drop("kind", "pid", "place", "body")
    crossed = cut(nodes.where("key is not null").join(shas, "key", "left"))
    crossed = crossed.withColumn("ends_sha256", F.when(F.col("ends_sha256") == LATER, F.col("sha")).otherwise(F.col("ends_sha256"))).drop("sha")
    nodes = nodes.where("key is null").unionByName(crossed)
    known = crossed.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_low"))
    under = join_dim(nodes.where("parent is not null"), known, ["parent"]).withColumn("parent_conv_id", F.col("parent_low")).drop("parent_low")
    return nodes.where("parent is null").unionByName(under.select(*nodes.columns)).drop("key", "parent")
