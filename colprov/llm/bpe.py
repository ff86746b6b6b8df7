"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Each match of the split pattern is encoded by itself. A task keeps one in-process DuckDB
connection with two tables made from the rank file: the vocabulary, and every split of a
token into two tokens with the token's rank. New words go in as rows (word, position, id).
The recursive query joins neighbours with the merge table and contracts the leftmost pair of
the smallest rank in each word until no pair of any word is in the table. In words of
more than ``SHORT`` bytes a round contracts all separate occurrences of that pair, leftmost
first: a pair that a contraction makes has a larger rank, so they would follow one another
anyway. A word that is a token is that token. Decoding joins ids with the vocabulary and
aggregates the bytes of each word in order of position; a word whose ids decode to itself
stands for its bytes from then on, any other keeps them beside it. A worker remembers words
it has met, in two generations of at most ``REMEMBERED`` bytes each; words are learnt
``LEARNT`` and texts taken ``AT_ONCE`` words at a time, so memory does not follow the length
of a text.

A null text is empty: no tokens. Bytes that are not UTF-8 become the replacement
character first. Rows come back one for one, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import kept, prepare, slices

REMEMBERED = 36 << 20
#: Bytes that a remembered word takes beside its letters and ids.
ENTRY = 180
LEARNT = 20_000
AT_ONCE = 50_000
ROWS_HELD = 1_000_000
#: DuckDB and Arrow give what a query no longer needs back at once: workers outlive a task, and
#: freed memory that an allocator keeps counts as the executor's.
SETTINGS = [
    "threads=1",
    "memory_limit='300MB'",
    "temp_directory=''",
    "preserve_insertion_order=false",
    "allocator_flush_threshold='1MB'",
    "allocator_bulk_deallocation_flush_threshold='1MB'",
]

SHORT = 63  # bytes; a longer word may need many rounds

#: One contraction per word and round; a row's key is word * 64 + position.
ENCODE_SHORT = """
WITH RECURSIVE step(it, s, id) AS (
    SELECT 0, w * 64 + p, id FROM symbols
    UNION ALL (
        WITH near AS (
            SELECT it, s, id, lead(id) OVER o AS right_id, lead(s) OVER o AS right_s, lag(s) OVER o AS left_s
            FROM step WINDOW o AS (ORDER BY s)
        ), pairs AS MATERIALIZED (
            SELECT near.*, m FROM near LEFT JOIN merges
            ON near.id = merges.l AND near.right_id = merges.r AND near.s // 64 = near.right_s // 64
        ), best AS (
            SELECT s // 64 AS w, min(m * 64 + s % 64) AS k FROM pairs WHERE m IS NOT NULL GROUP BY 1
        )
        SELECT it + 1, s, CASE WHEN s % 64 = k % 64 THEN (k // 64)::INT ELSE id END
        FROM pairs JOIN best ON s // 64 = w
        WHERE left_s IS NULL OR left_s <> w * 64 + k % 64
    )
)
SELECT step.s // 64 AS w, step.s % 64 AS p, id, step.it AS it
FROM step JOIN (SELECT s // 64 AS w, max(it) AS it FROM step GROUP BY 1) q ON step.s // 64 = q.w AND step.it = q.it
ORDER BY step.s
"""

#: All occurrences of a word's best pair in one round, and at most so many rounds: what a
#: recursive query has made stays in memory until it ends.
ENCODE = """
WITH RECURSIVE step(it, w, p, id) AS (
    SELECT 0, w, p, id FROM symbols
    UNION ALL
    SELECT it + 1, w, p, CASE WHEN take THEN m ELSE id END
    FROM (
        SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone
        FROM (
            SELECT *, hit AND (p - coalesce(max(CASE WHEN hit THEN NULL ELSE p END)
                OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS take
            FROM (
                SELECT it, w, p, id, m, best, m IS NOT NULL AND m = best AS hit
                FROM (
                    SELECT t.it, t.w, t.p, t.id, x.m, min(x.m) OVER (PARTITION BY t.w) AS best
                    FROM (
                        SELECT it, w, id, row_number() OVER (PARTITION BY w ORDER BY p) AS p,
                            lead(id) OVER (PARTITION BY w ORDER BY p) AS r
                        FROM step
                    ) t LEFT JOIN merges x ON t.id = x.l AND t.r = x.r
                )
                WHERE best IS NOT NULL AND it < {rounds}
            )
        )
    )
    WHERE NOT gone
)
SELECT w, p, id, it FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it) ORDER BY w, p
"""

DECODE = """
SELECT w, unhex(string_agg(bytes, '' ORDER BY p)) AS word
FROM ids JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file's content and the split pattern that belongs to it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line.strip())}


class Codec:
    """Words to ids and back, in one DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.odd: dict[str, bytes] = {}
        self.con = duckdb.connect()
        for setting in SETTINGS:
            self.con.execute(f"SET {setting}")
        splits = [
            (ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        l, r, m = np.array(splits, np.int32).reshape(-1, 3).T
        self.make("merges", pa.table({"l": l, "r": r, "m": m}))
        self.make("vocabulary", pa.table({"id": np.array(list(ranks.values()), np.int32), "bytes": [t.hex() for t in ranks]}))
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def make(self, name: str, table: pa.Table) -> None:
        self.con.register("incoming", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return out

    def contract(self, words: list[bytes], short: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word number, id) rows in order, for words that are not empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(x) for x in words])
        w, ids = np.repeat(np.arange(len(words), dtype=np.int64), size), self.byte[data]
        p = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + 1
        if short:
            out = self.query(ENCODE_SHORT, symbols=pa.table({"w": w, "p": p, "id": ids}))
            return out.column("w").to_numpy(), out.column("id").to_numpy()
        done_w, done_ids = [], []
        while len(w):
            rounds = max(1, ROWS_HELD // len(w))
            out = self.query(ENCODE.format(rounds=rounds), symbols=pa.table({"w": w, "p": np.arange(len(w)), "id": ids}))
            w, ids = out.column("w").to_numpy(), out.column("id").to_numpy().astype(np.int32)
            more = out.column("it").to_numpy() == rounds
            done_w.append(w[~more])
            done_ids.append(ids[~more])
            w, ids = w[more], ids[more]
        w, ids = np.concatenate(done_w), np.concatenate(done_ids)
        by = np.argsort(w, kind="stable")
        return w[by], ids[by]

    def decode(self, w: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each word's ids, in order of word number (every number from 0 occurs)."""
        p = np.arange(len(ids), dtype=np.int64)
        return self.query(DECODE, ids=pa.table({"w": w, "p": p, "id": ids})).column("word").to_pylist()

    def learn(self, words: list[str]) -> None:
        """Find ids and decoded bytes of words not met before."""
        raw = [x.encode() for x in words]
        whole = [self.ranks.get(x) for x in raw]
        w = [np.array([i for i, r in enumerate(whole) if r is not None], np.int64)]
        ids = [np.array([r for r in whole if r is not None], np.int32)]
        for short, some in (
            (True, [i for i, r in enumerate(whole) if r is None and len(raw[i]) <= SHORT]),
            (False, [i for i, r in enumerate(whole) if r is None and len(raw[i]) > SHORT]),
        ):
            if some:
                number, found = self.contract([raw[i] for i in some], short)
                w.append(np.array(some)[number])
                ids.append(found.astype(np.int32))
        w, ids = np.concatenate(w), np.concatenate(ids)
        by = np.argsort(w, kind="stable")
        w, ids = w[by], ids[by]
        back = self.decode(w, ids)
        at = (np.searchsorted(w, np.arange(len(words) + 1)) * 4).tolist()
        flat = ids.astype("<u4").tobytes()
        for i, x in enumerate(words):
            self.known[x] = flat[at[i] : at[i + 1]]
            if back[i] != raw[i]:
                self.odd[x] = back[i]
        self.held += ENTRY * len(words) + len(flat) + sum(map(len, raw))

    def ready(self, words: set[str]) -> None:
        """Make all ``words`` known; of others only those met lately stay known."""
        if self.held > REMEMBERED:
            self.odd = {x: b for x, b in self.odd.items() if x in self.known}
            self.known, self.older, self.held = {}, self.known, 0
        new = []
        for x in words - self.known.keys():
            old = self.older.get(x)
            if old is None:
                new.append(x)
            else:
                self.known[x] = old
                self.held += ENTRY + len(x) + len(old)
        new.sort()
        for i in range(0, len(new), LEARNT):
            self.learn(new[i : i + LEARNT])

    def encode(self, words: list[str]) -> tuple[bytes, bytes]:
        """Ids of consecutive words as little-endian 32-bit integers, and what they decode to."""
        try:
            ids = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.ready(set(words))
            ids = b"".join(map(self.known.__getitem__, words))
        if self.odd:
            return ids, b"".join([self.odd[x] if x in self.odd else x.encode() for x in words])
        return ids, "".join(words).encode()


def codec_of(content: bytes) -> Codec:
    """One codec for each rank file in a worker process; it outlives the task."""
    return kept(("codec", hashlib.sha256(content).digest()), lambda: Codec(read_ranks(content)))


def texts_of(part: pa.RecordBatch) -> Iterator[str]:
    for x in part.column("text").cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encoded(docs: DataFrame, content: bytes, pattern: str, digest_only: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a rank file, about 1 MB

    def work(batches):
        import regex

        split, codec = regex.compile(pattern), codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = list(texts_of(part))
                # the new words of many texts go through one recursive query
                new = set()
                for text in texts:
                    if len(text) < AT_ONCE:
                        new.update(split.findall(text))
                codec.ready(new)
                counts, ids_out, ids_sha, text_sha = [], [], [], []
                for text in texts:
                    a, b, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    found = (m.group() for m in split.finditer(text)) if len(text) >= AT_ONCE else iter(split.findall(text))
                    while words := list(itertools.islice(found, AT_ONCE)):
                        ids, back = codec.encode(words)
                        n += len(ids) // 4
                        a.update(ids)
                        b.update(back)
                        if not digest_only:
                            kept.append(ids)
                    counts.append(n)
                    ids_out.append(b"".join(kept))
                    ids_sha.append(a.hexdigest())
                    text_sha.append(b.hexdigest())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64())]
                columns += [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())] if digest_only else [pa.array(ids_out, pa.binary())]
                names = ["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digest_only else ["ids"])
                yield pa.RecordBatch.from_arrays(columns, names=names)
                pa.default_memory_pool().release_unused()

    rows = prepare(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest_only else "ids binary"))


def encode(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return encoded(docs, content, pattern, False)


def digests(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded(docs, content, pattern, True)


def decode(rows: DataFrame, content: bytes) -> DataFrame:
    """Rows (doc_id, bytes) for rows (doc_id, ids): the tokens' bytes in order. Null ids give none."""
    shared = rows.sparkSession.sparkContext.broadcast(content)

    def work(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                lists = [np.frombuffer(x.as_py() or b"", "<u4").astype(np.int32) for x in part.column("ids")]
                some = [i for i, x in enumerate(lists) if len(x)]
                out = [b""] * len(lists)
                if some:
                    w = np.repeat(np.arange(len(some), dtype=np.int32), [len(lists[i]) for i in some])
                    for i, x in zip(some, codec.decode(w, np.concatenate([lists[i] for i in some]))):
                        out[i] = x
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return prepare(rows.select("doc_id", "ids")).mapInArrow(work, "doc_id long, bytes binary")
