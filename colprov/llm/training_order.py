"""Token-id shards in training order.

Texts become token ids (an end token after each) in sequences of ``length`` ids, the last
one of a text shorter. Every sequence has an index: the sequences of earlier partitions
of the stored table, plus its place in its own. A keyed Feistel permutation on the next
power of four, walked until it falls inside, maps indexes one to one onto global slots.
Shards are consecutive ranges of slots; one shard is one file of records of one fixed
size (count of ids, then the ids, both little-endian, 32 and 16 bits, padded with zeros),
so slot s is at byte (s - first) * stride of its shard, and a reader resumes anywhere.

The manifest row of each sequence is returned; ``read`` streams any range of slots. A file
appears only when complete. With ``resume`` shards that are complete for the same key,
counts and layout are kept as they are.

Null and empty texts are one sequence that holds the end token only. Repeated rows are
documents of their own. Extra columns are ignored; an empty table writes nothing. The
input must be a stored table: both passes read its partitions in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import P, U, mix, prepare, slices
from colprov.llm.files import Whole, open_folder
from colprov.session import cut, scratch

LENGTH = 512
SHARDS, SHARD_ROWS = 256, 1 << 18
KEY = 20240817


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = 4) -> np.ndarray:
    """A permutation of 0 .. n - 1 chosen by ``key``: values outside are permuted again until inside."""
    half = U(max(1, (max(2, n) - 1).bit_length() + 1) // 2)
    low = (U(1) << half) - U(1)
    keys = mix(np.arange(1, rounds + 1, dtype=U) * P + U(key))
    out = index.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoder(content: bytes, pattern: str):
    import tiktoken

    from colprov.llm.bpe import read_ranks

    ranks = read_ranks(content)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def sequences(part: pa.RecordBatch, content: bytes, pattern: str, length: int) -> Iterator[list[np.ndarray]]:
    """The sequences of each text."""
    encode, end = encoder(content, pattern)
    for text in part.column("text"):
        ids = np.array(encode.encode_ordinary(text.as_py() or "") + [end], "<u2")
        yield [ids[i : i + length] for i in range(0, len(ids), length)]


def stored(docs: DataFrame) -> DataFrame:
    return prepare(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def write(docs: DataFrame, content: bytes, pattern: str, folder: str | None = None, length: int = LENGTH, key: int = KEY, resume: bool = False) -> DataFrame:
    """Write the shards; rows (doc_id, part, n_tokens, slot, shard, position, path)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "order")
    vocabulary = spark.sparkContext.broadcast((content, pattern))  # a rank file, about 1 MB

    def count(batches):
        n, (encode, _) = 0, encoder(*vocabulary.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                n += sum(len(encode.encode_ordinary(x.as_py() or "")) // length + 1 for x in piece.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["partition", "n"])

    counts = stored(docs).mapInArrow(count, "partition int, n long").collect()  # one row per partition
    sizes = {r.partition: r.n for r in counts}
    total = sum(sizes.values())
    base, at = {}, 0
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    per_shard = max(256, min(SHARD_ROWS, -(-total // SHARDS)))
    layout = hashlib.sha256(repr((sorted(sizes.items()), length, key, per_shard, hashlib.sha256(content).hexdigest())).encode()).hexdigest()[:16]
    done = complete_shards(folder, layout) if resume else set()

    def place(batches):
        number = base[TaskContext.get().partitionId()]
        for batch in batches:
            for piece in slices(batch, "text"):
                docs_of, parts, ids = [], [], []
                for doc, found in zip(piece.column("doc_id").to_pylist(), sequences(piece, *vocabulary.value, length)):
                    docs_of += [doc] * len(found)
                    parts += range(len(found))
                    ids += [x.tobytes() for x in found]
                slot = feistel(np.arange(number, number + len(ids)), total, key)
                number += len(ids)
                shard = slot // per_shard
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(docs_of, pa.int64()), pa.array(parts, pa.int32()), pa.array(slot), pa.array(shard.astype(np.int32)), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "slot", "shard", "ids"],
                )
                yield rows

    stride = 4 + 2 * length

    def store(batches):
        system, root = open_folder(folder)
        out, open_shard = None, None
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("shard", "slot", "ids")]
            for shard, slot, ids in zip(*lists):
                if shard != open_shard:
                    if out is not None:
                        out.close()
                    out, open_shard = None, shard
                    if shard not in done:
                        system.create_dir(root, recursive=True)
                        out = Whole(system, f"{root}/{file_name(layout, shard)}")
                if out is not None:
                    out.write((len(ids) // 2).to_bytes(4, "little") + ids + bytes(stride - 4 - len(ids)))
            n_tokens = np.array([len(x) // 2 for x in lists[2]], np.int32)
            shard, slot = np.array(lists[0], np.int32), np.array(lists[1], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(n_tokens), batch.column("slot"), batch.column("shard"), pa.array((slot - shard.astype(np.int64) * per_shard) * stride),
                 pa.array([f"{root}/{file_name(layout, s)}" for s in lists[0]], pa.string())],
                names=["doc_id", "part", "n_tokens", "slot", "shard", "position", "path"],
            )
        if out is not None:
            out.close()

    placed = stored(docs).mapInArrow(place, "doc_id long, part int, slot long, shard int, ids binary")
    ordered = prepare(placed.repartition("shard").sortWithinPartitions("slot"))
    return cut(ordered.mapInArrow(store, "doc_id long, part int, n_tokens int, slot long, shard int, position long, path string"))


def file_name(layout: str, shard: int) -> str:
    return f"{layout}-{shard:08d}.bin"


def complete_shards(folder: str, layout: str) -> set[int]:
    system, root = open_folder(folder)
    files = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = [f.base_name for f in files if f.base_name.startswith(layout) and f.base_name.endswith(".bin")]
    return {int(n[len(layout) + 1 : -4]) for n in names}


def read(folder: str, manifest_row, n: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Up to ``n`` sequences of one shard from the slot of ``manifest_row`` on, read sequentially."""
    system, _ = open_folder(folder)
    stride = 4 + 2 * length
    with system.open_input_file(manifest_row["path"]) as f:
        f.seek(manifest_row["position"])
        for _ in range(n):
            record = f.read(stride)
            if not record:
                return
            yield np.frombuffer(record, "<u2", int.from_bytes(record[:4], "little"), 4)
