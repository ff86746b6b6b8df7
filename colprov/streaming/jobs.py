"""The two incremental jobs as Structured Streaming.

Both take a folder that files keep landing in and a checkpoint folder; with
``available_now`` they work off what is there and stop. Executors may be lost at
any time: files are read once by the checkpoint, and sinks are idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colprov.operators import cells as C
from colprov.operators import sieve as E


def start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def landed(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


# ----------------------------------------------------------- growing sieve


def sieve_stream(docs: DataFrame, columns: DataFrame, min_len: int = 2, **vocabulary) -> DataFrame:
    """The sieve over a stream of documents (doc_id, ds, text): stateless, so a
    document is finished with the batch it arrives in."""
    hits = E.classify(E.sentences(docs), **vocabulary)
    return E.anchor_inline(hits, columns, min_len)


def run_sieve(
    spark: SparkSession, folder: str, schema: str, columns: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
    files_per_batch: int = 1000, **vocabulary,
) -> StreamingQuery:
    out = sieve_stream(landed(spark, folder, schema, files_per_batch=files_per_batch), columns, **vocabulary)
    return start(out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append"), available_now)


def interim_yield(spark: SparkSession, folder: str, schema: str, sink: str, index: DataFrame) -> DataFrame:
    """Yield so far. The denominator is what has landed, not the index, and says so."""
    seen = spark.read.schema(schema).parquet(folder).agg(F.count(F.lit(1)).alias("swept"))
    hit = spark.read.parquet(sink).agg(F.count_distinct("doc_id").alias("hit"))
    total = index.agg(F.count(F.lit(1)))
    return seen.withColumns({"hit": hit.scalar(), "indexed": total.scalar()}).withColumns(
        {"rate": F.try_divide(F.col("hit"), F.col("swept")), "label": F.when(F.col("swept") < F.col("indexed"), "INTERIM").otherwise("COMPLETE")}
    )


# --------------------------------------------------------- newest verdicts

KEY = ["model", "ds", "cond", "seed", "col"]
BUCKETS = 64
DELTAS = 4
KEEP_VERSIONS = 10


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, root = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []


def versions(spark: SparkSession, sink: str) -> list[int]:
    """The published versions, oldest first. One is published by the marker that ends its write."""
    out = []
    for name in _children(spark, f"{sink}/versions"):
        fs, marker = _folder(spark, f"{sink}/versions/{name}/_SUCCESS")
        if fs.exists(marker):
            out.append(int(name.partition("=")[2]))
    return sorted(out)


def _files(spark: SparkSession, sink: str, version: int) -> dict[int, list[str]]:
    """Bucket -> its folders in that version, at most ``deltas`` + 1 each."""
    rows = spark.read.parquet(f"{sink}/versions/version={version}").collect()
    return {r["bucket"]: list(r["parts"]) for r in rows}


def _write_buckets(rows: DataFrame, path: str) -> list[int]:
    # after ``newest`` a key is one row, so buckets of a key hash are even
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return [int(n.partition("=")[2]) for n in _children(rows.sparkSession, path)]


def upsert_verdicts(batch: DataFrame, batch_id: int, sink: str, order: list[str], buckets: int = BUCKETS, deltas: int = DELTAS, keep: int = KEEP_VERSIONS) -> None:
    """Fold one batch into the keyed snapshot under ``sink`` and publish it as version ``batch_id``.

    The newest row per key of the batch is laid beside the buckets that its keys fall in; a
    bucket with more than ``deltas`` such parts is folded into one, other buckets are neither
    read nor written. What a version reads is listed in its own small table, whose end
    marker publishes it, so readers see the old version or the new one. A batch that broke off
    starts again from the version before it and replaces its own files, a published one is
    left as it is: one sink belongs to one stream and its checkpoint. Order decides, so late rows
    lose to newer ones. Versions beyond the last ``keep`` go with the files only they list.
    """
    spark = batch.sparkSession
    known = versions(spark, sink)
    before = [v for v in known if v < batch_id]
    if known and known[-1] >= batch_id:
        return  # published before
    parts = _files(spark, sink, before[-1]) if before else {}
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    touched = _write_buckets(C.newest(batch, KEY, order).withColumn("bucket", bucket), f"{sink}/data/delta={batch_id}")
    for b in touched:
        parts[b] = [*parts.get(b, []), f"delta={batch_id}/bucket={b}"]
    full = [b for b in touched if len(parts[b]) > deltas]
    if full:
        rows = C.newest(_rows(spark, sink, batch.schema, [p for b in full for p in parts[b]]), KEY, order)
        for b in _write_buckets(rows.withColumn("bucket", bucket), f"{sink}/data/whole={batch_id}"):
            parts[b] = [f"whole={batch_id}/bucket={b}"]
    shape = "bucket int, parts array<string>"
    spark.createDataFrame(sorted(parts.items()), shape).coalesce(1).write.mode("overwrite").parquet(f"{sink}/versions/version={batch_id}")
    _drop_old(spark, sink, [*before, batch_id], keep)


def _rows(spark: SparkSession, sink: str, schema, parts: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{sink}/data/{p}" for p in parts])


def _drop_old(spark: SparkSession, sink: str, known: list[int], keep: int) -> None:
    """A part that a later version no longer lists never comes back."""
    for old, later in list(zip(known, known[1:]))[: max(0, len(known) - keep)]:
        listed = {p for parts in _files(spark, sink, later).values() for p in parts}
        gone = [f"data/{p}" for parts in _files(spark, sink, old).values() for p in parts if p not in listed]
        for path in [*gone, f"versions/version={old}"]:
            fs, root = _folder(spark, f"{sink}/{path}")
            fs.delete(root, True)


def run_verdicts(
    spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, order: list[str], available_now: bool = True, files_per_batch: int = 1000,
    buckets: int = BUCKETS, deltas: int = DELTAS,
) -> StreamingQuery:
    """Keep the newest verdict per key as cells land; empty and failed answers are
    never stored. Rows: model, ds, cond, seed, col, verdict, status, and ``order``."""
    rows = landed(spark, folder, schema, files_per_batch=files_per_batch)
    ok = C.usable(rows, raw="verdict", status="status")

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_verdicts(batch, batch_id, sink, order, buckets, deltas)

    return start(ok.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def current_verdicts(spark: SparkSession, sink: str, schema: str, order: list[str], version: int | None = None) -> DataFrame:
    """The newest verdict per key in the last version, or in an earlier one that is kept.
    Reads a key at most ``deltas`` + 1 times, however many batches there were."""
    known = versions(spark, sink)
    parts = [p for ps in _files(spark, sink, known[-1] if version is None else version).values() for p in ps] if known else []
    if not parts:
        return spark.createDataFrame([], schema)
    return C.newest(_rows(spark, sink, schema, parts), KEY, order)
