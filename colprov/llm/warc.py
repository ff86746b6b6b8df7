"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, in
order within a task. Digests are carried from row to row, and the writer puts each chunk
into the archive as it comes, so neither holds a whole record. Records of equal payloads
of at least ``least`` bytes: the one with the largest page id is the response, the others
are revisits that name it; shorter payloads are all responses. Reading back streams
each archive as chunk rows again, with the running digest and the header on the last.

A null html is an empty payload; a null url has no target; repeated rows are records of
their own with one type (equal ids and payloads are all responses if theirs is the
largest id). A null page id sorts before all others. Extra columns are ignored, and an
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprov.llm.common import prepare
from colprov.llm.files import Whole, open_folder
from colprov.session import cut, scratch

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(2**63)


def keyed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.xxhash64("url", "html").alias("tid"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``records`` once per chunk of ``payload``, in order: chunk_no, size, data instead of it."""
    rest = [c for c in records.columns if c != "payload"]
    size = F.octet_length("payload")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / chunk)).cast("int"))
    return (
        records.withColumns({"size": size.cast("long"), "chunk_no": F.explode(numbers)})
        .withColumn("data", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
        .select(*rest, "size", "chunk_no", "data")
    )


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def digests(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, tid, size, digest), the digest carried over the chunks of a record."""

    def work(batches):
        state, got = None, 0
        for batch in batches:
            out = []
            for page, tid, size, number, data in zip(*(batch.column(c).to_pylist() for c in ("page_id", "tid", "size", "chunk_no", "data"))):
                if number == 0:
                    state, got = hashlib.sha1(), 0
                state.update(data)
                got += len(data)
                if got == size:
                    out.append((page, tid, size, base32_sha1(state)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["page_id", "tid", "size", "digest"])

    rows = chunk_rows(keyed(pages).drop("url"), chunk)
    return prepare(rows).mapInArrow(work, "page_id long, tid long, size long, digest string")


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows (page_id, tid, digest, refers_to): refers_to is null for responses."""
    every = cut(digests(pages).distinct())
    last = every.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    shared = cut(last.where("n > 1").drop("n"))
    return every.join(shared, ["digest", "size"], "left").select(
        "page_id", "tid", "digest", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to")
    )


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def header(page: int, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """WARC and HTTP header of a record; the payload of a response follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [
        f"X-Page: {page}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write one gzip member per record into archives under ``folder``; rows (path, records)."""
    chosen = decisions(pages, least)
    records = chunk_rows(keyed(pages).join(chosen, ["page_id", "tid"]), chunk)

    def work(batches: Iterator[pa.RecordBatch]):
        system, base = open_folder(folder)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        out, count, squeeze, got = None, 0, None, 0
        for batch in batches:
            columns = ("page_id", "url", "size", "digest", "refers_to", "chunk_no", "data")
            for page, url, size, digest, refers_to, number, data in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = Whole(system, path)
                if number == 0:
                    squeeze, got = zlib.compressobj(1, zlib.DEFLATED, 31), 0
                    out.write(squeeze.compress(header(page, url, size, digest, refers_to)))
                    count += 1
                if refers_to is None:
                    out.write(squeeze.compress(data))
                got += len(data)
                if got == size:
                    out.write(squeeze.compress(b"\r\n\r\n"))
                    out.write(squeeze.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return cut(prepare(records).mapInArrow(work, "path string, records long"))


class Inflated:
    """Bytes of a gzip file of many members, read forwards in small steps."""

    def __init__(self, stream):
        self.stream, self.member, self.held, self.rest = stream, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Holds at most ``CHUNK`` more bytes, however well the archive is packed."""
        data = self.member.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        self.rest = b""
        out = self.member.decompress(data, CHUNK)
        if not data and not out:
            return False
        self.held += out
        if self.member.eof:
            self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.held:
            if not self.more():
                return None
        head, _, self.held = self.held.partition(mark)
        return head

    def some(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes."""
        while not self.held:
            if not self.more():
                raise EOFError("archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def fields(block: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def read_chunks(spark: SparkSession, archives: DataFrame, folder: str, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of every record: page_id, record_type, refers_to, chunk_no, data, and on the last row
    (``last``) the full payload's size and digest and whether the streamed payload agrees with the header."""

    def work(batches):
        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    source = Inflated(stream)
                    while (head := source.until(b"\r\n\r\n")) is not None:
                        warc = fields(head)
                        http_head = source.until(b"\r\n\r\n")
                        size = int(fields(http_head)["content-length"])
                        left = int(warc["content-length"]) - len(http_head) - 4
                        digest, page = warc["warc-payload-digest"].removeprefix("sha1:"), int(warc["x-page"])
                        refers_to = int(warc["x-refers-to-page"]) if "x-refers-to-page" in warc else None
                        running, number, length = hashlib.sha1(), 0, left
                        while True:
                            piece = source.some(min(left, chunk)) if left else b""
                            left -= len(piece)
                            running.update(piece)
                            sound = None if left else (refers_to is not None or (length == size and base32_sha1(running) == digest))
                            if data or not left:
                                rows.append((page, warc["warc-type"], refers_to, number, piece if data else None, not left, size, digest, sound))
                            number += 1
                            if len(rows) >= 256:
                                yield table(rows)
                                rows = []
                            if not left:
                                break
                        source.until(b"\r\n\r\n")
                if rows:
                    yield table(rows)

    def table(rows):
        columns = [list(x) for x in zip(*rows)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
        names = ["page_id", "record_type", "refers_to", "chunk_no", "data", "last", "size", "digest", "sound"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "page_id long, record_type string, refers_to long, chunk_no int, data binary, last boolean, size long, digest string, sound boolean"
    return prepare(archives.select("path")).mapInArrow(work, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives, read them back: one row per page."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    archives = write(pages, folder, least)
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return read_chunks(spark, archives, folder, data=False).where("last").select(
        name("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", name("refers_to"), "sound"
    )
