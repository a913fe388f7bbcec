"""WARC archives: a deduplicating writer and a splittable reader.

Reader: a task gets a byte range of an archive. It scans for the gzip magic, takes a candidate
as a member only if its first inflated bytes are a WARC record's, and owns the records whose
member starts inside the range, reading past the range's end for the last of them. Inside a
member it does not look for magic: the next search begins where the member ended.

Defined cases: a null payload is an empty one. A null page id is written without its header,
read back as null, and never refers to itself; among equal payloads the largest id that is not
null is the response, and rows that repeat that id are responses too. Without any id every one
is a response. An empty table gives no archive and no records. Other columns are ignored.
Archives are written by task and attempt, each under a name of its own, and a manifest lists those of
the attempts that counted. A lost attempt may leave a file, which no manifest lists and so no reader opens.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("file", T.StringType()),
        T.StructField("member_start", T.LongType()),
    ]
)


def assigned(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Each page with its payload, digest, record type and the page it refers to.

    Only digests of two rows or more are joined back, and the join moves each page once; a
    digest that holds most pages is a skewed left side that adaptive execution splits.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    again = (
        page.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id"))
        .where("n > 1")
        .select("digest", "response_id")
    )
    revisit = F.col("response_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response_id"), F.lit(False))
    return page.join(again, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("response_id")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write one archive a task; returns file, records and bytes of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        # Each attempt has a file of its own; the manifest lists those of the attempts that counted, and only these are read.
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, records, size = None, 0, 0
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = where.open_output_stream(name, compression=None)
                    member = record(page_id, url, html.encode(), refers_to)
                    out.write(member)
                    records += 1
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

    spark = pages.sparkSession
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    done = assigned(pages, min_revisit_bytes).mapInArrow(write, "file string, records long, bytes long")
    path = f"{folder}.manifest"
    done.write.parquet(path)
    return spark.read.schema("file string, records long, bytes long").parquet(path)


def ranges(spark: SparkSession, archives: DataFrame, split_bytes: int) -> DataFrame:
    """file, start, end of byte ranges that cover the archives listed in ``archives``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return archives.select("file", "bytes", F.explode(starts).alias("start")).select(
        "file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end")
    )


class Window:
    """A file's bytes from a place on, read as they are asked for and let go as they are passed."""

    def __init__(self, handle, start: int):
        self.handle, self.base, self.data, self.ended = handle, start, bytearray(), False

    def more(self) -> bool:
        if not self.ended:
            self.handle.seek(self.base + len(self.data))
            got = self.handle.read(READ_BYTES)
            self.ended = not got
            self.data += got
        return not self.ended

    def pass_to(self, place: int) -> None:
        while place > self.base + len(self.data) and self.more():
            passed = max(len(self.data) - 1, 0)
            del self.data[:passed]
            self.base += passed
        del self.data[: place - self.base]
        self.base = place

    def find(self, end: int) -> int:
        """Where the next magic starts before ``end``, or -1."""
        while True:
            at = self.data.find(MAGIC)
            if at >= 0:
                return self.base + at if self.base + at < end else -1
            keep = len(self.data) - len(MAGIC) + 1
            if keep > 0:
                del self.data[:keep]
                self.base += keep
            if self.base >= end or not self.more():
                return -1

    def member(self) -> tuple[bytes, int] | None:
        """The record of the gzip member at the base and the member's size; None if it is no record."""
        packer, parts, got, at = zlib.decompressobj(31), [], 0, 0
        try:
            while not packer.eof:
                if at >= len(self.data) and not self.more():
                    return None
                # A candidate must prove itself by its first inflated bytes before the rest is read.
                step = self.data[at : at + (512 if not got else READ_BYTES)]
                at += len(step)
                parts.append(packer.decompress(step))
                before, got = got, got + len(parts[-1])
                if before < len(VERSION) <= got and not b"".join(parts).startswith(VERSION):
                    return None
        except zlib.error:
            return None
        return (b"".join(parts), at - len(packer.unused_data)) if got >= len(VERSION) else None


def parsed(data: bytes) -> dict | None:
    """Headers and payload of a record, or None for one that is not a page's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    body = rest[: int(fields.get("content-length", len(rest)))]
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    number = lambda text: int(text.rsplit(":", 1)[1].rstrip(">")) if text else None
    return {
        "page_id": number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": len(payload) if payload is not None else int(fields["x-payload-length"]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": payload,
    }


def owned(where, name: str, start: int, end: int) -> Iterator[dict]:
    """The records whose member starts in [start, end)."""
    with where.open_input_file(name) as handle:
        window = Window(handle, start)
        while (at := window.find(end)) >= 0:
            window.pass_to(at)
            if (found := window.member()) is None:
                window.pass_to(at + 1)
                continue
            window.pass_to(at + found[1])
            if (row := parsed(found[0])) is not None:
                yield row | {"file": name, "member_start": at}


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives, one task a few byte ranges; columns as in RECORD."""
    schema = T.StructType([f for f in RECORD if payloads or f.name != "payload"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "member_start": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for name, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for row in owned(where, name, start, end):
                    if not payloads:
                        row.pop("payload")
                    rows.append(row)
                    size += row["payload_bytes"] if payloads else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in rows], types.get(f.name, pa.string())) for f in schema})
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in rows], types.get(f.name, pa.string())) for f in schema})

    split = ranges(spark, archives, split_bytes)
    tasks = (archives.agg(F.sum("bytes")).first()[0] or 0) // split_bytes + 1
    return split.repartition(tasks, "file", "start").mapInArrow(read, schema)
