"""WARC archives as a chunked record table, so that no oversized payload is ever one value.

A record is a run of rows (record_id, chunk_no, last, head, data, running_sha256). `head` is the WARC and HTTP header of
chunk 0; the data of all chunks in order is the payload; head + data + CRLF CRLF is the record in WARC/1.1 bytes. Each
row carries the SHA-256 of the payload up to its own end, so a reader that streams chunks in order checks every one as
it comes and ends with the payload's digest, holding one chunk at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm._common import empty_if_null, ensure_checkpoint_dir, join_heavy, settle

CHUNK_BYTES = 1 << 18
#: Payloads below this length are never told by reference.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_BATCH_BYTES = 4 << 20
CHUNKS = "record_id string, chunk_no int, last boolean, head binary, data binary, running_sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_CHUNK_SCHEMA = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("head", pa.binary()), ("data", pa.binary()), ("running_sha256", pa.string())])
_FILE_SCHEMA = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of pages (page_id, html) whose payload of `least` bytes or more is that of a smaller page_id.

    Only digests and ids move; a payload that a good share of all pages has stays where it lies.
    """
    told = settle(pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least).select("page_id", "digest"))
    first = told.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("pages"))
    again = join_heavy(told, first, "digest", "pages", told.count()).where(F.col("page_id") > F.col("refers_to"))
    return again.select("page_id", "digest", "refers_to").distinct()


def cut(pages: DataFrame, chunk_bytes: int, least: int = REVISIT_BYTES) -> DataFrame:
    """row, page_id, url, digest, size, refers_to, chunk_no, last, data: payloads of pages (page_id, url, html) cut before they move.

    A record's chunks lie together in order. Payloads that may be revisits meet what they refer to as chunks, never as a whole;
    of revisits only the first chunk is left, without data.
    """
    size = F.octet_length("html").cast("long")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.sha2("html", 256).alias("digest"), size.alias("size"), F.encode("html", "UTF-8").alias("payload"))
    last = F.greatest(F.ceil(F.col("size") / chunk_bytes) - 1, F.lit(0)).cast("int")
    # Numbers are made first and bytes taken by them, so a payload is never held a second time as an array of its chunks.
    told = rows.withColumn("final", last).withColumn("chunk_no", F.explode_outer(F.sequence(F.lit(0), "final")))
    data = F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    told = told.select("row", "page_id", "url", "digest", "size", "chunk_no", (F.col("chunk_no") == F.col("final")).alias("last"), data.alias("data"))
    once = (F.col("size") < least) | F.col("page_id").isNull()
    joined = told.where(~once).join(settle(revisits(pages, least)), ["page_id", "digest"], "left").where("refers_to IS NULL OR chunk_no = 0")
    joined = joined.withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data"))).withColumn("last", F.col("last") | F.col("refers_to").isNotNull())
    return joined.sortWithinPartitions("row", "chunk_no").unionByName(told.where(once).withColumn("refers_to", F.lit(None).cast("long")))


def _header(page_id: int | None, record_id: str, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    length = len(http) + (size if refers_to is None else 0)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + http


def _batches(rows: Iterable[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cut() to chunk rows; the state is one hash, whatever the record's size."""

    def rows() -> Iterator[tuple]:
        context, seen, digest, record_id = TaskContext.get(), Counter(), None, None
        columns = ("page_id", "url", "digest", "size", "refers_to", "chunk_no", "last", "data")
        for batch in batches:
            for page_id, url, sha, size, refers_to, chunk_no, last, data in zip(*(batch.column(c) for c in columns), strict=True):
                no, head, part = chunk_no.as_py(), None, memoryview(data.as_buffer()) if data.is_valid else b""
                if no == 0:
                    # Unique for each row, repeated ones too, and whatever the order in which a task that is run again gets its rows.
                    key = f"{page_id}/{sha}"
                    seen[key] += 1
                    record_id, digest = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}/{context.partitionId()}/{seen[key]}")), hashlib.sha256()
                    head = _header(page_id.as_py(), record_id, url.as_py(), size.as_py(), sha.as_py(), refers_to.as_py())
                digest.update(part)
                yield record_id, no, last.as_py(), head, part, digest.copy().hexdigest()

    yield from _batches(rows(), _CHUNK_SCHEMA, _chunk_size)


def _chunk_size(row: tuple) -> int:
    return len(row[4]) + len(row[3] or b"") + 150


def to_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunk table of pages; see archive_and_read for nulls and repeated rows."""
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), empty_if_null(F.col(html_col)).alias("html"))
    return cut(read, chunk_bytes).drop("row").mapInArrow(_write, CHUNKS)


def parse_header(head: bytes) -> dict[str, str]:
    """WARC fields by lower-case name; the version line is at ''."""
    block = bytes(head).split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")
    return {"": block[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


class _Record:
    """A record as far as its chunks have come; it holds one hash and one header."""

    def __init__(self, record_id: str):
        self.record_id, self.fields, self.digest, self.size, self.next, self.intact, self.closed = record_id, {}, hashlib.sha256(), 0, 0, True, False

    def add(self, no: int, last: bool, head: bytes | None, data: pa.Buffer, running: str) -> None:
        if no == 0:
            self.fields = parse_header(head or b"")
        self.intact &= no == self.next and not self.closed
        self.next, self.closed = no + 1, last
        self.digest.update(data)
        self.size += len(data)
        self.intact &= self.digest.hexdigest() == running

    def row(self) -> tuple:
        """What the stream gave; a revisit has no payload of its own, so it tells what its header tells."""
        told, kind = self.fields.get("warc-payload-digest", "").removeprefix("sha256:"), self.fields.get("warc-type")
        length, digest = _number(self.fields.get("x-payload-length")), self.digest.hexdigest()
        intact = self.intact and self.closed and bool(self.fields)
        page_id, refers_to = _number(self.fields.get("x-page-id")), _number(self.fields.get("x-refers-to-page-id"))
        if kind == "revisit":
            return page_id, length, told, kind, refers_to, intact
        return page_id, self.size, digest, kind, refers_to, intact and digest == told and self.size == length


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to records. Whatever chunks are lost, the others of a record give a row that isn't intact."""

    def rows() -> Iterator[tuple]:
        record = None
        for batch in batches:
            for record_id, chunk_no, last, head, data, running in zip(*batch.columns, strict=True):
                if record is None or record.record_id != record_id.as_py() or chunk_no.as_py() == 0:
                    if record:
                        yield record.row()
                    record = _Record(record_id.as_py())
                record.add(chunk_no.as_py(), last.as_py(), head.as_py(), data.as_buffer(), running.as_py())
        if record:
            yield record.row()

    yield from _batches(rows(), _RECORD_SCHEMA, lambda r: 200)


def read_records(chunks: DataFrame) -> DataFrame:
    """A row per record. Records of one chunk are checked where they lie; only the chunks of longer ones are brought together."""
    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    single = (F.col("chunk_no") == 0) & F.col("last")
    short = chunks.where(single).select(*columns).mapInArrow(_read, RECORDS)
    long = chunks.where(~single).select(*columns).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, RECORDS)
    return short.union(long)


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact: pages written to an archive and read back.

    The archive is a Parquet chunk table in `folder` (default: a new folder in the shared checkpoint folder). Null html
    is an empty payload, a null url leaves its field out, repeated rows become records of their own (those with the
    smallest id are responses), an empty table gives an empty archive. Rows without a page_id are responses. Columns
    other than page_id, url and html are not read. intact tells whether all chunks of the record came, in order and with
    their digests; a record of which any chunk is left gives a row, without a page_id if its first chunk is lost.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    to_chunks(pages, chunk_bytes).write.option("compression", "zstd").parquet(folder)
    return read_records(spark.read.schema(CHUNKS).parquet(folder))


def write_files(chunks: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """path, records, bytes: each task writes its records to one .warc.gz file in folder, chunk by chunk, a gzip member a record.

    folder is a path or URI that all executors can write to. A file gets its name, which depends on the task's number alone,
    when it is whole, so a task that is run again replaces what it wrote. A record that lacks a chunk is an error.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = pa_fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/part-{context.partitionId():06d}.warc.gz"
        hidden, n, size, member, expected = f"{base}/.{context.taskAttemptId()}.tmp", 0, 0, None, None
        with store.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                for record_id, no, last, head, data, _ in zip(*batch.columns, strict=True):
                    if (record_id.as_py(), no.as_py()) != (expected or (record_id.as_py(), 0)):
                        raise ValueError(f"a chunk of record {expected and expected[0] or record_id} is missing")
                    member = member or gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
                    member.write(head.as_py() or b"")
                    member.write(data.as_buffer())
                    size += len(data.as_buffer()) + len(head.as_py() or b"")
                    expected = (record_id.as_py(), no.as_py() + 1)
                    if last.as_py():
                        member.write(b"\r\n\r\n")
                        member.close()
                        member, expected, n = None, None, n + 1
        if expected:
            raise ValueError(f"the last chunk of record {expected[0]} is missing")
        store.move(hidden, path) if n else store.delete_file(hidden)
        yield pa.RecordBatch.from_pydict({"path": [path] * bool(n), "records": [n] * bool(n), "bytes": [size] * bool(n)}, schema=_FILE_SCHEMA)

    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    dealt = chunks.select(*columns)
    dealt = dealt.repartition(files, "record_id") if files else dealt.repartition("record_id")
    return settle(dealt.sortWithinPartitions("record_id", "chunk_no").mapInArrow(write, "path string, records long, bytes long"))


def parse_stream(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of an uncompressed WARC stream from any writer; the block of a record is read chunk_bytes at a time.

    The data of http responses begins after the HTTP header, which stays in head, as in the table.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = bytearray(line)
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head += line
        head += b"\r\n"
        fields = parse_header(bytes(head))
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            while left and (line := stream.readline(left)):
                left -= len(line)
                head += line
                if line in (b"\r\n", b"\n"):
                    break
        record_id = fields.get("warc-record-id", "").removeprefix("<urn:uuid:").rstrip(">")
        digest, no = hashlib.sha256(), 0
        while True:
            part = stream.read(min(left, chunk_bytes))
            if left and not part:
                raise ValueError(f"record {record_id} ends early")
            left -= len(part)
            digest.update(part)
            yield record_id, no, left == 0, bytes(head) if no == 0 else None, part, digest.copy().hexdigest()
            no += 1
            if not left:
                break


def read_files(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of .warc and .warc.gz files that all executors can open under these paths or URIs; a task streams one file at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    store, inner = pa_fs.FileSystem.from_uri(path)
                    with store.open_input_stream(inner, compression=None) as f:
                        plain = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f
                        yield from parse_stream(io.BufferedReader(plain, 1 << 20), chunk_bytes)

        yield from _batches(rows(), _CHUNK_SCHEMA, _chunk_size)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(stream, CHUNKS)
