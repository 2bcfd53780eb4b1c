"""WARC archives as a chunked record table.

A payload is rows (row_id, record_id, uri, chunk_no, chunk), where row_id is the
number of its row: it is cut first, and no later step needs a whole record at once.
Digesting keeps a running SHA-1 from chunk to chunk, writing a running compressor,
reading a running decompressor and SHA-1. The digest that the first pass has carried
to a record's last chunk is what decides about duplicates and what stands in its
header; reading compares it with the digest of what it reads.

    chunked        rows with a payload column → record table
    digested       record table → one row per record: bytes and digest
    duplicates     those → which record is a response and which revisits which
    write_archives record table in record order → .warc.gz files, a manifest row per file
    read_archives  files → record table again, header fields with chunk 0, digest with the last

A record's WARC-Record-ID is made of its record id and its row's number, so no two
records share one; each file begins with a warcinfo record. A record without a url has
its own record id as WARC-Target-URI, and what may not stand in a header is percent-encoded.

A file's name holds the attempt that wrote it, and the manifest lists the files
of the attempts that ended well, so lost executors leave no half archives in it.
Files go to any store that pyarrow can reach by the URI of the shared folder.

Defined results: a null payload is empty. A null record id is read back as null and
counts as the smallest. Repeated rows are records of their own; those with the same
id and payload are all of them responses if that id is the payload's largest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, settled, written

CHUNK = 1 << 20
WHEN = "1970-01-01T00:00:00Z"  # archives of the same rows are the same bytes
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INFO = b"software: regulith\r\nformat: WARC File Format 1.1\r\n"
CHUNKS = "record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunk binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row_id, record_id, uri, chunk_no, last, chunk from row_id, record_id, uri and payload, a record's chunks one after another."""
    whole = rows.select("row_id", "record_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    number = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    each = whole.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("last", F.col("chunk_no") == number - 1)
    return each.select("row_id", "record_id", "uri", "chunk_no", "last", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("chunk"))


def digested(chunks: DataFrame) -> DataFrame:
    """row_id, record_id, payload_bytes and payload_digest (base32 SHA-1), carried from chunk to chunk."""
    names = ["row_id", "record_id", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            done = []
            for row, key, last, chunk in zip(batch["row_id"].to_pylist(), batch["record_id"].to_pylist(), batch["last"].to_pylist(), batch["chunk"]):
                view = chunk.as_buffer()
                state.update(view)
                size += view.size
                if last:
                    done.append((row, key, size, base32(state.digest())))
                    state, size = hashlib.sha1(), 0
            columns = zip(*done) if done else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)

    return chunks.select("row_id", "record_id", "last", "chunk").mapInArrow(run, "row_id long, record_id long, payload_bytes long, payload_digest string")


def duplicates(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """row_id, payload_bytes, payload_digest, and refers_to and refers_row: the record with the largest id of the same payload if its id is another, else null.

    Digests are counted with partial sums, and only those held by several records come back, as a
    written table: both sides of the join are then plain exchanges, which Spark splits where a
    payload has very many records.
    """
    spark = digests.sparkSession
    heads = digests.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d"))
    heads = heads.agg(F.max(F.struct("record_id", "row_id")).alias("head"), F.count("*").alias("n")).where("n > 1 and head.record_id is not null").select("d", "head")
    heads = written(heads, scratch(spark, "warc-heads"))
    joined = digests.join(heads, digests.payload_digest == heads.d, "left")
    own = F.col("record_id").eqNullSafe(F.col("head.record_id")) | (F.col("payload_bytes") < min_bytes)
    refers = lambda c: F.when(~own, F.col(f"head.{c}"))
    return joined.select("row_id", "payload_bytes", "payload_digest", refers("record_id").alias("refers_to"), refers("row_id").alias("refers_row"))


def _urn(key: int | None, row: int) -> str:
    return f"<urn:record:{'' if key is None else key}:{row}>"


def _head(kind: str, row: int, key: int | None, uri: str | None, refers: tuple[int, int] | None, size: int, digest: str) -> bytes:
    target = quote(uri, safe="!#$%&'()*+,/:;=?@[]~-._") if uri else _urn(key, row)[1:-1]
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(key, row)}", f"WARC-Target-URI: {target}", f"WARC-Date: {WHEN}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        fields += [f"WARC-Refers-To: {_urn(*refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = len(HTTP) + (0 if refers is not None else size)
    return "\r\n".join([*fields, "Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]).encode()


def _info(name: str) -> bytes:
    fields = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {WHEN}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(INFO)}", "", ""]
    return "\r\n".join(fields).encode() + INFO + b"\r\n\r\n"


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write one .warc.gz for each partition of ``chunks``; path and number of records of each.

    Rows: those of ``chunked`` with payload_bytes, payload_digest, refers_to and refers_row, a record's
    chunks one after another. Each record is a gzip member of its own. Revisits carry no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records, pack = None, 0, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("row_id", "record_id", "uri", "chunk_no", "last", "payload_bytes", "payload_digest", "refers_to", "refers_row")]
            for row, key, uri, number, last, size, digest, to, to_row, chunk in zip(*columns, batch["chunk"]):
                if out is None:
                    store, at = pa.fs.FileSystem.from_uri(folder)
                    store.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(gzip.compress(_info(name), level, mtime=0))
                if number == 0:
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    refers = None if to is None else (to, to_row)
                    out.write(pack.compress(_head("response" if to is None else "revisit", row, key, uri, refers, size, digest) + HTTP))
                if to is None:
                    out.write(pack.compress(chunk.as_buffer()))
                if last:
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"], pa.array([records], pa.int64())], ["path", "records"])

    return chunks.mapInArrow(run, "path string, records long")


class _Members:
    """Bytes of a file of gzip members, as they are asked for."""

    def __init__(self, source, block: int = 1 << 18):
        self.source, self.block, self.raw, self.data, self.unpack = source, block, b"", b"", None

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.block)
                if not self.raw:
                    if self.unpack is not None:
                        raise EOFError("the archive ends within a record")
                    return False
            self.unpack = self.unpack or zlib.decompressobj(31)
            got = self.unpack.decompress(self.raw, self.block)
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, None
            if got:
                self.data += got
                return True

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the file."""
        while (end := self.data.find(b"\r\n")) < 0:
            if not self.more():
                if self.data:
                    raise EOFError("the archive ends within a line")
                return None
        line, self.data = self.data[:end], self.data[end + 2 :]
        return line

    def take(self, most: int) -> bytes:
        """``most`` bytes at most, one at least."""
        while len(self.data) < most:
            if not self.more():
                raise EOFError("the archive ends within a payload")
        got, self.data = self.data[:most], self.data[most:]
        return got


def records(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record id, type, refers to, bytes, digest, chunk number, chunk); bytes and digest come with the last chunk.

    A response's digest is that of the bytes read, and has to be the one in its header.
    """
    members = _Members(source)
    number_of = re.compile(rb"<urn:record:(-?\d*):\d+>")
    while (line := members.line()) is not None:
        if line != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while line := members.line():
            name, _, value = line.partition(b": ")
            fields[name] = value
        if fields[b"WARC-Type"] not in (b"response", b"revisit"):
            left = int(fields[b"Content-Length"])
            while left:
                left -= len(members.take(min(chunk, left)))
            if members.take(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its header says")
            continue
        key, refers = (int(m[1]) if (m := number_of.match(fields.get(f, b""))) and m[1] else None for f in (b"WARC-Record-ID", b"WARC-Refers-To"))
        kind, left = fields[b"WARC-Type"].decode(), int(fields[b"Content-Length"])
        while line := members.line():
            left -= len(line) + 2
        left -= 2
        digest = fields[b"WARC-Payload-Digest"].decode().partition(":")[2]
        if kind == "revisit":
            yield key, kind, refers, int(fields[b"X-Payload-Length"]), digest, 0, b""
        else:
            state, size, number = hashlib.sha1(), 0, 0
            while True:
                part = members.take(min(chunk, left - size)) if left > size else b""
                state.update(part)
                size += len(part)
                last = size == left
                if last and base32(state.digest()) != digest:
                    raise ValueError(f"record {key} has another digest than its header")
                yield key, kind, None, size if last else None, digest if last else None, number, part
                if last:
                    break
                number += 1
        if members.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {key} doesn't end where its header says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """Record table of the files in ``manifest.path``; without ``payload`` chunks are read and digested but stay behind."""
    schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, at = pa.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as source:
                    for row in records(source, chunk):
                        rows.append(row if payload else (*row[:6], b""))
                        size += len(rows[-1][6])
                        if size > 8 * CHUNK or len(rows) >= 4096:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def archive(spark: SparkSession, df: DataFrame, id_col: str, payload_col: str, folder: str, uri_col: str | None = None, chunk: int = CHUNK, min_bytes: int = 0) -> DataFrame:
    """Write ``df`` as archives below ``folder``, duplicates as revisits, and return the manifest.

    Only digests are grouped. Chunks move once, to meet the digest and size of their whole payload and what
    their record was found to be, by row number, of which none repeats.
    """
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    source = settled(df.select(F.col(id_col).cast("long").alias("record_id"), uri.alias("uri"), F.col(payload_col).cast("binary").alias("payload")), f"{folder}/source")
    rows = chunked(source.withColumn("row_id", F.monotonically_increasing_id()), chunk)
    found = written(digested(rows), f"{folder}/digests")
    judged = written(duplicates(found, min_bytes).withColumnRenamed("row_id", "r"), f"{folder}/judged")
    told = rows.join(judged, F.col("row_id") == F.col("r")).sortWithinPartitions("row_id", "chunk_no")
    return written(write_archives(told, f"{folder}/warc"), f"{folder}/manifest")


def through_archives(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", chunk: int = CHUNK, min_bytes: int = 0) -> DataFrame:
    """One row per row of ``df``, as read back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    manifest = archive(spark, df, id_col, payload_col, scratch(spark, "warc"), uri_col, chunk, min_bytes)
    back = read_archives(manifest.repartition(max(1, manifest.count())), chunk, payload=False).where(F.col("payload_digest").isNotNull())
    return back.select(F.col("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same for DuckDB, over a table ``pages``.
SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM hashed
), headed AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM coded
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM headed
"""
