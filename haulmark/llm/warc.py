"""WARC archives as chunked record tables.

A payload is cut into chunks, rows of record identifier and chunk number, before anything moves. Each chunk is written as one
WARC record: the first of a payload as ``response``, the others as ``continuation`` segments, and repeated payloads as
``revisit`` without content. Archives are gzip text files, so one task reads one archive as a stream; the reader yields
chunk rows with the running SHA-1 of their payload, and holds one chunk at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import batches, materialize
from haulmark.session import scratch_path

#: Bytes of a chunk.
CHUNK = 1 << 20
BREAK = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

CHUNKS = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, "
    "chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 40 bits at a time through base-32 digits, which stand for the letters of RFC 4648."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(records: DataFrame, least: int = 0) -> DataFrame:
    """``key``, ``payload`` -> one row per key and digest with ``payload_bytes``, ``record_type`` and ``refers_to``.

    Of the payloads of at least ``least`` bytes that are equal, the one with the largest key is the response and the others
    revisit it; shorter ones are all responses. Null keys are the smallest. Rows equal in key and payload share their role.
    """
    meta = materialize(records.select(
        "key", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-digests")
    firsts = meta.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select(F.col("digest").alias("d"), "first", F.lit(True).alias("many"))
    repeated = F.coalesce("many", F.lit(False)) & (F.col("payload_bytes") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    return meta.join(firsts, meta.digest == F.col("d"), "left").select(
        "key", "digest", "payload_bytes", F.when(repeated, "revisit").otherwise("response").alias("record_type"),
        F.when(repeated, F.col("first")).alias("refers_to")).distinct()


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _urn(*parts: Column | str) -> Column:
    return F.concat(F.lit("<urn:page:"), *[F.lit(p) if isinstance(p, str) else _text(p) for p in parts], F.lit(">"))


def write_archives(records: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """``key`` (long), ``uri``, ``payload`` (binary) -> archives under ``path``, a folder all executors reach.

    Null payloads and URIs are empty. The chunks of a record lie in one archive, in order; rows move as chunks of at most
    ``chunk`` bytes.
    """
    rows = records.select("key", F.translate(F.coalesce("uri", F.lit("")), "\r\n", "").alias("uri"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    role = materialize(roles(rows, least), "warc-roles").select(
        _text(F.col("key")).alias("rid"), "digest", "payload_bytes", "record_type", "refers_to")
    size = F.octet_length("payload")
    chunks = (
        rows.withColumns({"row": F.monotonically_increasing_id(), "rid": _text(F.col("key")), "digest": base32_sha1(F.col("payload")), "pieces": F.greatest(F.ceil(size / chunk), F.lit(1))})
        .withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .withColumn("data", F.substring("payload", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk))).drop("payload")
        .repartition("rid", "digest").join(role, ["rid", "digest"])
        .filter((F.col("record_type") == "response") | (F.col("no") == 0))
        .sortWithinPartitions("rid", "digest", "row", "no")
    )
    visit = F.col("record_type") == "revisit"
    data = F.when(visit, F.lit(b"")).otherwise(F.col("data"))
    split, first, last = (F.col("pieces") > 1) & ~visit, F.col("no") == 0, F.col("no") == F.col("pieces") - 1
    lines: list[tuple[Column | bool, str, Column]] = [
        (True, "WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        (True, "WARC-Record-ID", F.when(first, _urn(F.col("key"))).otherwise(_urn(F.col("key"), ":", F.col("no")))),
        (True, "WARC-Date", F.lit(DATE)),
        (True, "WARC-Target-URI", F.col("uri")),
        (first, "WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        (first, "WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        (True, "WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(data))),
        (visit, "WARC-Refers-To", _urn(F.col("refers_to"))),
        (split, "WARC-Segment-Number", (F.col("no") + 1).cast("string")),
        (split & ~first, "WARC-Segment-Origin-ID", _urn(F.col("key"))),
        (split & last, "WARC-Segment-Total-Length", F.col("payload_bytes").cast("string")),
        (True, "Content-Type", F.lit("text/html; charset=utf-8")),
        (True, "Content-Length", F.octet_length(data).cast("string")),
    ]
    fields = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if on is True else F.when(on, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
              for on, name, value in lines]
    header = F.concat(F.lit("WARC/1.0\r\n"), *fields, F.lit("\r\n"))
    record = F.concat(F.encode(header, "UTF-8"), data).cast("string")  # bytes are kept as they are
    chunks.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


@dataclass
class _Payload:
    """A payload that is being read: its first header, and the digest of what has come so far."""

    header: dict[str, str]
    sha1: object
    size: int = 0
    chunks: int = 0


class ArchiveReader:
    """Cuts the byte stream of one archive into chunk rows; memory is one record."""

    def __init__(self) -> None:
        self.buffer, self.header, self.open = bytearray(), None, None

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.buffer += piece + BREAK.encode()
        while True:
            if self.header is None:
                end = self.buffer.find(BREAK.encode())
                if end < 0:
                    return
                first, *lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no WARC record starts here: {first[:80]!r}")
                self.header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
                del self.buffer[:end + 4]
            size = int(self.header["Content-Length"])
            if len(self.buffer) < size + 4:
                return
            data = bytes(self.buffer[:size])
            del self.buffer[:size + 4]
            header, self.header = self.header, None
            yield self._row(header, data)

    def _row(self, header: dict[str, str], data: bytes) -> dict:
        if header["WARC-Type"] != "continuation":
            self.open = _Payload(header, hashlib.sha1())
        at = self.open
        if at is None or header.get("WARC-Segment-Origin-ID", header["WARC-Record-ID"]) != at.header["WARC-Record-ID"]:
            raise ValueError(f"segment {header['WARC-Record-ID']} does not follow its origin")
        at.sha1.update(data)
        at.size += len(data)
        at.chunks += 1
        kind, total = at.header["WARC-Type"], int(at.header["WARC-Payload-Length"])
        so_far, wanted = base64.b32encode(at.sha1.digest()).decode(), at.header["WARC-Payload-Digest"].removeprefix("sha1:")
        last = kind == "revisit" or at.size == total
        if last and kind != "revisit" and so_far != wanted:
            raise ValueError(f"digest of {at.header['WARC-Record-ID']} is {so_far}, not {wanted}")
        return {
            "record_id": at.header["WARC-Record-ID"], "record_type": kind, "target_uri": at.header.get("WARC-Target-URI"),
            "refers_to": at.header.get("WARC-Refers-To"), "payload_digest": wanted, "payload_bytes": total, "chunk_no": at.chunks - 1,
            "data": data, "bytes_so_far": at.size, "digest_so_far": so_far, "last": last,
        }

    def close(self) -> None:
        if self.header is not None or self.buffer.strip(b"\r\n") or (self.open and self.open.header["WARC-Type"] != "revisit" and self.open.size != int(self.open.header["WARC-Payload-Length"])):
            raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """Chunk rows of the archives written by :func:`write_archives`; without ``data`` the bytes are left out.

    Every payload is digested again while it streams by; a wrong digest, a missing segment or a cut archive fails the task.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()),
        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, reader = None, ArchiveReader()
        for part in parts:
            for file, piece in zip(part.column("file").to_pylist(), part.column("piece").to_pylist()):
                if file != name:
                    reader.close()
                    name, reader = file, ArchiveReader()
                for row in reader.feed(piece):
                    yield row if data else row | {"data": None}
        reader.close()

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(chunks(parts), schema, 64 if data else 2048)

    pieces = spark.read.option("lineSep", BREAK).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(read, CHUNKS)


def archive_round_trip(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` to archives and read them back: one row per page.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. Null html is an empty
    payload, a null key is kept, repeated rows give repeated records, an empty table gives no rows. Other columns of
    ``pages`` are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload")), path, least, chunk)
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1)
    return read_archives(spark, path, data=False).filter("last").select(
        F.nullif(key("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.nullif(key("refers_to"), F.lit("")).cast("long").alias("refers_to"))
