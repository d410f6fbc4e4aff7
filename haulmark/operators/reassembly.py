"""Cutting payloads into chunks, putting them back in order, and the digests and verdicts of sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.sequences import contiguous_prefix

# A part holds at most this many chunks; at the largest accepted chunk of 32 MiB a part stays at 128 MiB.
CHUNKS_PER_PART = 4

# Bytes of the header in front of each chunk, and where a mismatch is narrowed down.
CHUNK_HEADER_BYTES = 13
HASH_CHECKPOINTS = (1 << 20, 10 << 20, 100 << 20)


def chunk_payloads(df: DataFrame, key: str, payload: str, chunk_bytes: int, active_slots: list[int]) -> DataFrame:
    """Cut a binary column into numbered chunks with checksum and slot, slots taken in turn.

    The last chunk may be short; an empty payload gives no chunk.
    """
    if not active_slots:
        raise ValueError("no active slot to send chunks on")
    size = F.octet_length(F.col(payload))
    count = F.ceil(size / F.lit(chunk_bytes)).cast("long")
    slots = F.array(*[F.lit(s).cast("short") for s in active_slots])
    numbered = df.filter(size > 0).select(
        F.col(key).alias("session_id"), payload, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("global_seq")
    )
    piece = F.expr(f"substring({payload}, cast(global_seq * {chunk_bytes} + 1 as int), {chunk_bytes})")
    return numbered.select("session_id", "global_seq", piece.alias("payload")).select(
        "session_id",
        "global_seq",
        F.octet_length("payload").cast("long").alias("length"),
        F.element_at(slots, (F.col("global_seq") % len(active_slots) + 1).cast("int")).alias("slot_id"),
        F.crc32("payload").alias("crc32"),
        "payload",
    )


def crc32_ok(payload: str = "payload", crc: str = "crc32") -> Column:
    """Does the IEEE CRC-32 of the payload equal the one sent with it?"""
    return F.crc32(F.col(payload)) == F.col(crc)


def frontiers(ledger: DataFrame) -> DataFrame:
    """Per session the first missing sequence (``frontier``) and ``last_seq``, from sequence numbers alone.

    Copies are allowed; no payload is read where the ledger holds none.
    """
    numbers = ledger.select("session_id", "global_seq").distinct().withColumn("length", F.lit(0).cast("long"))
    return contiguous_prefix(numbers).groupBy("session_id").agg(
        F.coalesce(F.max(F.when(F.col("assembled"), F.col("global_seq") + 1)), F.lit(0)).alias("frontier"),
        F.max("global_seq").alias("last_seq"),
    )


def assembly_status(chunks: DataFrame, mode: str = "eager") -> DataFrame:
    """Per session of distinct chunks: may it be assembled, and the first sequence that is missing.

    Eager assembly takes the gapless prefix and always succeeds; lazy assembly fails on the first gap.
    """
    whole = F.col("frontier") == F.col("last_seq") + 1
    return frontiers(chunks).select(
        "session_id",
        (whole if mode == "lazy" else F.lit(True)).alias("can_assemble"),
        F.when(~whole, F.col("frontier")).alias("first_missing_seq"),
    )


def reassemble(chunks: DataFrame, mode: str = "eager", chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Payload of each session in sequence order, as numbered parts of bounded size.

    ``chunks`` holds one row per (session, sequence). A session of up to ``chunks_per_part`` chunks is one
    part. Lazy sessions with a gap give no part; see :func:`assembly_status` for the sequence they lack.
    What may be taken is decided on sequence numbers and joined as one row per part, by the key the parts
    are grouped by: payloads are shuffled once.
    """
    taken = frontiers(chunks)
    if mode == "lazy":
        taken = taken.filter(F.col("frontier") == F.col("last_seq") + 1)
    parts = taken.filter("frontier > 0").select(
        "session_id", F.col("frontier").alias("_until"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("frontier") - 1) / chunks_per_part).cast("long"))).alias("part_no"),
    )
    numbered = chunks.select("session_id", "global_seq", "payload", _part(chunks_per_part).alias("part_no"))
    return _concat(numbered.join(parts, ["session_id", "part_no"]).filter(F.col("global_seq") < F.col("_until")))


def _part(chunks_per_part: int) -> Column:
    return F.floor(F.col("global_seq") / chunks_per_part).cast("long")


def _concat(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("session_id", "part_no").agg(
        F.expr("listagg(payload, X'') WITHIN GROUP (ORDER BY global_seq)").alias("payload"),
        F.count("*").alias("chunks"),
    )


def concat_parts(chunks: DataFrame, chunks_per_part: int = CHUNKS_PER_PART) -> DataFrame:
    """Concatenate runs of ``chunks_per_part`` consecutive sequence numbers."""
    return _concat(chunks.withColumn("part_no", _part(chunks_per_part)))


def _digest_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over rows that arrive ordered by (session, sequence); of a sequence that repeats the first row counts.

    Holds one running digest.
    """
    current, digest, size, last = None, None, 0, None
    done: list[tuple] = []
    kind = None

    def pack() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
            ["session_id", "sha256", "total_bytes"],
        )

    for batch in batches:
        kind = batch.column("session_id").type
        rows = zip(*(batch.column(c).to_pylist() for c in ("session_id", "global_seq", "payload")))
        for session, sequence, payload in rows:
            if digest is None or session != current:
                if digest is not None:
                    done.append((current, digest.hexdigest(), size))
                current, digest, size, last = session, hashlib.sha256(), 0, None
            if sequence == last:
                continue
            last = sequence
            digest.update(payload or b"")
            size += len(payload or b"")
        yield pack()
        done.clear()
    if digest is not None:
        done.append((current, digest.hexdigest(), size))
        yield pack()


def session_digests(chunks: DataFrame, frontier: DataFrame | None = None, tie: list[str] | None = None) -> DataFrame:
    """SHA-256 and size of each session's payload, shuffled once.

    SHA-256 cannot be computed from pieces, so a session streams through one task chunk by chunk, holding only
    the running digest. With ``frontier`` (``session_id``, ``frontier``) only sequences below it count; of the
    copies of a sequence the first by ``tie`` does.
    """
    key_type = chunks.schema["session_id"].dataType.simpleString()
    spread = chunks.select("session_id", "global_seq", "payload", *(tie or [])).repartition("session_id")
    if frontier is not None:
        spread = spread.join(frontier, "session_id").filter(F.col("global_seq") < F.col("frontier"))
    ordered = spread.sortWithinPartitions("session_id", "global_seq", *(tie or []))
    return ordered.select("session_id", "global_seq", "payload").mapInArrow(
        _digest_in_order, f"session_id {key_type}, sha256 string, total_bytes long"
    )


def verify_session(digests: DataFrame, trailers: DataFrame, mode: str = "parallel") -> DataFrame:
    """Verdict of each trailer against what was assembled; only the parallel path compares sizes."""
    total = F.coalesce(F.col("total_bytes"), F.lit(0))
    verdict = F.when(total == 0, "write_error").when(
        ~F.col("_digest").eqNullSafe(F.col("sha256")), "checksum_mismatch"
    )
    if mode == "parallel":
        verdict = verdict.when(total != F.col("size"), "write_error")
    return (
        trailers.join(digests.withColumnRenamed("sha256", "_digest"), "session_id", "left")
        .select("session_id", total.alias("total_bytes"), verdict.otherwise("ok").alias("result"))
    )


def file_checksum(objects: DataFrame, content: str = "content") -> DataFrame:
    """Add SHA-256 and size of a binary column."""
    return objects.withColumns(
        {"sha256": F.sha2(content, 256), "size_bytes": F.octet_length(content).cast("long")}
    )


def partial_hash_checkpoints(
    sessions: DataFrame, content: str = "content", checkpoints: tuple[int, ...] = HASH_CHECKPOINTS
) -> DataFrame:
    """For sessions that ended in a checksum mismatch, the SHA-256 of each prefix that is long enough."""
    return (
        sessions.filter(F.col("result") == "checksum_mismatch")
        .withColumn("offset", F.explode(F.array(*[F.lit(c).cast("long") for c in checkpoints])))
        .filter(F.octet_length(content) >= F.col("offset"))
        .select(
            "session_id", "offset",
            F.sha2(F.expr(f"substring({content}, 1, cast(offset as int))"), 256).alias("partial_sha256"),
        )
    )


def last_offset(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Acknowledged offset of each stream: chunk bytes plus one header per chunk."""
    return chunks.groupBy(*keys).agg(F.sum(F.col("length") + CHUNK_HEADER_BYTES).alias("last_offset"))


def write_ordered_chunks(chunks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write payload rows so that reading the files in name order gives each session in sequence order.

    Range partitioning on (session, sequence) lets a large session span several files.
    """
    order = ["session_id", "global_seq"]
    spread = chunks.repartitionByRange(partitions, *order) if partitions else chunks.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.parquet(path)
