"""From the arrivals of chunks to one verdict per transfer session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.operators.reassembly import crc32_ok, frontiers, session_digests, verify_session
from haulmark.operators.sequences import (
    SEQUENCES_PER_SLICE,
    chunk_session_stats,
    dedupe_chunks,
    rejected_chunks,
    valid_chunks,
)


def audit_transfer(chunks: DataFrame, mode: str = "lazy", width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """Ledger verdict per session: what arrived, what is missing, and can the session be assembled?

    Only lengths and sequence numbers are shuffled. ``mode`` decides whether a gap fails the session, and which
    bytes count: lazy assembly writes all of them, eager assembly the gapless prefix. A session whose chunks
    were all rejected has nothing to write.
    """
    ledger = chunks.select("session_id", "global_seq", "length", "arrival")
    stats = chunk_session_stats(dedupe_chunks(valid_chunks(ledger)), width)
    rejected = rejected_chunks(ledger).groupBy("session_id").agg(F.count("*").alias("rejected_chunks"))
    both = stats.join(rejected, "session_id", "full")
    zero = ("received_chunks", "duplicates", "total_bytes", "assembled_bytes", "next_expected_seq", "pending_chunks", "pending_bytes",
            "gap_ranges", "gap_chunks", "rejected_chunks")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"assembled": F.coalesce("assembled", F.lit(False))})
    written = F.col("total_bytes") if mode == "lazy" else F.col("assembled_bytes")
    verdict = F.when(written == 0, "write_error")
    if mode == "lazy":
        verdict = verdict.when(~F.col("assembled"), "missing_chunks")
    return both.select(
        "session_id", "received_chunks", "duplicates", "total_bytes", "first_seq", "last_seq", "next_expected_seq",
        "pending_chunks", "pending_bytes", "gap_ranges", "gap_chunks", "assembled",
        F.when(~F.col("assembled"), F.col("next_expected_seq")).alias("first_missing_seq"),
        "rejected_chunks",
        verdict.otherwise("ok").alias("verdict"),
    )


def audit_payloads(chunks: DataFrame, trailers: DataFrame, mode: str = "parallel") -> DataFrame:
    """Verdict per session from the payload itself: gapless prefix, digest, comparison with the trailer.

    Chunks of a bad length, and those whose ``crc32`` (where the column exists) is not that of their payload,
    are rejected first. Gaps are found on sequence numbers; the payload is shuffled once, by session, and of
    the copies of a sequence the first to arrive counts, equal arrivals by a hash of the payload.
    """
    accepted = valid_chunks(chunks)
    if "crc32" in chunks.columns:
        accepted = accepted.filter(F.coalesce(crc32_ok(), F.lit(False)))
    accepted = accepted.select("session_id", "global_seq", "arrival", "payload").withColumn("_tie", F.xxhash64("payload"))
    prefix = frontiers(accepted).select("session_id", "frontier")
    return verify_session(session_digests(accepted, prefix, ["arrival", "_tie"]), trailers, mode)
