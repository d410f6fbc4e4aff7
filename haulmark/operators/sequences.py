"""Chunk ledgers: first arrivals, contiguous prefix, gaps, islands and per-session statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from haulmark.operators.slices import SEQUENCES_PER_SLICE, running_by_slice, sequence_slice

# The largest chunk accepted, and the text of an empty or shortened range list.
MAX_CHUNK_BYTES = 32 * 1024 * 1024
NO_RANGES = "nenhum"
MORE_RANGES = "... (+{} intervalos)"


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose length is above zero and at most 32 MiB."""
    return chunks.filter(F.col("length").between(1, MAX_CHUNK_BYTES))


def rejected_chunks(chunks: DataFrame) -> DataFrame:
    """The side output of :func:`valid_chunks`; a missing length is rejected too."""
    return chunks.filter(~F.coalesce(F.col("length").between(1, MAX_CHUNK_BYTES), F.lit(False)))


def dedupe_chunks(chunks: DataFrame, keep: str = "first", arrival: str = "arrival") -> DataFrame:
    """One row per (session, sequence): the first arrival, or the last with ``keep='last_pending'``.

    An aggregation, not a window: copies of a hot chunk are folded on the map side. ``copies`` counts them.
    Equal arrivals are decided by the remaining columns, so the result never depends on the order of reading.
    """
    pick = {"first": F.min, "last_pending": F.max}[keep]
    rest = [c for c in chunks.columns if c not in ("session_id", "global_seq", arrival)]
    first = chunks.groupBy("session_id", "global_seq").agg(
        pick(F.struct(arrival, *rest)).alias("_row"), F.count("*").alias("copies")
    )
    return first.select(
        "session_id", "global_seq", *[F.col(f"_row.{c}").alias(c) for c in (arrival, *rest)], "copies"
    )


def late_and_duplicate_chunks(chunks: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Arrivals the lazy ledger ignores: everything but the one of each (session, sequence) that :func:`dedupe_chunks` keeps.

    Equal arrivals are decided by the remaining columns, as there; of rows equal in all columns one is kept.
    """
    keys, columns = ["session_id", "global_seq"], chunks.columns
    row = F.struct(arrival, *[c for c in columns if c not in (*keys, arrival)])
    counted = chunks.groupBy(*columns).agg(F.count("*").alias("_copies"))
    firsts = counted.groupBy(*keys).agg(F.min(row).alias("_first"))
    late = F.col("_copies") - row.eqNullSafe(F.col("_first")).cast("int")
    return (
        counted.join(firsts, keys).withColumn("_late", late).filter(F.col("_late") > 0)
        .withColumn("_late", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_late")))).select(*columns)
    )


def sequence_positions(distinct_chunks: DataFrame, width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """Rows with ``position`` (1-based rank in the session), ``bytes_so_far``, ``copies_so_far``, ``prev_seq``.

    Everything a session's statistics need comes from this one pass, so that the slice totals and the rows
    read the same columns and Spark computes their common input once.
    """
    copies = F.col("copies") if "copies" in distinct_chunks.columns else F.lit(1)
    return running_by_slice(
        distinct_chunks,
        ["session_id"],
        ["global_seq"],
        sequence_slice("global_seq", width),
        sums={"position": F.lit(1), "bytes_so_far": F.col("length"), "copies_so_far": copies},
        previous={"prev_seq": F.col("global_seq")},
    )


def contiguous_prefix(distinct_chunks: DataFrame, width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """Each chunk with ``assembled``: is it part of the gapless run that starts at sequence 0?"""
    placed = sequence_positions(distinct_chunks, width)
    return placed.withColumn("assembled", F.col("global_seq") == F.col("position") - 1).drop(
        "position", "bytes_so_far", "copies_so_far", "prev_seq"
    )


def chunk_session_stats(chunks: DataFrame, width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """One row per session of deduplicated chunks: frontier, pending part, gaps, duplicates and totals."""
    placed = sequence_positions(chunks, width)
    in_prefix = F.col("global_seq") == F.col("position") - 1
    gap = F.col("global_seq") - F.col("prev_seq") - 1
    totals = placed.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(in_prefix, F.col("position"))), F.lit(0)).alias("next_expected_seq"),
        F.coalesce(F.max(F.when(in_prefix, F.col("bytes_so_far"))), F.lit(0)).alias("assembled_bytes"),
        F.count("*").alias("received_chunks"),
        F.max("bytes_so_far").alias("total_bytes"),
        (F.max("copies_so_far") - F.count("*")).alias("duplicates"),
        F.min("global_seq").alias("first_seq"),
        F.max("global_seq").alias("last_seq"),
        F.count_if(gap > 0).alias("gap_ranges"),
        F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).alias("gap_chunks"),
    )
    return totals.select(
        "*",
        (F.col("received_chunks") - F.col("next_expected_seq")).alias("pending_chunks"),
        (F.col("total_bytes") - F.col("assembled_bytes")).alias("pending_bytes"),
        (F.col("last_seq") + 1).alias("total_chunks_lazy"),
        F.col("next_expected_seq").alias("total_chunks_eager"),
        (F.col("received_chunks") == F.col("next_expected_seq")).alias("assembled"),
        F.when(F.col("received_chunks") == F.col("next_expected_seq"), "done").otherwise("receiving").alias("phase"),
    )


def missing_ranges(values: DataFrame, keys: list[str], value: str, width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """Gaps strictly between consecutive distinct values of each key, as inclusive ranges."""
    distinct = values.select(*keys, value).distinct()
    placed = running_by_slice(
        distinct, keys, [value], sequence_slice(value, width), previous={"_before": F.col(value)}
    )
    return placed.filter(F.col(value) > F.col("_before") + 1).select(
        *keys, (F.col("_before") + 1).alias("range_start"), (F.col(value) - 1).alias("range_end")
    )


def values_to_ranges(values: DataFrame, keys: list[str], value: str, width: int = SEQUENCES_PER_SLICE) -> DataFrame:
    """Islands of consecutive values of each key, as inclusive ranges.

    ``value - rank`` is constant on an island and differs between islands, so the islands form by a
    grouping that Spark can pre-aggregate.
    """
    distinct = values.select(*keys, value).distinct()
    placed = running_by_slice(distinct, keys, [value], sequence_slice(value, width), sums={"_rank": F.lit(1)})
    return (
        placed.groupBy(*keys, (F.col(value) - F.col("_rank")).alias("_island"))
        .agg(F.min(value).alias("range_start"), F.max(value).alias("range_end"))
        .drop("_island")
    )


def format_ranges(ranges: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """Per key the first ``limit`` ranges as text, then how many more there are.

    Keys without ranges are not in the input; callers show :data:`NO_RANGES` for them.
    """
    first = Window.partitionBy(*keys).orderBy("range_start")
    text = F.when(
        F.col("range_start") == F.col("range_end"), F.col("range_start").cast("string")
    ).otherwise(F.concat_ws("-", "range_start", "range_end"))
    shown = (
        ranges.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= limit)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_n", text.alias("text")))).alias("_shown"))
    )
    size = F.col("range_end") - F.col("range_start") + 1
    totals = ranges.groupBy(*keys).agg(
        F.count("*").alias("range_count"), F.sum(size).alias("value_count")
    )
    head, tail = MORE_RANGES.split("{}")
    extra = F.when(
        F.col("range_count") > limit,
        F.array(F.concat(F.lit(head), (F.col("range_count") - limit).cast("string"), F.lit(tail))),
    ).otherwise(F.array().cast("array<string>"))
    return totals.join(shown, keys).select(
        *keys,
        "range_count",
        "value_count",
        F.array_join(F.concat(F.col("_shown.text"), extra), ", ").alias("ranges_text"),
    )
