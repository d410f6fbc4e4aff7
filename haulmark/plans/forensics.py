"""Report on a session log: which chunks are missing, and is that a problem?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.forensics import (
    DIFFERENCES, acknowledging_only, category_mask, numbers_of, run_ends, run_starts, runs_of_categories, seq_words,
)
from haulmark.operators.sequences import MORE_RANGES, NO_RANGES

CATEGORIES = (
    "explicit_missing", "received_gaps", "started_minus_received", "failed_minus_received", "received_minus_sacked"
)
# Categories that make a session a problem; the last one is only a note.
PROBLEMS = CATEGORIES[:4]
#: Categories that are masks; gaps follow from the runs of the received numbers.
MASKS = ["explicit_missing", *DIFFERENCES]


def finding_ranges(log: DataFrame) -> DataFrame:
    """(session, category, range_start, range_end) of everything found."""
    words = seq_words(log)
    return acknowledging_only(runs_of_categories(words, MASKS, "received", "received_gaps"), words)


def _totals(words: DataFrame) -> DataFrame:
    """Per session: valid lines, received numbers, first and last of them, and ranges and numbers of each category."""
    received = F.when(F.col("received") != 0, F.col("word"))
    counts = [item for c in MASKS for item in (
        F.sum(F.bit_count(run_starts(c))).alias(f"{c}_ranges"), F.sum(F.bit_count(category_mask(c))).alias(f"{c}_count"))]
    summed = words.groupBy("session_id").agg(
        F.sum("valid_lines").alias("valid_lines"), F.sum(F.bit_count("received")).alias("received_chunks"), F.bool_or(F.col("sacked") != 0).alias("_acks"),
        F.sum(F.bit_count(run_starts("received"))).alias("_runs"), F.min(received).alias("_low"), F.max(received).alias("_high"),
        F.min_by("received", received).alias("_lowest"), F.max_by("received", received).alias("_highest"), *counts)
    edges = summed.withColumns({
        "first_seq": F.array_min(numbers_of(F.col("_low"), F.col("_lowest"))), "last_seq": F.array_max(numbers_of(F.col("_high"), F.col("_highest"))),
        # Unacknowledged numbers only count in sessions that acknowledged anything.
        **{f"received_minus_sacked_{x}": F.when(F.col("_acks"), F.col(f"received_minus_sacked_{x}")).otherwise(0) for x in ("ranges", "count")},
    })
    return edges.withColumns({
        "received_gaps_ranges": F.greatest(F.col("_runs") - 1, F.lit(0)),
        "received_gaps_count": F.coalesce(F.col("last_seq") - F.col("first_seq") + 1 - F.col("received_chunks"), F.lit(0)),
    })


def _exit_code() -> Column:
    problem = F.greatest(*[F.col(f"{c}_count") for c in PROBLEMS]) > 0
    return F.when(F.col("valid_lines") == 0, 2).when(problem, 1).otherwise(0)


def log_verdict(log: DataFrame) -> DataFrame:
    """Exit code per session: 0 nothing missing, 1 something missing, 2 no valid line."""
    return _totals(seq_words(log)).select(
        "session_id", (F.greatest(*[F.col(f"{c}_count") for c in PROBLEMS]) > 0).alias("problem"),
        (F.col("received_minus_sacked_count") > 0).alias("unsacked_note"), _exit_code().alias("exit_code"))


def _first_edges(words: DataFrame, limit: int) -> DataFrame:
    """Per session and category the first ``limit`` starts and ends of its runs (one more of the received ones), in order.

    They lie in the first words that have any, so a session gives at most ``limit + 1`` words for each of them before anything is gathered.
    """
    sides = [(f"{c}|{side}", edge(c)) for c in (*MASKS, "received") for side, edge in (("start", run_starts), ("end", run_ends))]
    masks = F.array(*[F.struct(F.lit(name).alias("edge"), mask.alias("mask")) for name, mask in sides])
    rows = words.filter("word IS NOT NULL").select("session_id", "word", F.explode(F.filter(masks, lambda m: m["mask"] != 0)).alias("m"))
    rows = rows.select("session_id", "word", F.col("m.edge").alias("edge"), F.col("m.mask").alias("mask"))
    place = F.row_number().over(Window.partitionBy("session_id", "edge").orderBy("word"))
    first = rows.withColumn("place", place).filter(F.col("place") <= limit + 1)
    gathered = first.groupBy("session_id", "edge").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("held"))
    numbers = F.slice(F.flatten(F.transform("held", lambda h: numbers_of(h["word"], h["mask"]))), F.lit(1), F.lit(limit + 1))
    return gathered.groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.struct("edge", numbers.alias("numbers")))).alias("edges"))  # ten entries at most


def _text(starts: Column, ends: Column, ranges: Column, limit: int) -> Column:
    """The first ranges and how many more there are."""
    one = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
    shown = F.zip_with(F.slice(starts, F.lit(1), F.least(ranges, F.lit(limit)).cast("int")), F.slice(ends, F.lit(1), F.least(ranges, F.lit(limit)).cast("int")), one)
    head, tail = MORE_RANGES.split("{}")
    more = F.when(ranges > limit, F.array(F.concat(F.lit(head), (ranges - limit).cast("string"), F.lit(tail)))).otherwise(F.array().cast("array<string>"))
    return F.when(ranges > 0, F.array_join(F.concat(shown, more), ", ")).otherwise(F.lit(NO_RANGES))


def forensic_report(log: DataFrame, limit: int = 12) -> DataFrame:
    """One row per session: counts, findings as ranges, verdict.

    ``msg`` is null on lines that are not valid.
    """
    words = seq_words(log)
    report = _totals(words).join(_first_edges(words, limit), "session_id", "left")
    edge = lambda c, side: F.col("edges")[f"{c}|{side}"]
    texts = {c: (edge(c, "start"), edge(c, "end")) for c in MASKS}
    # A gap begins after the end of a run and ends before the start of the next one.
    texts["received_gaps"] = (F.transform(edge("received", "end"), lambda n: n + 1), F.transform(F.slice(edge("received", "start"), F.lit(2), F.lit(limit)), lambda n: n - 1))
    return report.select(
        "session_id", "valid_lines", "received_chunks", "first_seq", "last_seq",
        *[F.col(f"{c}_count") for c in CATEGORIES],
        *[_text(*texts[c], F.col(f"{c}_ranges"), limit).alias(f"{c}_text") for c in CATEGORIES],
        _exit_code().alias("exit_code"),
    )
