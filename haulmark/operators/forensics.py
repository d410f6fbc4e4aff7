"""Set algebra on the sequence numbers of session logs.

``log`` has session_id, msg and seq, where seq is the missing number for ``missing_chunk_in_assembly``.

Numbers are gathered 64 at a time: one row of a session and *word* has a bit mask for each set, built by an aggregation that folds
before its only shuffle. Differences of sets are bit operations, counts are counts of bits, and the runs of consecutive numbers are bits
whose neighbour is not set. So that runs may cross words, the number on either side of a word is noted in that word too
(``below`` and ``above``, a bit for each set).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.slices import SEQUENCES_PER_SLICE, running_by_slice, sequence_slice

# The log messages that carry sequence numbers, and the set each one feeds.
MESSAGES = {
    "chunk_receive_started": "started",
    "chunk_received": "received",
    "ChunkSACK sent": "sacked",
    "chunk_receive_failed": "failed",
    "missing_chunk_in_assembly": "explicit_missing",
}
SETS = list(MESSAGES.values())
#: Numbers in one set and not in another; the others are sets of their own.
DIFFERENCES = {
    "started_minus_received": ("started", "received"),
    "failed_minus_received": ("failed", "received"),
    "received_minus_sacked": ("received", "sacked"),
}
BITS = 64


def seq_words(log: DataFrame) -> DataFrame:
    """One row per (session, word) with the masks of all sets, ``below``, ``above`` and the number of valid lines.

    Lines without a known message or number only count as lines; their word is null.
    """
    known = F.col("msg").isin(*MESSAGES) & F.col("seq").isNotNull()
    code = reduce(lambda found, i: found.when(F.col("msg") == list(MESSAGES)[i], F.lit(1 << i)), range(1, len(MESSAGES)),
                  F.when(F.col("msg") == list(MESSAGES)[0], F.lit(1)))
    word, bit = F.floor(F.col("seq") / F.lit(BITS)).cast("long"), F.pmod("seq", F.lit(BITS)).cast("int")
    own = F.struct(word.alias("word"), F.lit(0).alias("side"))
    places = F.when(~F.coalesce(known, F.lit(False)), F.array(F.struct(F.lit(None).cast("long").alias("word"), F.lit(0).alias("side"))))
    places = places.when(bit == BITS - 1, F.array(own, F.struct((word + 1).alias("word"), F.lit(-1).alias("side"))))
    places = places.when(bit == 0, F.array(own, F.struct((word - 1).alias("word"), F.lit(1).alias("side")))).otherwise(F.array(own))
    rows = log.select("session_id", F.col("msg").isNotNull().alias("valid"), F.coalesce(code, F.lit(0)).alias("code"), bit.alias("bit"), F.explode(places).alias("at"))
    side = F.col("at.side")
    mask = lambda name: F.bit_or(F.when((side == 0) & (F.col("code") == 1 << SETS.index(name)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
    note = lambda where: F.coalesce(F.bit_or(F.when(side == where, F.col("code"))), F.lit(0))
    return rows.groupBy("session_id", F.col("at.word").alias("word")).agg(
        *[F.coalesce(mask(name), F.lit(0).cast("long")).alias(name) for name in SETS], note(-1).alias("below"), note(1).alias("above"),
        F.count_if(F.col("valid") & (side == 0)).alias("valid_lines"))


def category_mask(category: str) -> Column:
    """The numbers of a category in a word: those of a set, or of a difference."""
    if category not in DIFFERENCES:
        return F.col(category)
    have, lack = DIFFERENCES[category]
    return F.col(have).bitwiseAND(F.bitwise_not(F.col(lack)))


def _neighbour(category: str, note: str) -> Column:
    """1 if the number beside the word is in the category, else 0."""
    has = lambda name: F.call_function("shiftright", F.col(note), F.lit(SETS.index(name))).bitwiseAND(F.lit(1)).cast("long")
    if category not in DIFFERENCES:
        return has(category)
    have, lack = DIFFERENCES[category]
    return has(have).bitwiseAND(F.bitwise_not(has(lack)))


def run_starts(category: str) -> Column:
    """Bits at which a run of consecutive numbers of the category begins."""
    mask = category_mask(category)
    before = F.shiftleft(mask, 1).bitwiseOR(_neighbour(category, "below"))
    return mask.bitwiseAND(F.bitwise_not(before))


def run_ends(category: str) -> Column:
    """Bits at which such a run ends."""
    mask = category_mask(category)
    after = F.shiftrightunsigned(mask, 1).bitwiseOR(F.shiftleft(_neighbour(category, "above"), BITS - 1))
    return mask.bitwiseAND(F.bitwise_not(after))


def numbers_of(word: Column, mask: Column) -> Column:
    """The sequence numbers of a mask, in order."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("bit_get", mask, i) == 1)
    return F.transform(bits, lambda i: word * BITS + i)


def distinct_seq_sets(log: DataFrame) -> DataFrame:
    """Distinct sequence numbers per session and set, for sessions that have any."""
    return seq_words(log).filter("word IS NOT NULL").groupBy("session_id").agg(
        *[F.sum(F.bit_count(name)).alias(name) for name in SETS]
    )


def acknowledging_only(found: DataFrame, words: DataFrame) -> DataFrame:
    """Drop ``received_minus_sacked`` of sessions that acknowledged nothing at all."""
    acknowledging = words.groupBy("session_id").agg(F.bool_or(F.col("sacked") != 0).alias("_acks"))
    return (
        found.join(acknowledging, "session_id")
        .filter((F.col("category") != "received_minus_sacked") | F.col("_acks"))
        .drop("_acks")
    )


def set_differences(log: DataFrame) -> DataFrame:
    """(session, category, seq) of started, failed and acknowledged numbers that do not match the received ones.

    Numbers received without acknowledgement only count in sessions that acknowledged anything.
    """
    words = seq_words(log)
    masks = F.array(*[F.struct(F.lit(c).alias("category"), category_mask(c).alias("mask")) for c in DIFFERENCES])
    listed = words.select("session_id", "word", F.explode(F.filter(masks, lambda m: m["mask"] != 0)).alias("m"))
    differences = listed.select("session_id", F.col("m.category").alias("category"), F.explode(numbers_of(F.col("word"), F.col("m.mask"))).alias("seq"))
    return acknowledging_only(differences, words)


def runs_of_categories(words: DataFrame, categories: list[str], gaps_of: str | None = None, gaps_as: str = "gaps") -> DataFrame:
    """(session, category, range_start, range_end) of the runs of each category, and the gaps between those of ``gaps_of``.

    The n-th run of a session begins at the n-th start and ends at the n-th end. Both are numbered by running counts over words,
    64 numbers a row, and meet on that number; a gap lies between an end and the next start.
    """
    wanted = [*categories, *([gaps_of] if gaps_of and gaps_of not in categories else [])]
    items = F.array(*[F.struct(F.lit(c).alias("category"), run_starts(c).alias("starts"), run_ends(c).alias("ends")) for c in wanted])
    rows = words.filter("word IS NOT NULL").select("session_id", "word", F.explode(F.filter(items, lambda x: (x["starts"] != 0) | (x["ends"] != 0))).alias("x"))
    rows = rows.select("session_id", "word", "x.*")
    numbered = running_by_slice(
        rows, ["session_id", "category"], ["word"], sequence_slice("word", SEQUENCES_PER_SLICE // BITS),
        sums={"_s": F.bit_count("starts").cast("long"), "_e": F.bit_count("ends").cast("long")})

    def placed(mask: str, total: str) -> Column:
        found = numbers_of(F.col("word"), F.col(mask))
        return F.transform(found, lambda seq, i: F.struct((F.col(total) - F.size(found) + i).alias("n"), seq.alias("seq")))

    starts = numbered.select("session_id", "category", F.explode(placed("starts", "_s")).alias("p"), F.lit(True).alias("start"))
    ends = numbered.select("session_id", "category", F.explode(placed("ends", "_e")).alias("p"), F.lit(False).alias("start"))
    edges = starts.unionByName(ends).select("session_id", "category", "start", F.col("p.n").alias("n"), F.col("p.seq").alias("seq"))
    if gaps_of:
        between = edges.filter(F.col("category") == gaps_of).select(
            "session_id", F.lit(gaps_as).alias("category"), (~F.col("start")).alias("start"), (F.col("n") - F.when(F.col("start"), 1).otherwise(0)).alias("n"),
            (F.col("seq") + F.when(F.col("start"), -1).otherwise(1)).alias("seq"))
        edges = edges.filter(F.col("category").isin(*categories)).unionByName(between)
    paired = edges.groupBy("session_id", "category", "n").agg(
        F.max(F.when(F.col("start"), F.col("seq"))).alias("range_start"), F.max(F.when(~F.col("start"), F.col("seq"))).alias("range_end"))
    return paired.filter("range_start IS NOT NULL AND range_end IS NOT NULL").drop("n")
