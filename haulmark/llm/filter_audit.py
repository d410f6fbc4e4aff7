"""What each filter of a set removes, alone, in every order, and on average over the orders.

The removal game: a coalition of filters is worth the documents that fail at least one of them. With five filters there
are 32 coalitions, and everything asked for follows from their worths. Hart and Mas-Colell's potential is built
recursively, ``P(S) = (v(S) + sum of P(S without i)) / |S|``; the Shapley value of a filter is the grand potential minus the
potential without it, and what a step of an order removes is the difference of two coalitions.

Documents are read once. What leaves the tasks is a key, a digest and a bit mask; copies of a text fold before their
shuffle, and no count is ever made per order or per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import pieces, texts

_SIGN = re.compile(rb"[#$%&*|]")
_FACTS = "doc_id string, part string, mask int, digest binary"


def words_of(text: bytes, window: int = 1 << 20) -> tuple[int, int]:
    """Number of words, and of distinct ones; a long text is cut into windows, so that only distinct words are held."""
    if len(text) <= window:
        words = text.split()
        return len(words), len(set(words))
    count, seen, rest, at = 0, set(), [], 0
    while at < len(text):
        part = text[at:at + window]
        at += window
        words = part.split()
        if rest and at < len(text) and len(words) == 1 and len(words[0]) == len(part):
            rest.append(part)
            continue
        if rest and (part[:1].isspace() or not words):  # the word that the window before left open ends here
            words.insert(0, b"".join(rest))
            rest = []
        elif rest:
            words[0] = b"".join([*rest, words[0]])
            rest = []
        if words and at < len(text) and not part[-1:].isspace():
            rest = [words.pop()]
        count += len(words)
        seen.update(words)
    if rest:
        count += 1
        seen.add(b"".join(rest))
    return count, len(seen)


def failures(text: bytes) -> int:
    """Bits 0 to 3: fewer than 100 words; words repeat too much; too many capitals; a sign. Bit 4 needs the table."""
    count, distinct = words_of(text)
    codes = np.frombuffer(text, np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    points = int(((codes & 0xC0) != 0x80).sum())
    return (count < 100) | (100 * distinct < 80 * count) << 1 | (100 * capitals > 10 * points) << 2 | bool(_SIGN.search(text)) << 3


def _facts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(parts, 1 << 20):
        found = texts(part)
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("part"), pa.array([failures(t) for t in found], pa.int32()),
            pa.array([hashlib.sha256(t).digest() for t in found], pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` (the language, null as empty) and ``mask`` of the filters they fail: ``n``, ``good``, ``toxic``.

    ``docs`` has doc_id, text and lang, ``labels`` has doc_id, quality and toxic; other columns are ignored. A null text is
    empty. Each row is a document, repeated ones too. A text is a copy if the same text (by SHA-256) stands under a
    smaller doc_id anywhere; rows without doc_id are no copies, have none, and have no label. Of repeated labels one that
    says 1 is enough. Empty tables give no rows.

    A key or a text may hold a third of all rows: rows alike fold in their tasks, the join with the labels is one that
    adaptive execution can split, and rows without a key are spread by their digest.
    """
    key_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    facts = rows.mapInArrow(_facts, _FACTS.replace("doc_id string", f"doc_id {key_type}"))
    alike = facts.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    # Rows without a key match nothing; where they go is left to their digest.
    placed = alike.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    known = known.select(F.col("doc_id").alias("label_id"), F.lit(0).cast("long").alias("label_spread"), "is_good", "is_toxic")
    both = placed.join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left")
    both = both.select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")])
    # Of a text, only the rows under its smallest key are no copies: one row of each class says how many those are.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    classes = both.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), first.alias("first"))
    # Four rows at most of a text and language, however many copies it has.
    whole = classes.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.col("named") - originals
    split = whole.select("part", "is_good", "is_toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), copies.alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def _worths(column: str, size: int) -> Column:
    """Worth of every coalition 0, 1, ...: the documents whose mask shares a filter with it."""
    return F.transform(F.sequence(F.lit(0), F.lit(2**size - 1)), lambda s: F.aggregate(
        F.col("masks"), F.lit(0).cast("long"),
        lambda total, m: total + F.when(m["mask"].bitwiseAND(s) != 0, m[column]).otherwise(F.lit(0).cast("long"))))


def potentials(worths: Column, size: int) -> Column:
    """Potentials of all coalitions, times the least common multiple of 1 to ``size``, which makes them whole numbers.

    Coalitions are taken in numeric order, in which all subsets of one come before it.
    """
    scale = lcm(*range(1, size + 1))
    smaller = lambda acc, s: sum((
        F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(acc, s.bitwiseXOR(F.lit(1 << i)))).otherwise(F.lit(0).cast("long"))
        for i in range(size)), start=F.lit(scale).cast("long") * F.get(worths, s))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(2**size - 1)), F.array(F.lit(0).cast("long")),
        lambda acc, s: F.concat(acc, F.array(F.call_function("div", smaller(acc, s), F.bit_count(s)))))


def interaction_audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Every order of the filters, step by step, for each part of ``counts`` (part, mask, n, good, toxic).

    Bit i of ``mask`` stands for the filter ``names[i]``. Columns: part, filter_order, step; kept and removed documents;
    redundant, those that fail the step's filter and are gone already; unique_fails, those that fail it only;
    good_lost and toxic_lost; shapley, its removals summed over all orders. Parts are rows of ``counts``, so one without documents
    does not occur, and an empty table gives no rows. Repeated rows of ``counts`` add up.
    """
    size = len(names)
    orders = ["".join(p) for p in permutations(names)]
    summed = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # At most 2**size masks of a part.
    parts = summed.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    valued = parts.select("part", "total", *[_worths(c, size).alias(c) for c in ("n", "good", "toxic")])
    valued = valued.withColumn("potential", potentials(F.col("n"), size))
    steps = valued.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substr("filter_order", at, F.lit(1))) - F.lit(1))
    before = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(size)), F.lit(1), F.col("step") - 1), F.lit(0), lambda mask, k: mask + bit(k))
    at = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))
    grand = 2**size - 1
    removed = lambda c: F.get(c, "after") - F.get(c, "before")
    scale = len(orders) // lcm(*range(1, size + 1))
    value = (F.get("potential", F.lit(grand)) - F.get("potential", F.lit(grand) - F.col("own"))) * scale
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.get("n", "after")).alias("kept"),
        removed("n").alias("removed"), (F.get("n", "own") - removed("n")).alias("redundant"),
        (F.get("n", F.lit(grand)) - F.get("n", F.lit(grand) - F.col("own"))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), value.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of :func:`failure_counts` in all 120 orders; see there and in :func:`interaction_audit`."""
    return interaction_audit(failure_counts(docs, labels))
