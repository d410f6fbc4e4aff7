"""Helpers of the operators: scratch tables, words of a text, learnable rows, connected groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.session import scratch_path

#: Words are runs of anything but these ASCII blanks, which are those that ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(parts: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of whole rows of about ``most`` bytes of text, so that a task holds little at a time."""
    for part in parts:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(part.column("text")), 0), np.int64))
        at = 0
        while at < part.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield part.slice(at, to - at)
            at = to


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn labels from; rows without a key are none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first occurrences included; exact."""
    count = len(words)
    if count <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, count)
    size = len(numbers)
    if size == count:
        return 0
    places = count - window + 1
    key = ids[:places].copy()
    top = size
    for k in range(1, window):
        if top > 2**62 // size:  # dense numbers keep the next product within 63 bits
            key = np.unique(key, return_inverse=True)[1]
            top = int(key.max()) + 1
        key = key * size + ids[k:places + k]
        top *= size
    order = np.sort(key)
    double = order[1:][order[1:] == order[:-1]]
    if not double.size:
        return 0
    starts = np.flatnonzero(np.isin(key, double))
    marks = np.zeros(count + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks)[:count] > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` learnable rows: every column of ``docs`` named in it, and ``label`` as 0 or 1.

    Held-out documents never take part. Repeated labels of a document count by their mean; null labels and keys are left
    out. The sample is the keys with the smallest hash, so it is the same in each run; they, at most ``most`` numbers, are
    broadcast. A key that repeats in ``docs`` gives one row, of the text with the smallest hash: only texts of the sample
    are shuffled, after each task has folded its own.
    """
    keys = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = docs.select("doc_id", "text")
    folded = chosen.join(F.broadcast(keys), "doc_id").groupBy("doc_id", "__label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("__least"))
    return folded.select("doc_id", F.col("__least.text").alias("text"), F.col("__label").alias("label"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected groups of an edge list ``a``, ``b`` (long): ``node`` and ``root``, the smallest node of its group.

    Large-star and small-star steps: each round points every neighbour at the smallest one near it, by a minimum (partial
    before its shuffle) and a join back, so that no neighbour list is ever gathered. Rounds grow with the logarithm of
    the number of nodes; each ends in a written table. Without edges there are no rows.
    """
    def star(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v): each v of u moves to the smallest of u and its v."""
        least = pairs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        least = least.select("c", F.least("c", "m").alias("m"))
        return pairs.join(least, pairs.u == least.c).select("u", "v", "m")

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a <> b").distinct(), f"{label}-edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        moved = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        now = materialize(moved.filter("a <> b").distinct(), f"{label}-stars")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b")).distinct()


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Pack dictionaries into record batches of bounded size."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
