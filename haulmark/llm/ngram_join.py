"""N-gram Jaccard join: linked documents by a blocked sparse matrix product of documents by n-grams.

The product of the incidence matrix with its transpose counts the n-grams any two documents share. Only those blocks of it
are computed that can hold a link:

1. Documents with one set of n-grams are one row of the matrix.
2. Rows sort their n-grams by frequency, rare ones first, as estimated by a sketch of fixed size over all documents. Two
   rows of ``n`` and ``m`` n-grams can only link if they share ``k`` among the first ``n - ceil(t * n) + k``; rows that share
   fewer of these with the others than the bound of their size are out.
3. Rows that share one of the n-grams left form blocks. Large groups are cut by size into bands (sizes of linked rows differ
   by the threshold at most) and dealt into tiles, and pairs of tiles are multiplied; pairs below the bounds of their sizes
   are discarded, the others are exact overlap counts.

A block returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import components, materialize, pieces, texts

#: Cells of the frequency sketch and bits of the filter of rows that are in blocks, as powers of two. A task counts a cell up
#: to 255 (one byte), the sum up to 65535 (two bytes): frequent n-grams stay last, which is all that the order needs.
SKETCH_BITS, FILTER_BITS, PART = 23, 23, 16384
#: Most rows and n-grams of a tile.
TILE_ROWS, TILE_GRAMS = 512, 1_000_000


class Grams:
    """Distinct word n-grams of whole texts as sorted 64-bit hashes. A text with fewer words is one n-gram, one without
    words has none."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.digest = n, xxhash.xxh3_64_intdigest

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.digest, words), np.uint64, len(words))
        n = min(self.n, len(words))
        count = len(words) - n + 1
        mixed = np.full(count, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ hashes[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


class Bounds:
    """What a row of ``n`` n-grams needs for a Jaccard similarity of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def missing(self, n: int) -> int:
        """Most n-grams that a linked row may lack."""
        return n + (-self.num * n) // self.den

    def shared(self, n: int) -> int:
        """``k`` of a row: how many of its first n-grams a linked row must share."""
        return self.missing(n) // 2 + 1

    def prefix(self, n: int) -> int:
        return self.missing(n) + self.shared(n)

    def least(self, n: int) -> int:
        """Least shared ones seen from a row, whichever of the two prefixes ends first: ``k`` of the smallest partner."""
        return self.shared(-(-self.num * n) // self.den)

    def band(self, n: int) -> int:
        """Sizes of linked rows lie in one band or in neighbours."""
        return math.floor(math.log(n) / (math.log(self.den / self.num) * (1 + 1e-9)))


def _set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _key(sid: bytes) -> int:
    """Half of a set's identity, enough to find candidates by: two sets under one key are compared, not confused."""
    return int.from_bytes(sid[:7], "big")


def _key_of(sid: Column) -> Column:
    return F.conv(F.hex(F.substring(sid, 1, 7)), 16, 10).cast("long")


def _merged(spark: SparkSession, parts: DataFrame, bits: bool) -> np.ndarray:
    """Sum (saturating) or union of the sketches of tasks, cut into parts: 16 MiB of cells or 1 MiB of bits at the driver."""
    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for row in rows:
            for part, cells in zip(row.column("part").to_pylist(), row.column("cells").to_pylist()):
                new = np.frombuffer(cells, np.uint8)
                new = new if bits else new.astype(np.uint32)
                if part in held:
                    held[part] = held[part] | new if bits else np.minimum(held[part] + new, 65535)
                else:
                    held[part] = new
        kind = np.uint8 if bits else np.uint16
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.astype(kind).tobytes() for c in held.values()], pa.binary())], ["part", "cells"])

    found = {r.part: r.cells for r in parts.select("part", "cells").repartition("part").mapInArrow(fold, "part int, cells binary").collect()}
    if not found:
        return np.zeros(1 << (FILTER_BITS - 3 if bits else SKETCH_BITS), np.uint8 if bits else np.uint16)
    return np.concatenate([np.frombuffer(found[k], np.uint8 if bits else np.uint16) for k in sorted(found)])


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """Per row of ``docs`` its number of n-grams and set; and per task the parts of its frequency sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, cells = Grams(n), np.zeros(1 << SKETCH_BITS, np.uint32)
        key_type = None
        for batch in pieces(batches):
            key_type = batch.column("doc_id").type
            sizes, sets = [], []
            for text in texts(batch):
                grams = grams_of(text)
                np.add.at(cells, grams >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
                sizes.append(len(grams))
                sets.append(_set_id(grams) if len(grams) else None)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                ["doc_id", "n_shingles", "sid", "part", "cells"])
        if key_type is not None:
            small = np.minimum(cells, 255).astype(np.uint8).reshape(-1, PART)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(small), key_type), pa.nulls(len(small), pa.int64()), pa.nulls(len(small), pa.binary()),
                 pa.array(range(len(small)), pa.int32()), pa.array([p.tobytes() for p in small], pa.binary())],
                ["doc_id", "n_shingles", "sid", "part", "cells"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, sid binary, part int, cells binary")


def _prefixes(docs: DataFrame, n: int, bounds: Bounds, sketch) -> DataFrame:
    """Entries ``gram``, ``key``, ``least``: the first n-grams, rare ones first, of each set that a task meets."""
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("least", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, seen, cells = Grams(n), set(), sketch.value
        for batch in pieces(batches):
            keys, least, firsts = [], [], [np.zeros(0, np.int64)]
            for text in texts(batch):
                grams = grams_of(text)
                key = _key(_set_id(grams))
                if len(grams) and key not in seen:
                    seen.add(key)
                    often = cells[grams >> np.uint64(64 - SKETCH_BITS)]
                    keys.append(key)
                    least.append(bounds.least(len(grams)))
                    firsts.append(grams[np.argsort(often, kind="stable")[:bounds.prefix(len(grams))]].view(np.int64))
            sizes = [len(f) for f in firsts[1:]]
            columns = (np.concatenate(firsts), np.repeat(np.array(keys, np.int64), sizes), np.repeat(np.array(least, np.int32), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.mapInArrow(run, "gram long, key long, least int")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries whose n-gram stands in two sets or more, each once, with ``head``, the first of these sets.

    Runs of one n-gram stream through a task; of a run only its last entry and its first set are held.
    """
    names = ["gram", "key", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, joined = None, 0, False  # the last entry so far, the first set of its run, and whether it is another
        for batch in batches:
            g, k, least = (batch.column(c).to_numpy() for c in names)
            if last is not None:
                g, k, least = (np.append(x, y) for x, y in zip(last, (g, k, least)))
            if not len(g):
                continue
            fresh = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))  # copies of a set that other tasks met
            g, k, least = g[fresh], k[fresh], least[fresh]
            starts = np.append(True, g[1:] != g[:-1])
            heads = k[np.maximum.accumulate(np.where(starts, np.arange(len(g)), 0))]
            before = ~starts
            if last is not None:
                heads[g == g[0]] = head
                before[0] = joined
            keep = before[:-1] | ~starts[1:]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (g, k, least, heads)], [*names, "head"])
            last, head, joined = (g[-1:], k[-1:], least[-1:]), heads[-1], bool(before[-1])
        if last is not None and joined:
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in last), pa.array([head])], [*names, "head"])

    ordered = entries.select(names).repartition("gram").sortWithinPartitions("gram", "key")
    return ordered.mapInArrow(run, "gram long, key long, least int, head long")


def _survivors(shared: DataFrame) -> DataFrame:
    """Entries of the sets that share enough of their first n-grams with others; a set has no more entries than that."""
    own = Window.partitionBy("key")
    return shared.withColumn("times", F.count("*").over(own)).filter(F.col("times") >= F.col("least")).drop("times")


def _tiles(members: DataFrame, bounds: Bounds) -> DataFrame:
    """``node``, ``n``, ``root`` -> the blocks it takes part in: ``tile``, and its ``side`` in it (0, 1, or 2 for both)."""
    width = math.log(bounds.den / bounds.num) * (1 + 1e-9)
    sizes = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    small = (F.col("rows") <= 2 * TILE_ROWS) & (F.col("grams") <= 2 * TILE_GRAMS)
    members = members.join(sizes.select("root", small.alias("small")), "root")
    alone = members.filter("small").select("node", F.concat_ws("/", "root").alias("tile"), F.lit(2).alias("side"))

    banded = members.filter("NOT small").withColumn("band", F.floor(F.log("n") / width).cast("long"))
    parts = banded.groupBy("root", "band").agg(
        F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_GRAMS)).cast("long").alias("parts"))
    near = parts.select("root", "band", "parts").join(
        parts.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")), ["root", "band"], "left").join(
        parts.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("below")), ["root", "band"], "left")
    dealt = banded.join(near, ["root", "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), "parts"))

    def each(count: str):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).otherwise(F.array().cast("array<long>"))

    def name(low_band, low, high_band, high):
        return F.concat_ws("/", "root", low_band, low, high_band, high)

    own, above, below = (dealt.select("node", "root", "band", "salt", F.explode(each(c)).alias("other")) for c in ("parts", "above", "below"))
    side = F.when(F.col("salt") == F.col("other"), 2).when(F.col("salt") < F.col("other"), 0).otherwise(1)
    own = own.select("node", name("band", F.least("salt", "other"), "band", F.greatest("salt", "other")).alias("tile"), side.alias("side"))
    above = above.select("node", name("band", "salt", F.col("band") + 1, "other").alias("tile"), F.lit(0).alias("side"))
    below = below.select("node", name(F.col("band") - 1, "other", "band", "salt").alias("tile"), F.lit(1).alias("side"))
    return alone.union(own).union(above).union(below)


def product_links(sets: list[np.ndarray], sides: np.ndarray, bounds: Bounds, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows of one block.

    Rows of side 0 meet those of side 1, rows of side 2 each other. Columns that only one row has count nothing; the
    others are multiplied a strip at a time, and the strips' products add up to the overlap counts.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    allowed = bounds.num * np.maximum.outer(sizes, sizes) <= bounds.den * np.minimum.outer(sizes, sizes)
    allowed &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
    allowed = np.triu(allowed, 1)
    if not allowed.any():
        return []
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        strip = np.zeros((len(sets), columns), np.float32)
        strip[row[a:b], column[a:b] - first] = 1
        overlap += strip @ strip.T
    common = overlap.astype(np.int64)
    linked = allowed & (bounds.den * common >= bounds.num * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    above = list(range(len(sets)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    forest = []
    for i, j in np.argwhere(linked).tolist():
        a, b = top(i), top(j)
        if a != b:
            above[max(a, b)] = min(a, b)
            forest.append((i, j))
    return forest


def _sets(docs: DataFrame, n: int, chosen) -> DataFrame:
    """Whole sets that pass the filter of rows in blocks."""
    mask = np.uint32((1 << FILTER_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, seen, bits = Grams(n), set(), chosen.value
        for batch in pieces(batches):
            sets, whole = [], []
            for text in texts(batch):
                grams = grams_of(text)
                sid = _set_id(grams)
                at = np.frombuffer(sid, np.uint32)[:2] & mask
                if len(grams) and sid not in seen and (bits[at >> 3] >> (at & 7) & 1).all():
                    seen.add(sid)
                    sets.append(sid)
                    whole.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(whole, pa.binary())], ["sid", "grams"])

    return docs.mapInArrow(run, "sid binary, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))


def _filter_parts(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for sid in batch.column("sid").to_pylist():
                bits[np.frombuffer(sid, np.uint32)[:2] & np.uint32((1 << FILTER_BITS) - 1)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], ["part", "cells"])

    return members.select("sid").mapInArrow(run, "part int, cells binary")


def _links(docs: DataFrame, nodes: DataFrame, sketch, n: int, bounds: Bounds) -> DataFrame:
    """Edges ``a``, ``b`` between the nodes that link, enough to connect all that are connected."""
    spark = docs.sparkSession
    shared = _shared(_survivors(_shared(_prefixes(docs, n, bounds, sketch))))
    near = materialize(_survivors(shared).select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "ngram-near")
    blocks = components(near, "ngram-blocks").withColumnRenamed("node", "key")
    members = materialize(blocks.join(nodes.select("key", "node", "n", "sid"), "key"), "ngram-members")
    chosen = spark.sparkContext.broadcast(_merged(spark, _filter_parts(members), bits=True))
    tiles = materialize(_tiles(members.select("node", "n", "root"), bounds).join(members.select("node", "sid"), "node"), "ngram-tiles")

    def multiply(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        node = block["node"].to_numpy()
        found = product_links([np.frombuffer(g, np.uint64) for g in block["grams"]], block["side"].to_numpy(), bounds)
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    return tiles.join(_sets(docs, n, chosen), "sid").groupBy("tile").applyInPandas(multiply, "a long, b long")


def _grouped(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``n_shingles``, ``sid``: the set, null without words) and sets (``sid``, ``first``: the smallest key of
    its rows, ``root``: its group)."""
    spark, bounds = docs.sparkSession, Bounds(num, den)
    docs = docs.select("doc_id", "text")
    summed = materialize(_summaries(docs, n), "ngram-sets")
    rows = summed.filter("part IS NULL").select("doc_id", "n_shingles", "sid")
    nodes = materialize(
        rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("first"))
        .withColumns({"node": F.monotonically_increasing_id(), "key": _key_of(F.col("sid"))}), "ngram-nodes")
    sketch = spark.sparkContext.broadcast(_merged(spark, summed.filter("part IS NOT NULL"), bits=False))
    roots = components(_links(docs, nodes, sketch, n, bounds), "ngram-links")
    grouped = nodes.join(roots, "node", "left").select("sid", "first", F.coalesce("root", "node").alias("root"))
    return rows, materialize(grouped, "ngram-groups")


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Two rows link when ``den`` times their common word n-grams are at least ``num`` times the union; ``component_id`` is the
    smallest ``doc_id`` reachable by links. Letters A-Z count as lower case. A text with fewer than ``n`` words is one
    n-gram; null texts and texts without words have none and link with nothing. Repeated rows link with each other. Null
    keys are not a smallest id; a group that has only these has a null component. An empty table gives no rows. Other
    columns are not read. N-grams are compared by 64-bit hashes, sets by 128-bit hashes.
    """
    rows, grouped = _grouped(docs, n, num, den)
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = grouped.select("sid", "root").join(least, "root").select("sid", "component_id")
    linked = rows.filter("sid IS NOT NULL").join(known, "sid").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def set_decisions(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id``, ``sid``, ``stays`` of every row of ``docs``: whether its key and set of n-grams are those its group keeps.

    A group keeps the smallest key, null last, and of the sets under that key the smallest. Rows without words have no set
    and stay. Groups are those of ``ngram_join``.
    """
    rows, grouped = _grouped(docs, n, num, den)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("unknown"), "first", "sid")).alias("best"))
    kept = best.select(F.col("best.sid").alias("sid"), F.col("best.first").alias("first"), F.lit(True).alias("kept"))
    decided = rows.filter("sid IS NOT NULL").join(kept, "sid", "left").select(
        "doc_id", "sid", (F.coalesce("kept", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("first"))).alias("stays"))
    return decided.unionByName(rows.filter("sid IS NULL").select("doc_id", "sid", F.lit(True).alias("stays")))


def with_set(docs: DataFrame, n: int, name: str = "sid") -> DataFrame:
    """Each row of ``docs`` (with ``text``) and, as ``name``, its set of n-grams; null without words."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(n)
        for part in pieces(parts):
            sets = [_set_id(grams) if len(grams) else None for grams in map(grams_of, texts(part))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))
