"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles, trees are grown by the gain of gradient histograms, and the model is
kept as flat arrays, through which a batch of documents walks all trees at once, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import duplicate_lines, held_out, labelled, pieces, repeated_words, texts

#: Most labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000

STATISTICS = (
    "log_words", "mean_word", "longest_word", "symbols_per_word", "pipes_per_word", "exclamations_per_word", "upper_share",
    "digit_share", "beyond_ascii", "stops_per_word", "commas_per_word", "words_per_line", "repeated_lines", "repeated_windows",
    "distinct_share", "top_share", "same_as_before",
)


def statistics(text: bytes) -> list[float]:
    """The numbers of :data:`STATISTICS` for one whole text; an empty text has only zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    lines, copies = duplicate_lines(text)
    symbols = int(kinds[[35, 36, 37, 38, 42, 60, 62]].sum())
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.max()), symbols / n, int(kinds[124]) / n, int(kinds[33]) / n,
        upper / max(upper + lower, 1), int(kinds[48:58].sum()) / len(text), int(kinds[128:].sum()) / len(text),
        int(kinds[46]) / n, int(kinds[44]) / n, n / max(lines, 1), copies / max(lines, 1), repeated_words(words) / n,
        len(seen) / n, int(np.bincount(ids).max()) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
    ]


@dataclass
class Trees:
    """Complete binary trees in heap order: node ``k`` has the children ``2k + 1`` and ``2k + 2``."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        bins = np.column_stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(self.edges)])
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(rows), len(self.feature)), np.int64)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[at, self.feature[trees, node]] > self.cut[trees, node])
        margin = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(
    rows: np.ndarray, labels: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Boost ``rounds`` trees on the logistic loss. Without rows, or with one label only, the score is constant."""
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, bins)[1:-1])) if len(rows) else np.zeros(0) for k in range(width)]
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not len(rows) or labels.min() == labels.max():
        rounds = 0
    feature, cut = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), bins, np.int64)
    leaf = np.zeros((rounds, inner + 1))
    binned = np.column_stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(edges)]) if rounds else rows
    margin = np.full(len(rows), start)
    offset = np.arange(width) * bins
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * width * bins + offset + binned).ravel()
            shape = (count, width, bins)
            g = np.bincount(cell, np.repeat(grad, width), count * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, width), count * width * bins).reshape(shape).cumsum(axis=2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < least) | (total_h - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[t, first:first + count] = np.where(split, best // bins, 0)
            cut[t, first:first + count] = np.where(split, best % bins, bins)  # nothing lies beyond the last bin
            node = 2 * node + 1 + (binned[np.arange(len(rows)), feature[t, node]] > cut[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, at]
    return Trees(edges, feature, cut, leaf, start, depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``most`` labelled rows that are not held out. Their statistics, a few hundred bytes a row, are all
    that comes to the driver."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("stats", pa.list_(pa.float64()))])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            stats = pa.array([statistics(t) for t in texts(part)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), stats], schema=schema)

    # Keys only put the rows in one order; those that are no whole numbers do so by their hash.
    key = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id")
    chosen = labelled(docs, labels, label, most).withColumn("doc_id", key).mapInArrow(measure, "doc_id long, label int, stats array<double>").collect()
    chosen.sort(key=lambda r: (r.doc_id, r.label, r.stats))  # the same trees whatever order the rows arrive in
    rows = np.array([r.stats for r in chosen]).reshape(-1, len(STATISTICS))
    return fit(rows, np.array([r.label for r in chosen], float))


def quality_classifier(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """Each row of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from at most ``most`` labelled rows, never from held-out ones. Null and empty texts have zero statistics and get
    the score the trees give those. Without learnable rows every score is 0.5. Rows are scored one by one: repeated rows
    get equal scores, an empty table gives none, null keys count as not held out. Columns that carry the name of a result
    are replaced, all others stay. Scoring does not shuffle.
    """
    model = train(docs, labels, "quality", most)
    results = {"held_out", "score", "predicted"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            found = model.score(np.array([statistics(t) for t in texts(part)]).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema).withColumns({
        "held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
