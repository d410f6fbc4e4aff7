"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample.

Every rule reads the counts of a whole text and may reject it. A document meets the rules in order and leaves at the first
that rejects it. The order changes the work, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import duplicate_lines, pieces, repeated_words, texts

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Document:
    """One whole text (null: empty) and what the rules count in it."""

    def __init__(self, text: bytes):
        words = text.split()
        self.text, self.words, self.n_words = text, words, len(words)
        blanks = len(text) - sum(map(len, words))
        self.word_chars = len(text.decode("utf-8", "replace")) - blanks
        self.n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        self.n_lines, self.n_dup_lines = duplicate_lines(text)
        self.n_repeat_words = repeated_words(words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` decides on one document; ``sql`` states the same over the counts, for the reader and for checks."""

    name: str
    rejects: Callable[[Document], bool]
    sql: str


def _letters(doc: Document, letters: bytes) -> int:
    return len(doc.text) - len(doc.text.translate(None, letters))


def _top_word(doc: Document) -> int:
    seen: dict[bytes, int] = {}
    for word in doc.words:
        seen[word] = seen.get(word, 0) + 1
    return max(seen.values(), default=0)


RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words, "10 * n_symbols > n_words"),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > d.n_lines, "2 * n_dup_lines > n_lines"),
    Rule("short_words", lambda d: d.word_chars < 2 * d.n_words, "word_chars < 2 * n_words"),
    Rule("long_words", lambda d: d.word_chars > 20 * d.n_words, "word_chars > 20 * n_words"),
    Rule("shouting", lambda d: _letters(d, UPPER) > _letters(d, LOWER), "n_upper > n_lower"),
    Rule("one_word", lambda d: 10 * _top_word(d) > 3 * d.n_words, "10 * top_word > 3 * n_words"),
)

SAMPLE_ROWS, SAMPLE_SEED = 1000, 7


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds per document and share rejected, by rule, on about ``rows`` documents, of those that pass the base rule.

    Rows are drawn with one chance from all of ``docs`` where they are read; a table of at most ``rows`` is its own sample, an
    empty one gives no figures. No text leaves its task: tasks add up their seconds, and one row per rule comes back.
    """
    count = docs.count()
    if not count:
        return {}
    drawn = docs.select("text").sample(min(1.0, rows / count), seed=SAMPLE_SEED) if count > rows else docs.select("text")
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("seen", pa.int64()), ("rejected", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            sample = [d for d in map(Document, texts(part)) if not d.base_failed]
            out = []
            for rule in rules:
                started = time.perf_counter()
                rejected = sum(map(rule.rejects, sample))
                out.append({"rule": rule.name, "seconds": time.perf_counter() - started, "seen": len(sample), "rejected": rejected})
            yield pa.RecordBatch.from_pylist(out, schema)

    found = (
        drawn.mapInArrow(run, "rule string, seconds double, seen long, rejected long")
        .groupBy("rule").agg(F.sum("seconds"), F.sum("seen"), F.sum("rejected")).collect()
    )
    return {r[0]: (r[1] / max(r[2], 1), r[3] / max(r[2], 1)) for r in found}


def ordered(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules that were not measured, or equal, stay in their order."""
    def gain(rule: Rule) -> float:
        cost, share = figures.get(rule.name, (1.0, 0.0))
        return share / max(cost, 1e-9)

    return tuple(sorted(rules, key=gain, reverse=True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words: all counts are 0, the base rule fails, the row is not kept. Rows are judged one by
    one, so repeated rows give repeated results and an empty table gives none. Columns of ``docs`` that carry the name of
    a result are replaced by it; all others stay. No text is shuffled.
    """
    rules = ordered(rules, measure(docs, rules, sample_rows))
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
             ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    results = {name for name, _ in kinds}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            counts: dict[str, list] = {name: [] for name, _ in kinds}
            for text in texts(part):
                doc = Document(text)
                for name, _ in kinds[:5]:
                    counts[name].append(getattr(doc, name))
                failed = doc.base_failed
                counts["base_failed"].append(failed)
                counts["kept"].append(not failed and not any(rule.rejects(doc) for rule in rules))
            columns = [*part.columns, *(pa.array(counts[name], kind) for name, kind in kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *results_in_order])

    results_in_order = [name for name, _ in kinds]
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(COUNTS).fields + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(judge, schema)
