"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text and normalised by length.

Folding replaces each character by one character, so places in the folded text are places in the text: homoglyphs of other
scripts and full-width forms become Latin letters, digits and signs written for letters become those letters. Terms and
weights are learned from labelled documents; exception phrases cancel the matches that lie inside them.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import held_out, labelled, materialize, pieces, texts

#: Most labelled rows that terms are learned from.
TRAIN_ROWS = 20_000
#: Evidence a term needs: documents times the divergence of its share of toxic ones from the share overall; and how many
#: families of toxic texts have to show it, half of them in either half of the sample.
EVIDENCE, FAMILIES = 14.0, 4
#: Letters that a beginning of words needs, the share of the letters of every word behind it, and of the longest such word.
STEM, STEM_SHARE, LONGEST = 5, 0.6, 32
SEEN = pa.schema([("term", pa.string()), ("follows", pa.string()), ("family", pa.int64())])
CLEAN = pa.schema([("term", pa.string()), ("half", pa.int32()), ("n", pa.int64())])

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = {
    "a": "аα@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3€", "g": "ɡ", "h": "һ", "i": "іιıl1|!ӏ", "j": "ј", "k": "кκ", "m": "м",
    "n": "ո", "o": "оοօ0", "p": "рρ", "q": "ԛ", "s": "ѕ$5", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "sore loser")


def _table() -> dict[int, str]:
    table = {ord(sign): letter for letter, signs in HOMOGLYPHS.items() for sign in signs}
    for code in range(0xFF01, 0xFF5F):  # full-width forms of ASCII
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = table.get(ord(plain), plain)
    return table


class Folder:
    def __init__(self) -> None:
        self.table = _table()

    def __call__(self, text: str) -> str:
        return self.lower(text).translate(self.table)

    @staticmethod
    def lower(text: str) -> str:
        return text.replace("İ", "i").lower()


def words_of(text: str, fold: Folder) -> list[str]:
    """Folded words without the signs around them; words without a letter fold to nothing."""
    out = []
    for word in fold.lower(text).split():
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        word = word[start:end]
        if word and not word.isdigit():
            out.append(word.translate(fold.table))
    return out


@dataclass
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the logistic curve of the normalised weight."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 1.0
    start: float = 0.0
    machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def _automaton(self):
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.machine.add_word(phrase, (len(phrase), None, None))
            for term in {t.rstrip("*") for t in self.weights} - set(self.exceptions):
                self.machine.add_word(term, (len(term), self.weights.get(term), self.weights.get(term + "*")))
            if len(self.machine):
                self.machine.make_automaton()
        return self.machine

    def matches(self, text: str, fold: Folder) -> list[tuple[int, int, float]]:
        """Start, end and weight of the terms of a text outside exception phrases: whole words, or beginnings of words.
        Of the terms that start at one place the heaviest counts.

        Signs written for letters may begin or end a term (``$tupid``); a boundary is a place where the character outside
        is no letter or digit of the original text.
        """
        machine = self._automaton()
        if not len(machine):
            return []
        plain = fold.lower(text)
        found: dict[int, tuple[int, int, float]] = {}
        spared = []
        for last, (size, whole, stem) in machine.iter(plain.translate(fold.table)):
            first, end = last - size + 1, last + 1
            if first and plain[first - 1].isalnum():
                continue
            goes_on = end < len(plain) and plain[end].isalnum()
            if whole is None and stem is None:
                if not goes_on:
                    spared.append((first, end))
                continue
            weight = stem if goes_on else whole
            if weight is not None and weight > found.get(first, (0, 0, 0.0))[2]:
                found[first] = (first, end, weight)
        if not spared:
            return list(found.values())
        # In order of their starts: a match is spared if a phrase that starts no later ends no earlier.
        spared.sort()
        kept, at, reach = [], 0, 0
        for match in sorted(found.values()):
            while at < len(spared) and spared[at][0] <= match[0]:
                reach, at = max(reach, spared[at][1]), at + 1
            if match[1] > reach:
                kept.append(match)
        return kept

    def normalised(self, text: str, fold: Folder) -> float:
        """Summed weight over the logarithm of the words: one insult outweighs less in a long text, but never vanishes."""
        total = sum(weight for _, _, weight in self.matches(text, fold))
        return total / math.log2(16 + len(text.split())) if total else 0.0

    def score(self, value: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.start + self.slope * value))))


def calibrated(values: np.ndarray, labels: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and start of a logistic curve with a small ridge, so that separable labels give a finite one."""
    if not len(labels) or labels.min() == labels.max():
        return 2.0, -2.0
    x = np.column_stack([values, np.ones(len(values))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * ridge
        step = np.linalg.solve(hess, x.T @ (labels - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.1)), float(beta[1])


def _sketch(words: list[str], size: int = 8) -> list[int]:
    """The smallest hashes of the word triples of a text: near copies share most of them."""
    grams = {hashlib.blake2b(" ".join(words[k:k + 3]).encode(), digest_size=8).digest() for k in range(max(1, len(words) - 2))}
    return [int.from_bytes(g, "big", signed=True) for g in sorted(grams)[:size]]


def _families(sketches: dict[int, list[int]], shared: int = 3) -> dict[int, int]:
    """Number texts so that near copies get one number: a text joins the family that owns most of its sketch, if that is
    ``shared`` hashes or (for shorter sketches) all. One pass over a bounded sample."""
    owner: dict[int, int] = {}
    family: dict[int, int] = {}
    for key in sorted(sketches):
        votes: dict[int, int] = {}
        for g in sketches[key]:
            if g in owner:
                votes[owner[g]] = votes.get(owner[g], 0) + 1
        best = max(votes, key=lambda f: (votes[f], -f), default=None)
        family[key] = best if best is not None and votes[best] >= min(shared, len(sketches[key])) else key
        for g in sketches[key]:
            owner.setdefault(g, family[key])
    return family


def _terms(words: list[str]) -> set[tuple[str, str]]:
    """Words, and as ``abcde*`` the beginnings that hold most of a word's letters, each with the letter that follows."""
    found = {(w, "") for w in words}
    for w in {w for w in words if len(w) <= LONGEST}:
        found.update((w[:k] + "*", w[k:k + 1]) for k in range(max(STEM, math.ceil(STEM_SHARE * len(w))), len(w) + 1))
    return found


def _matched(words: list[str]) -> set[str]:
    """All terms that would match in a text of these words, however little of a word they hold."""
    words = set(words)
    return words | {w[:k] + "*" for w in words for k in range(STEM, min(len(w), LONGEST) + 1)}


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Terms whose documents are toxic far more often than chance, and the curve of their normalised weight.

    A term is a word or the beginning of words. A beginning stands for the forms of one word: at least two different words
    go on from it in different ways (one may end there), and it holds at least ``STEM`` letters and ``STEM_SHARE`` of each; every clean
    text with a word that merely begins so counts against it. Near copies of a toxic text count once, so that a text which
    is copied often teaches nothing about its other words, and a term has to show in both halves of the sample. All tables
    here are bounded by the sample of ``most`` documents. Keys may be of any type.
    """
    fold = Folder()
    rows = materialize(labelled(docs, labels, "toxic", most), "toxicity-sample")
    toxic, clean = rows.filter("label = 1"), rows.filter("label = 0")

    def words(text: bytes) -> list[str]:
        return words_of(text.decode("utf-8", "replace"), fold)

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            found = [_sketch(words(t)) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    toxic = toxic.withColumn("doc_id", F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id"))
    family = _families({r.doc_id: r.sketch for r in toxic.mapInArrow(sketch, "doc_id long, sketch array<long>").collect()})

    def in_toxic(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            out = {(*term, family[key]) for key, t in zip(part.column("doc_id").to_pylist(), texts(part)) for term in _terms(words(t))}
            yield pa.RecordBatch.from_pylist([{"term": term, "follows": follows, "family": number} for term, follows, number in out], SEEN)

    half = F.pmod(F.xxhash64("family"), F.lit(2))
    shown = toxic.mapInArrow(in_toxic, "term string, follows string, family long").groupBy("term").agg(
        F.count_distinct("family").alias("a"), F.count_distinct(F.when(half == 0, F.col("family"))).alias("first"), F.count_distinct("follows").alias("ways"),
        F.bool_or(F.col("follows") == "").alias("ends"))
    often = (F.col("first") >= FAMILIES // 2) & (F.col("a") - F.col("first") >= FAMILIES // 2)
    counted = shown.filter(often & (~F.col("term").endswith("*") | (F.col("ways") > 1))).collect()
    a = {r.term: (r["first"], r.a - r["first"]) for r in counted}

    def in_clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for part in pieces(parts):
            for t in texts(part):
                side = zlib.crc32(t) & 1
                for term in _matched(words(t)) & a.keys():
                    seen[term, side] = seen.get((term, side), 0) + 1
        yield pa.RecordBatch.from_pylist([{"term": term, "half": side, "n": n} for (term, side), n in seen.items()], CLEAN)

    b = {t: [0, 0] for t in a}
    for r in clean.mapInArrow(in_clean, "term string, half int, n long").groupBy("term", "half").agg(F.sum("n").alias("n")).collect():
        b[r.term][r.half] = r.n
    families, n_clean = len(set(family.values())), clean.count()
    base = min(max(families / max(families + n_clean, 1), 1e-6), 1 - 1e-6)

    def evidence(term: str) -> float:
        n = sum(a[term]) + sum(b[term])
        p = sum(a[term]) / n
        if min(x / (x + y) for x, y in zip(a[term], b[term])) < (0.9 if term.endswith("*") else 0.5):
            return 0.0
        return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))

    odds = base / (1 - base)
    weights = {t: math.log((sum(a[t]) + 0.5) / (sum(b[t]) + 0.5) / odds) for t in sorted(a) if evidence(t) >= EVIDENCE}
    # A word that is itself a form of such a beginning is too rare alone, but has the evidence of all forms.
    weights |= {r.term[:-1]: weights[r.term] for r in counted if r.ends and r.term.endswith("*") and r.term in weights and r.term[:-1] not in weights}
    lexicon = Lexicon(weights, tuple(fold(p) for p in exceptions))

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            values = [lexicon.normalised(t.decode("utf-8", "replace"), fold) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), part.column("label").cast(pa.int32())], ["value", "label"])

    points = sorted(map(tuple, rows.mapInArrow(measure, "value double, label int").collect()))
    lexicon.slope, lexicon.start = calibrated(np.array([p[0] for p in points]), np.array([p[1] for p in points], float))
    return lexicon


def toxicity(
    docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = 0.7, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> DataFrame:
    """Each row of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from at most ``most`` labelled rows, never from held-out ones. Null and empty texts match nothing and get the
    score of a text without matches. Without learnable rows there are no terms and all scores are equal. Rows are scored
    one by one: repeated rows get equal scores, an empty table gives none, null keys count as not held out. Columns that
    carry the name of a result are replaced, all others stay. Scoring does not shuffle.
    """
    lexicon = learn(docs, labels, most, exceptions)
    fold = Folder()
    results = {"held_out", "score", "predicted"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            found = [lexicon.score(lexicon.normalised(t.decode("utf-8", "replace"), fold)) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema).withColumns({
        "held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
