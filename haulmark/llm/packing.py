"""Packing of tokenised documents into training sequences: vector bin packing with the dot-product heuristic.

Every task packs what it reads; nothing is shuffled, and a lost task is packed again from the same input. A sequence is
filled from a window of waiting documents: of those that fit within what is left of all limits (tokens, segments, tokens
that bear loss), the one whose demand has the largest dot product with it. When none fits, a document is cut to fill the
rest. What a task has left at the end becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE, SEGMENTS, END_ID = 2048, 128, 1
#: Waiting documents a task chooses among, text bytes it tokenises at once, and bytes of words it remembers.
WINDOW, SLICE_BYTES, MEMORY_BYTES = 512, 3 << 19, 48 << 20
MARK = "<|"

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Tokenizers of this Python worker with the words they have met, by path; they outlive its tasks.
_HELD: dict[str, tuple] = {}


class WordMemory:
    """Ids of words met before, found by the 128-bit hash of the word.

    Words are numbered in the order they come. Their hashes are kept in two sorted tables, a large one and a recent one that is merged into
    it now and then; places and ids are arrays that grow by doubling. All of it is forgotten beyond ``most`` bytes.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tables = [empty, empty]
        self.count, self.used = 0, 0
        self.starts, self.lengths, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def bytes(self) -> int:
        return 36 * self.count + 4 * self.used

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes (rows of two), -1 for those not known."""
        number = np.full(len(keys), -1, np.int64)
        order = np.argsort(keys[:, 0])  # in order, neighbouring searches touch the same memory
        wanted = keys[order]
        for first, second, numbers in self.tables:
            if len(first):
                place = np.minimum(np.searchsorted(first, wanted[:, 0]), len(first) - 1)
                same = (first[place] == wanted[:, 0]) & (second[place] == wanted[:, 1])
                number[order[same]] = numbers[place[same]]
        return number

    @staticmethod
    def _merged(tables: list[tuple]) -> tuple:
        first, second, numbers = (np.concatenate(x) for x in zip(*tables))
        order = np.argsort(first, kind="stable")
        return first[order], second[order], numbers[order]

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.zeros(max(size, 2 * len(array)), array.dtype)
        grown[:len(array)] = array
        return grown

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Remember new words and their ids; their numbers."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, numbers = int(lengths.sum()), np.arange(self.count, self.count + len(ids))
        self.starts, self.lengths = self._room(self.starts, self.count + len(ids)), self._room(self.lengths, self.count + len(ids))
        self.ids = self._room(self.ids, self.used + total)
        self.starts[numbers], self.lengths[numbers] = self.used + np.cumsum(lengths) - lengths, lengths
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.count, self.used = self.count + len(ids), self.used + total
        self.tables[1] = self._merged([self.tables[1], (keys[:, 0], keys[:, 1], numbers)])
        if len(self.tables[1][0]) > max(65_536, len(self.tables[0][0]) // 4):
            self.tables = [self._merged(self.tables), tuple(x[:0] for x in self.tables[1])]
        return numbers


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across blanks: each distinct word is encoded once.

    Texts are cut at spaces and line ends, A-Z lower-cased (the tokenizer lower-cases too), and a full stop or comma between
    a letter and a blank set apart, as the tokenizer sets it apart. Texts that hold the mark of a special token go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if path not in _HELD:
            _HELD[path] = (tokenizers.Tokenizer.from_file(path), WordMemory(MEMORY_BYTES))
        self.tokenizer, self.memory = _HELD[path]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words in the memory, after encoding the new ones."""
        given = words.to_pylist()
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, given)), np.dtype(">u8")).astype(np.uint64).reshape(-1, 2)
        if self.memory.bytes() > self.memory.most:
            self.memory.clear()
        number = self.memory.find(keys)
        new = np.flatnonzero(number < 0)
        # A few at a time: what the tokenizer returns is large, and only the ids are kept.
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([given[i] for i in part], add_special_tokens=False)]
            number[part] = self.memory.add(keys[part], ids)
        return number

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty."""
        given = [t or "" for t in texts.to_pylist()]
        texts = pa.array(given, pa.string())  # without the offset of a slice, which ascii_lower gets wrong
        plain = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(plain, r"([a-z])([.,])( |$)", r"\1 \2\3"), " ")
        coded = split.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary)
        starts, lengths, flat = self.memory.starts, self.memory.lengths, self.memory.ids
        word = number[coded.indices.to_numpy()]
        long = lengths[word].astype(np.int64)
        ends = np.cumsum(long)
        ids = flat[np.repeat(starts[word] - (ends - long), long) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        for k, text in enumerate(given):
            if MARK in text:
                whole = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield np.array(whole, np.uint32)
            else:
                yield ids[bounds[k]:bounds[k + 1]]


@dataclass
class Piece:
    """A run of ids of one document. ``prompt`` ids at the document's start bear no loss, nor does the first of a piece."""

    doc: object
    ids: np.ndarray
    start: int
    doc_tokens: int
    prompt: int = 0

    def loss(self, length: int | None = None) -> int:
        end = self.start + (len(self.ids) if length is None else length)
        return max(0, end - max(self.prompt, self.start + 1))

    def cut(self, tokens: int, loss: int) -> tuple[Piece | None, Piece | None]:
        """The longest beginning within both limits, and the rest."""
        length = min(tokens, len(self.ids))
        length -= max(0, self.loss(length) - loss)
        if length <= 0:
            return None, self
        if length == len(self.ids):
            return self, None
        return (Piece(self.doc, self.ids[:length], self.start, self.doc_tokens, self.prompt),
                Piece(self.doc, self.ids[length:], self.start + length, self.doc_tokens, self.prompt))


class Packer:
    """Packs the documents of one task; finished sequences are lists of pieces."""

    def __init__(self, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW):
        self.limits = np.array([sequence, segments, sequence - 1 if loss is None else loss], float)
        if self.limits[1] < 1 or self.limits[2] < 1:
            raise ValueError("a sequence must hold a segment and a token that bears loss")
        self.window, self.waiting = window, []
        self.demand = np.zeros((window + 1, 3))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        rest: Piece | None = piece
        while rest is not None and (len(rest.ids) >= self.limits[0] or rest.loss() > self.limits[2]):
            first, rest = rest.cut(int(self.limits[0]), int(self.limits[2]))
            yield from self._close([first])
        if rest is not None:
            self._wait(rest)
            if len(self.waiting) > self.window:
                yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield from self._fill()

    def _wait(self, piece: Piece) -> None:
        self.demand[len(self.waiting)] = (len(piece.ids), 1, piece.loss())
        self.waiting.append(piece)

    def _take(self, k: int) -> Piece:
        piece, last = self.waiting[k], len(self.waiting) - 1
        self.waiting[k], self.demand[k] = self.waiting[last], self.demand[last]
        self.waiting.pop()
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        left, chosen = self.limits.copy(), []
        while self.waiting and left[0] > 0 and left[1] > 0:
            demand = self.demand[:len(self.waiting)]
            fits = (demand <= left).all(axis=1)
            if fits.any():
                k = int(np.where(fits, demand @ (left / self.limits**2), -1.0).argmax())
                piece, rest = self._take(k), None
            else:
                piece, rest = self._take(int(demand[:, 0].argmax())).cut(int(left[0]), int(left[2]))
            if rest is not None:
                self._wait(rest)
            if piece is None:
                break
            chosen.append(piece)
            left -= (len(piece.ids), 1, piece.loss())
        yield from self._close(chosen)

    def _close(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A full sequence as it is; a shorter one cut into powers of two, the largest first."""
        total = sum(len(p.ids) for p in pieces)
        if total == self.limits[0]:
            yield pieces
            return
        queue = list(reversed(pieces))
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            part = []
            while room:
                piece, rest = queue.pop().cut(room, int(self.limits[2]))
                part.append(piece)
                room -= len(piece.ids)
                if rest is not None:
                    queue.append(rest)
            yield part


def pack(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss: int | None = None, end_id: int = END_ID,
    prompt: str | None = None,
) -> DataFrame:
    """Pieces of all rows of ``docs`` (``doc_id``, ``text``): which ids of a document lie where in which sequence.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. ``prompt`` names a column with the
    number of ids at a document's start that bear no loss. Repeated rows and null keys are packed like any other; an empty
    table gives no rows. Other columns are not read. ``sequence_id`` joins the task's number and a count in the task.
    """
    docs = docs.select("doc_id", "text", *([prompt] if prompt else []))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordTokenizer(tokenizer), Packer(sequence, segments, loss)
        number = TaskContext.get().partitionId() << 33
        key_type = None
        keys: list = []
        rows: list[tuple[int, ...]] = []

        def note(done: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in done:
                offset = 0
                for p in pieces:
                    keys.append(p.doc)
                    rows.append((p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, offset))
                    offset += len(p.ids)
                number += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6))]
            keys.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

        for part in parts:
            key_type = part.column("doc_id").type
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(part.column("text")), 0)))
            at = 0
            while at < part.num_rows:  # whole texts, about SLICE_BYTES at a time
                before = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
                chunk = part.slice(at, to - at)
                at = to
                prompts = chunk.column(prompt).to_pylist() if prompt else [0] * chunk.num_rows
                for doc, ids, skip in zip(chunk.column("doc_id").to_pylist(), encode(chunk.column("text")), prompts):
                    ids = np.append(ids, np.uint32(end_id))
                    note(packer.add(Piece(doc, ids, 0, len(ids), skip or 0)))
                if rows:
                    yield flush()
        note(packer.finish())
        if rows:
            yield flush()

    return docs.mapInArrow(run, f"doc_id {kind}, {PIECES}")
