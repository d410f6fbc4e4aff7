"""Assembly of chunks as they arrive: two stateful operators, so that no session is one key.

The sequence numbers of a session are cut into slices. The first operator keeps, for each (session, slice), the runs of chunks
that have arrived; the second one keeps, for each session, the first slice that is not complete and a summary of the slices beyond. Payloads stay
out of both. Slices and sessions are dealt to shards by hash, and a shard holds its entries in map state (RocksDB): a micro-batch reads and
writes only the entries it touches, and a session of any size is spread over as many entries as it has slices.

Sessions are dealt to pages as well, and the same slice of the sessions of one page shares an entry. What an exchange with the state store
costs is so paid once for a page, not once for each of many short sessions, and their chunks are taken in together.

Rows reach a stateful operator one by one in Python, which takes far longer than the operators' own work. So chunks travel in packs: a task
packs what it has read of a shard into a row of arrays, and the first operator packs its summaries by the shard they go to.

What has been silent for the time to live, in event time, is given up by timers.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haulmark.operators.slices import SEQUENCES_PER_SLICE

#: How long a slice or session may be silent, in event time, among how many state keys they are dealt, and among how many pages of each.
TTL_S, SHARDS, PAGES = 86_400, 256, 64

#: How many rows of a shard are taken in together, and how many of its pages.
ROWS_AT_ONCE, PAGES_AT_ONCE = 1 << 18, 8

#: How many rows a pack holds at most.
PACK = 1 << 14

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def arrive_by_item(run_items: np.ndarray, runs: Runs, items: np.ndarray, seqs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, Runs, np.ndarray]:
    """The runs of each item after chunks have arrived, by item and start, and which of the chunks were there already.

    Runs of an item are disjoint (both ends included); neighbours are joined. Of several copies of a chunk the first counts.
    """
    held = len(run_items)
    item, start, end, size = (np.append(x, y) for x, y in zip((run_items, *runs), (items, seqs, seqs, lengths)))
    order = np.lexsort((start, item))  # stable: a run before the chunks at its start, copies as they came
    item, start, end, size = item[order], start[order], end[order], size[order]
    chunk = order >= held
    run = np.maximum.accumulate(np.where(chunk, -1, np.arange(len(order))))  # the last run that begins here or before
    covered = (run >= 0) & (item[run] == item) & (start <= end[run])
    copy = np.append(False, (item[1:] == item[:-1]) & (start[1:] == start[:-1]))[:len(order)]
    dropped = chunk & (covered | copy)
    ignored = np.zeros(len(seqs), bool)
    ignored[order[dropped] - held] = True
    item, start, end, size = item[~dropped], start[~dropped], end[~dropped], size[~dropped]
    if not len(item):
        return item, (start, end, size), ignored
    begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (start[1:] != end[:-1] + 1)))
    return item[begins], (start[begins], end[np.append(begins[1:], len(item)) - 1], np.add.reduceat(size, begins)), ignored


def arrive(runs: Runs, seqs: np.ndarray, lengths: np.ndarray) -> tuple[Runs, np.ndarray]:
    """:func:`arrive_by_item` for a single one."""
    _, after, ignored = arrive_by_item(np.zeros(len(runs[0]), np.int64), runs, np.zeros(len(seqs), np.int64), seqs, lengths)
    return after, ignored


def pack_bounds(shards: np.ndarray) -> np.ndarray:
    """Where packs of rows sorted by shard begin, and the end of the last one."""
    begins = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    sizes = np.diff(np.append(begins, len(shards)))
    rank = np.arange(len(shards)) - np.repeat(begins, sizes)
    return np.append(np.flatnonzero(rank % PACK == 0), len(shards))


def packed(rows: DataFrame) -> DataFrame:
    """Rows of arrays by ``shard``, each with rows of one task; ``ts`` is the newest time of a pack."""
    columns = [c for c in rows.columns if c not in ("shard", "ts")]
    schema = T.StructType([rows.schema["shard"], *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns), rows.schema["ts"]])

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        table = table.take(np.argsort(table["shard"].to_numpy(), kind="stable")).combine_chunks()
        shards, bounds = table["shard"].to_numpy(), pack_bounds(table["shard"].to_numpy())
        newest = np.maximum.reduceat(table["ts"].cast(pa.int64()).to_numpy(), bounds[:-1])
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), table[c].combine_chunks()) for c in columns]
        return pa.RecordBatch.from_arrays(
            [pa.array(shards[bounds[:-1]]), *lists, pa.array(newest).cast(table.schema.field("ts").type)], ["shard", *columns, "ts"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                count += batch.num_rows
            if count >= ROWS_AT_ONCE:
                yield pack(waiting)
                waiting, count = [], 0
        if count:
            yield pack(waiting)

    return rows.mapInArrow(of_task, schema)


def unpacked(frame: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The rows in packs."""
    return pd.DataFrame({c: np.concatenate(frame[c].to_numpy()) for c in columns})


def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a shard, some pages at a time, so that an entry is exchanged once for many frames."""
    def parts() -> Iterator[pd.DataFrame]:
        whole = pd.concat(waiting, ignore_index=True)
        yield from (part for _, part in whole.groupby(whole["page"] // PAGES_AT_ONCE, sort=False))

    waiting, count = [], 0
    for frame in frames:
        waiting.append(frame)
        count += len(frame)
        if count >= ROWS_AT_ONCE:
            yield from parts()
            waiting, count = [], 0
    if count:
        yield from parts()


class _Pages:
    """Map state by (page, slice). An entry is kept under the first of its sessions; a directory names it and the span of its times."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key_type: str, columns: str):
        self.bytes_ids = key_type == "binary"
        self.entries = handle.getMapState(name, f"session_id {key_type}, slice long", f"sessions array<{key_type}>, {columns}")
        self.places = handle.getMapState(f"{name}_places", "page long, slice long", f"session_id {key_type}, oldest_ms long, newest_ms long")

    def get(self, page: int, number: int) -> tuple | None:
        """The columns of an entry, sessions first."""
        place = self.places.getValue((page, number))
        if place is None:
            return None
        sessions, *columns = self.entries.getValue((self.plain(place[0]), number))
        return [self.plain(x) for x in sessions] if self.bytes_ids else sessions, *columns

    @staticmethod
    def plain(session):
        """State gives binary identifiers as byte arrays, which are no keys."""
        return bytes(session) if isinstance(session, bytearray) else session

    @staticmethod
    def longs(column):
        """State takes in an array of longs as a whole, a list element by element."""
        return array("l", np.asarray(column, np.int64).tobytes()) if len(column) and isinstance(column[0], int | np.integer) else column

    def put(self, page: int, number: int, before: tuple | None, columns: tuple, oldest_ms: int = 0, newest_ms: int = 0) -> None:
        """Replace the entry that :meth:`get` gave; without sessions it ends."""
        first = columns[0][0] if len(columns[0]) else None
        if before is not None and before[0][0] != first:
            self.entries.removeKey((before[0][0], number))
        if len(columns[0]):
            self.entries.updateValue((first, number), tuple(self.longs(x) for x in columns))
            self.places.updateValue((page, number), (first, oldest_ms, newest_ms))
        elif before is not None:
            self.places.removeKey((page, number))

    def directory(self) -> list[tuple[int, int, object, int, int]]:
        """Page, slice, first session, oldest and newest time of each entry."""
        return [(*key, self.plain(first), *times) for key, (first, *times) in self.places.iterator()]

    def remove(self, page: int, number: int, first) -> None:
        self.entries.removeKey((first, number))
        self.places.removeKey((page, number))


class _Expiring(StatefulProcessor):
    """Entries of pages with the event time of their last change; one timer at a time gives up those that are silent."""

    ttl_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def watch(self, last_ms: int, watermark_ms: int) -> None:
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(last_ms + self.ttl_ms, watermark_ms + 1))

    def expired(self, pages: _Pages, watermark_ms: int) -> Iterator[tuple[int, int, object, tuple | None]]:
        """Page, slice and first session of entries with sessions whose time is over, and the columns if others of the entry stay.

        Last of the columns is the time. The next timer is set for the earliest of those that stay.
        """
        due = []
        for page, number, first, oldest_ms, newest_ms in pages.directory():
            if newest_ms + self.ttl_ms <= watermark_ms:
                yield page, number, first, None
                continue
            if oldest_ms + self.ttl_ms <= watermark_ms:
                columns = pages.get(page, number)
                oldest_ms = min(x for x in columns[-1] if x + self.ttl_ms > watermark_ms)
                yield page, number, first, columns
            due.append(oldest_ms + self.ttl_ms)
        if due:
            self.handle.registerTimer(min(due))

    def close(self) -> None:
        pass


class SliceRuns(_Expiring):
    """Runs of arrived chunks of each (session, slice) of a shard."""

    def __init__(self, key_type: str, width: int, ttl_s: int):
        self.key_type, self.width, self.ttl_ms = key_type, width, ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = _Pages(handle, "runs", self.key_type, "counts array<long>, starts array<long>, ends array<long>, sizes array<long>, last_ms array<long>")
        self.passed = handle.getValueState("passed", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = self.passed.get()
        self.passed.update((watermark,))
        waiting, count = [], 0
        for part in pieces(self.in_time(rows, passed[0] if passed else -(2**62))):
            for frame in self.take(part, watermark):
                waiting.append(frame)
                count += len(frame)
            self.watch(int(part["ms"].max()), watermark)
            if count >= ROWS_AT_ONCE:
                yield self.dealt(key[0], waiting)
                waiting, count = [], 0
        if count:
            yield self.dealt(key[0], waiting)

    @staticmethod
    def in_time(frames: Iterator[pd.DataFrame], passed_ms: int) -> Iterator[pd.DataFrame]:
        """The chunks in packs. Spark drops late packs; late chunks of others are those before the watermark of the micro-batch before."""
        for frame in frames:
            chunks = unpacked(frame, ["session_id", "head", "page", "slice", "global_seq", "length", "ms"])
            yield chunks[chunks["ms"] > passed_ms]

    @staticmethod
    def dealt(shard: int, frames: list[pd.DataFrame]) -> pd.DataFrame:
        """Packs by the shard they go to: summaries that of their session; what is ignored only passes through and stays spread by slice."""
        rows = pd.concat(frames, ignore_index=True)
        ignored = rows["ignored"].to_numpy()
        to = np.where(ignored, shard, rows["head"].to_numpy())
        order = np.lexsort((to, ignored))
        rows, to, ignored = rows.iloc[order], to[order], ignored[order]
        bounds = pack_bounds(to * 2 + ignored)
        begins, arrays = bounds[:-1], {c: rows[c].to_numpy() for c in ("session_id", "page", "slice", "seq", "num_bytes", "late", "chunks", "ms")}
        packs = {c: pd.Series(np.split(x, begins[1:]) if len(begins) > 1 else [x], dtype=object) for c, x in arrays.items()}
        newest = np.maximum.reduceat(arrays["ms"], begins)
        return pd.DataFrame({"shard": to[begins], "ignored": ignored[begins], **packs, "ts": pd.to_datetime(newest, unit="ms")})

    def take(self, part: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """Take in the chunks of some pages: those that are ignored, and a summary of each slice that has grown."""
        places = [*part.groupby(["page", "slice"], sort=False).groups]
        before = [self.runs.get(int(page), int(number)) for page, number in places]
        held = [(n, *columns) for n, columns in enumerate(before) if columns is not None]

        def gathered(column: int) -> np.ndarray:
            return np.array([x for entry in held for x in entry[column]], np.int64)

        # An item is a (session, slice); those held come first, in their order.
        old_place = np.repeat(np.array([entry[0] for entry in held], np.int64), [len(entry[1]) for entry in held])
        counts, runs, old_last = gathered(2), (gathered(3), gathered(4), gathered(5)), gathered(6)
        names = ["page", "slice", "session_id"]
        old = pd.DataFrame({
            "page": np.array([p for p, _ in places], np.int64)[old_place], "slice": np.array([s for _, s in places], np.int64)[old_place],
            "session_id": pd.Series([x for entry in held for x in entry[1]], dtype=part["session_id"].dtype)})
        both = pd.concat([old, part[names]], ignore_index=True) if len(old) else part[names].reset_index(drop=True)
        groups = both.groupby(["slice", "session_id"], sort=False)
        codes = groups.ngroup().to_numpy()
        firsts = np.unique(codes, return_index=True)[1]
        known = both.iloc[firsts]
        number, total = known["slice"].to_numpy(np.int64), len(firsts)
        items, seqs, lengths = codes[len(old):], part["global_seq"].to_numpy(np.int64), part["length"].to_numpy(np.int64)
        last = np.full(total, -(2**62), np.int64)
        last[:len(old)] = old_last
        np.maximum.at(last, items, part["ms"].to_numpy(np.int64))
        begin, shown = number * self.width, np.maximum(last, watermark + 1)
        head = np.zeros(total, np.int64)
        head[items] = part["head"].to_numpy(np.int64)

        settled, old_first = begin - 1, np.cumsum(counts) - counts
        whole = runs[0][old_first] == begin[:len(old)]
        settled[:len(old)][whole] = runs[1][old_first][whole]
        run_items, (starts, ends, sizes), ignored = arrive_by_item(np.repeat(np.arange(len(old)), counts), runs, items, seqs, lengths)

        sessions = known["session_id"].reset_index(drop=True)
        if ignored.any():
            of = items[ignored]
            yield self.shaped(part["session_id"][ignored], head[of], part["page"][ignored], number[of], True, seqs[ignored], lengths[ignored],
                              seqs[ignored] <= settled[of], 0, shown[of])
        first = np.flatnonzero(np.append(True, run_items[1:] != run_items[:-1]))
        grown = np.flatnonzero(np.bincount(items[~ignored], minlength=total))
        if len(grown):
            whole, chunks = starts[first] == begin, np.add.reduceat(ends - starts + 1, first)
            prefix, size = np.where(whole, ends[first] + 1 - begin, 0), np.where(whole, sizes[first], 0)
            yield self.shaped(sessions[grown], head[grown], known["page"].iloc[grown], number[grown], False, prefix[grown], size[grown], False, chunks[grown],
                              shown[grown])

        # The entries, each with its items in order and their runs.
        where = pd.MultiIndex.from_tuples(places).get_indexer(pd.MultiIndex.from_frame(known[["page", "slice"]]))
        by_item, by_run = np.argsort(where, kind="stable"), np.argsort(where[run_items], kind="stable")
        item_ends = np.searchsorted(where[by_item], np.arange(len(places)), side="right")
        run_ends = np.searchsorted(where[run_items[by_run]], np.arange(len(places)), side="right")
        counts = np.diff(np.append(first, len(run_items)))
        per_item = [sessions[by_item].tolist(), counts[by_item]]
        per_run, times = [x[by_run] for x in (starts, ends, sizes)], last[by_item]
        i = r = 0
        for (page, number_), was, i_end, r_end in zip(places, before, item_ends.tolist(), run_ends.tolist()):
            span = times[i:i_end]
            self.runs.put(int(page), int(number_), was, (*(x[i:i_end] for x in per_item), *(x[r:r_end] for x in per_run), span), int(span.min()), int(span.max()))
            i, r = i_end, r_end

    @staticmethod
    def shaped(sessions, head, pages, number, ignored, seqs, sizes, late, chunks, ms) -> pd.DataFrame:
        return pd.DataFrame({
            "session_id": sessions.to_numpy(), "head": head, "page": pages.to_numpy(), "slice": number, "ignored": ignored, "seq": seqs, "num_bytes": sizes,
            "late": late, "chunks": chunks, "ms": ms})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for page, number, first, columns in self.expired(self.runs, watermark):
            if columns is None:
                self.runs.remove(page, number, first)
                continue
            sessions, counts, *runs, last = columns
            stay = [x + self.ttl_ms > watermark for x in last]
            stay_runs = np.repeat(stay, counts).tolist()
            span = [x for x, y in zip(last, stay) if y]
            left = [[x for x, y in zip(column, stay) if y] for column in (sessions, counts)]
            self.runs.put(page, number, columns, (*left, *([x for x, y in zip(column, stay_runs) if y] for column in runs), span), min(span), max(span))
        yield from ()


class Frontier(_Expiring):
    """How far each session of a shard is complete: its first open slice, and summaries of that one and those beyond."""

    def __init__(self, key_type: str, width: int, ttl_s: int):
        self.key_type, self.width, self.ttl_ms = key_type, width, ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.heads = _Pages(handle, "heads", self.key_type, "slices array<long>, bytes array<long>, chunks array<long>, last_ms array<long>")
        self.beyond = _Pages(handle, "beyond", self.key_type, "prefixes array<long>, bytes array<long>, chunks array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, ignored = timerValues.getCurrentWatermarkInMs(), []
        for part in pieces(self.summaries(rows, ignored)):
            yield from ignored
            ignored.clear()
            yield pd.DataFrame(self.advance(part), columns=["session_id", "kind", "global_seq", "num_bytes", "note"])
            self.watch(int(part["ms"].max()), watermark)
        yield from ignored

    @staticmethod
    def summaries(frames: Iterator[pd.DataFrame], ignored: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The summaries in packs; ``ignored`` gets the chunks that are not taken in."""
        for frame in frames:
            passing = frame["ignored"].to_numpy(bool)
            if passing.any():
                rows = unpacked(frame[passing], ["session_id", "seq", "num_bytes", "late"])
                ignored.append(pd.DataFrame({
                    "session_id": rows["session_id"], "kind": "ignored", "global_seq": rows["seq"], "num_bytes": rows["num_bytes"],
                    "note": np.where(rows["late"].to_numpy(bool), "late", "duplicate")}))
            if not passing.all():
                yield unpacked(frame[~passing], ["session_id", "page", "slice", "seq", "num_bytes", "chunks", "ms"])

    def advance(self, part: pd.DataFrame) -> list[tuple]:
        """Take in the newest summary of each slice and move each session over all complete ones."""
        heads, beyond = _Loaded(self.heads), _Loaded(self.beyond)
        last = part.groupby("session_id", sort=False)["ms"].max()
        newest = part.sort_values("chunks").drop_duplicates(["session_id", "slice"], keep="last")
        touched = {}
        for session, page, number, prefix, size, count in zip(*(newest[c].tolist() for c in ("session_id", "page", "slice", "seq", "num_bytes", "chunks"))):
            touched[session] = page
            of_page, summaries = heads.page(page, 0), beyond.page(page, number)
            head, done, chunks, ms = of_page.get(session, (0, 0, 0, 0))
            seen = summaries.get(session, (0, 0, 0))[2]
            if number >= head and count > seen:
                summaries[session] = (prefix, size, count)
                of_page[session] = (head, done, chunks + count - seen, ms)
        found = []
        for session, ms in zip(last.index.tolist(), last.tolist()):
            page = touched[session]
            of_page = heads.page(page, 0)
            head, done, chunks, before_ms = of_page.get(session, (0, 0, 0, 0))
            prefix, size, _ = beyond.page(page, head).get(session, (0, 0, 0))
            while prefix == self.width:
                del beyond.page(page, head)[session]
                head, done = head + 1, done + size
                prefix, size, _ = beyond.page(page, head).get(session, (0, 0, 0))
            of_page[session] = (head, done, chunks, max(before_ms, ms))
            next_seq = head * self.width + prefix
            found.append((session, "progress", next_seq, done + size, str(chunks - next_seq)))
        heads.save(times=True)
        beyond.save()
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, gone = timerValues.getCurrentWatermarkInMs(), {}
        for page, number, first, columns in self.expired(self.heads, watermark):
            if columns is None:
                self.heads.remove(page, number, first)
                gone[page] = None
                continue
            rows = [row for row in zip(*columns) if row[-1] + self.ttl_ms > watermark]
            left = tuple(list(x) for x in zip(*rows))
            self.heads.put(page, number, columns, left, min(left[-1]), max(left[-1]))
            gone[page] = set(columns[0]) - set(left[0])
        for page, number, first, *_ in self.beyond.directory() if gone else []:
            if page in gone and gone[page] is None:
                self.beyond.remove(page, number, first)
            elif page in gone:
                columns = self.beyond.get(page, number)
                rows = [row for row in zip(*columns) if row[0] not in gone[page]]
                if len(rows) < len(columns[0]):
                    self.beyond.put(page, number, columns, tuple(list(x) for x in zip(*rows)) if rows else ([],))
        yield from ()


class _Loaded:
    """Entries of pages as they are read, by session, to be written back together."""

    def __init__(self, pages: _Pages):
        self.pages, self.before, self.now = pages, {}, {}

    def page(self, page: int, number: int) -> dict:
        place = (page, number)
        if place not in self.now:
            columns = self.before[place] = self.pages.get(page, number)
            self.now[place] = {} if columns is None else dict(zip(columns[0], zip(*columns[1:])))
        return self.now[place]

    def save(self, times: bool = False) -> None:
        for place, rows in self.now.items():
            columns = ([*rows], *(list(x) for x in zip(*rows.values())))
            span = columns[-1] if times else [0]
            self.pages.put(*place, self.before[place], columns, min(span), max(span))


def assemble_stream(chunks: DataFrame, width: int = SEQUENCES_PER_SLICE, ttl_s: int = TTL_S, shards: int = SHARDS, pages: int = PAGES) -> DataFrame:
    """Progress of each session, and the late and duplicate chunks that were ignored.

    ``chunks`` has session_id, global_seq, length and ts, the event time, with a watermark; rows without one of the first two or a time are ignored, a
    length that is missing counts zero. For ``progress`` rows global_seq is the next sequence expected, num_bytes the contiguous bytes and
    note the number of chunks waiting; each session that a micro-batch touches has one or more. For ``ignored`` rows they are the chunk, its length and
    why: ``late`` if its slice was complete up to it before the micro-batch, ``duplicate`` if it was waiting or came twice.

    A slice or session that is silent for ``ttl_s`` is given up and would begin anew, so choose more than a session may pause.
    ``width``, ``shards`` and ``pages`` change no result. Needs the RocksDB state store.
    """
    key_type = dict(chunks.dtypes)["session_id"]
    slices = F.floor(F.col("global_seq") / F.lit(width)).cast("long")
    rows = chunks.filter("session_id IS NOT NULL AND global_seq >= 0 AND ts IS NOT NULL").select(
        "session_id", F.pmod(F.shiftrightunsigned(F.xxhash64("session_id"), 32), F.lit(pages)).cast("long").alias("page"), slices.alias("slice"),
        "global_seq", F.coalesce("length", F.lit(0)).cast("long").alias("length"), "ts", F.unix_millis("ts").alias("ms"))
    shard = lambda *key: F.pmod(F.xxhash64(*key), F.lit(shards))
    dealt = packed(rows.select("*", shard("session_id", "slice").alias("shard"), shard("session_id").alias("head")))
    runs = dealt.groupBy("shard").transformWithStateInPandas(
        SliceRuns(key_type, width, ttl_s),
        f"shard long, ignored boolean, session_id array<{key_type}>, page array<long>, slice array<long>, seq array<long>, num_bytes array<long>, "
        "late array<boolean>, chunks array<long>, ms array<long>, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts")
    return runs.groupBy("shard").transformWithStateInPandas(
        Frontier(key_type, width, ttl_s), f"session_id {key_type}, kind string, global_seq long, num_bytes long, note string", "Append", "EventTime")
