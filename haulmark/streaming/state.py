"""Streaming operators that keep state of their own.

Folds over windowed aggregates (append mode) get few rows per key and interval, in order, however many events
there were. They follow an aggregation and so use ``transformWithState``, which needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haulmark.operators.timeline import (
    HYSTERESIS, MIN_STREAM_MBPS, RTT_ALPHA, SCALE_DOWN_BELOW, SCALE_UP_ABOVE, THROUGHPUT_ALPHA,
)

# How long a stream must be slow, and rest between alerts, in seconds.
EVAL_WINDOW_S = 3600
COOLDOWN_S = 900
# State of a key that has had no window for so long, in event time, is given up.
WINDOW_TTL_S = 90 * 86_400
# A key's rows of one micro-batch that are sorted in memory, and the blocks of time in which more of them wait in state.
BACKLOG_ROWS = 50_000
BACKLOG_BLOCK_S = 3_600


class Backlog:
    """The rows that a key gets in one micro-batch, as frames in order, with few of them in memory at a time.

    Up to ``most`` rows are sorted as they are. A longer backlog, as a backfill brings, is laid out in map state by blocks of
    ``width`` units of the first column of ``order``; blocks are then read back, sorted and removed one by one. Any ``most``
    and ``width`` give the same rows; a block is what has to fit in memory.
    """

    def __init__(self, handle: StatefulProcessorHandle, order: list[str], width: int, most: int = BACKLOG_ROWS):
        self.order, self.width, self.most = order, width, most
        self.blocks = handle.getMapState("backlog", "block long, part long", "rows binary")

    def _lay_out(self, frames: list[pd.DataFrame], part: int) -> None:
        frame = pd.concat(frames, ignore_index=True)
        for block, rows in frame.groupby(frame[self.order[0]].astype("int64") // self.width):
            table = pa.Table.from_pandas(rows, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.blocks.updateValue((int(block), part), (sink.getvalue().to_pybytes(),))

    def frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, parts = [], 0, 0
        for frame in rows:
            held.append(frame)
            count += len(frame)
            if count > self.most:
                self._lay_out(held, parts)
                held, count, parts = [], 0, parts + 1
        if not parts:
            if held:
                yield pd.concat(held).sort_values(self.order)
            return
        if held:
            self._lay_out(held, parts)
        places: dict[int, list[int]] = {}
        for block, part in list(self.blocks.keys()):
            places.setdefault(block, []).append(part)
        for block in sorted(places):
            found = [pa.ipc.open_stream(self.blocks.getValue((block, part))[0]).read_pandas() for part in sorted(places[block])]
            for part in places[block]:
                self.blocks.removeKey((block, part))
            yield pd.concat(found).sort_values(self.order)


class WindowFold(StatefulProcessor):
    """Fold the windows of a key in order: ``step(state, row)`` gives the next state and the output rows.

    A key starts anew once the watermark is ``ttl_s`` past its last window.
    """

    def __init__(
        self, step: Callable, start: tuple, state_schema: str, order: list[str], columns: list[str], ttl_s: int = WINDOW_TTL_S,
        most: int = BACKLOG_ROWS,
    ):
        self.step, self.start, self.state_schema, self.most = step, start, state_schema, most
        self.order, self.columns, self.ttl_s = order, columns, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", self.state_schema)
        self.backlog = Backlog(handle, self.order, BACKLOG_BLOCK_S, self.most)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.current.get() or self.start
        for frame in self.backlog.frames(rows):
            found = []
            for row in frame.itertuples(index=False):
                state, values = self.step(state, row)
                found.extend((*key, row.tick_s, *v) for v in values)
                last = row.tick_s
            if found:
                yield pd.DataFrame(found, columns=self.columns, dtype=object)
        self.current.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((int(last) + self.ttl_s) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.current.clear()
        yield from ()

    def close(self) -> None:
        pass


def _fold_windows(
    windows: DataFrame, keys: list[str], columns: list[str], order: list[str], step: Callable, start: tuple,
    output: str, state: str, most: int = BACKLOG_ROWS,
) -> DataFrame:
    rows = windows.select(*keys, F.unix_seconds("window.start").alias("tick_s"), *columns)
    types = dict(rows.dtypes)
    key_fields = ", ".join(f"{k} {types[k]}" for k in keys)
    names = [field.split()[0] for field in output.split(", ")]
    processor = WindowFold(step, start, state, order, [*keys, "tick_s", *names], most=most)
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor, f"{key_fields}, tick_s long, {output}", "Append", "EventTime"
    )


def ewma_stream(windows: DataFrame, key: str, value: str, alpha: float = THROUGHPUT_ALPHA, most: int = BACKLOG_ROWS) -> DataFrame:
    """Moving average per key, seeded by its first value; ``most`` as in :class:`Backlog`."""

    def step(state, row):
        sample = float(getattr(row, value))
        before, seen = state
        smoothed = before + alpha * (sample - before) if seen else sample
        return (smoothed, True), [(smoothed,)]

    return _fold_windows(
        windows, [key], [value], ["tick_s"], step, (0.0, False), "smoothed double", "smoothed double, seen boolean", most
    )


def rtt_stream(windows: DataFrame, key: str, value: str) -> DataFrame:
    """Round-trip time in whole nanoseconds, rounded at every step; 0 means none yet."""

    def step(state, row):
        sample, (before,) = int(getattr(row, value)), state
        smoothed = sample if before == 0 else int(np.floor(RTT_ALPHA * sample + (1 - RTT_ALPHA) * before + 0.5))
        return (smoothed,), [(max(smoothed, 0),)]

    return _fold_windows(windows, [key], [value], ["tick_s"], step, (0,), "rtt_ns long", "rtt_ns long")


def hysteresis_stream(windows: DataFrame, key: str, hysteresis: int = HYSTERESIS) -> DataFrame:
    """Scaler state per window: scaling after enough windows in a row, otherwise stable.

    A window without drain or active streams is stable and leaves the counters alone.
    """

    def step(state, row):
        up, down = state
        if not row.drain_bps > 0 or not row.active > 0:
            return state, [(0.0, "stable")]
        efficiency = row.producer_bps / row.drain_bps
        up = up + 1 if efficiency > SCALE_UP_ABOVE else 0
        down = down + 1 if efficiency < SCALE_DOWN_BELOW else 0
        decision = "scale_up" if up >= hysteresis else "scale_down" if down >= hysteresis else "stable"
        if decision != "stable":
            up = down = 0
        return (up, down), [(efficiency, decision)]

    return _fold_windows(
        windows, [key], ["producer_bps", "drain_bps", "active"], ["tick_s"], step, (0, 0),
        "efficiency double, decision string", "up int, down int",
    )


def buffer_pressure_stream(windows: DataFrame, capacity: int, threshold: float = 0.5) -> DataFrame:
    """Bytes in flight at the end of each interval, and whether draining is due."""

    def step(state, row):
        level = state[0] + int(row.pushed_bytes) - int(row.drained_bytes)
        fill = level / capacity
        return (level,), [(level, fill, fill >= threshold, int(row.backpressure_events))]

    return _fold_windows(
        windows, ["buffer"], ["pushed_bytes", "drained_bytes", "backpressure_events"], ["tick_s"], step, (0,),
        "in_flight_bytes long, fill_ratio double, drain_due boolean, backpressure_events long", "level long",
    )


def flow_rotation_alerts(
    throughput: DataFrame, tick_s: int = 15, min_mbps: float = MIN_STREAM_MBPS, eval_window_s: int = EVAL_WINDOW_S,
    cooldown_s: int = COOLDOWN_S, most: int = BACKLOG_ROWS,
) -> DataFrame:
    """Streams to rotate: slow for the whole evaluation window and not alerted within the cooldown.

    One alert per session and tick, lowest slot first. A tick without bytes or a fast one ends a slow spell;
    missing ticks had no bytes. The state of a session is at most one row for each of its 256 slots.
    """

    def step(state, row):
        slots, since, reset, seen, alerted_tick = (list(x) if isinstance(x, (list, np.ndarray)) else x for x in state)
        now, slot = int(row.tick_s), int(row.slot)
        if slot not in slots:
            slots.append(slot), since.append(-1), reset.append(-1), seen.append(-1)
        i = slots.index(slot)
        if seen[i] != now - tick_s:
            since[i] = -1
        seen[i] = now
        found = []
        if row.bytes == 0 or row.mbps >= min_mbps:
            since[i] = -1
        elif since[i] < 0:
            since[i] = now
        elif (
            now - since[i] >= eval_window_s and (reset[i] < 0 or now - reset[i] >= cooldown_s) and alerted_tick != now
        ):
            found.append((slot, float(row.mbps), now - since[i]))
            since[i], reset[i], alerted_tick = -1, now, now
        return (slots, since, reset, seen, alerted_tick), found

    return _fold_windows(
        throughput, ["session_id"], ["slot", "bytes", "mbps"], ["tick_s", "slot"], step, ([], [], [], [], -1),
        "slot long, mbps double, slow_s long",
        "slots array<long>, since array<long>, reset array<long>, seen array<long>, alerted long", most,
    )


class SilenceWatch(StatefulProcessor):
    """Reports the end of each deadline that passes without activity, by the next activity or by a timer."""

    def __init__(self, key_name: str, deadline_s: float, width_s: int, most: int = BACKLOG_ROWS):
        self.most = most
        self.key_name, self.deadline_us, self.width_us = key_name, int(deadline_s * 1_000_000), width_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long, reported boolean")
        self.backlog = Backlog(handle, ["first_us"], BACKLOG_BLOCK_S * 1_000_000, self.most)

    def _lost(self, key, moments: list[int]) -> Iterator[pd.DataFrame]:
        if moments:
            yield pd.DataFrame({self.key_name: [key[0]] * len(moments), "lost_us": moments}, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, reported = self.last.get() or (0, True)
        lost = []
        for frame in self.backlog.frames(rows):
            for row in frame.itertuples(index=False):
                if not reported and row.first_us - last > self.deadline_us:
                    lost.append(last + self.deadline_us)
                last, reported = int(row.last_us), False
            yield from self._lost(key, lost)
            lost = []
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # Certain once the window that holds the deadline is closed: activity before it is known by then.
        due_ms = ((last + self.deadline_us) // self.width_us + 1) * self.width_us // 1000
        if due_ms <= timerValues.getCurrentWatermarkInMs():
            lost.append(last + self.deadline_us)
            self.last.clear()  # a key without state has nothing to report, as one that is reported
        else:
            self.handle.registerTimer(due_ms)
            self.last.update((last, reported))
        yield from self._lost(key, lost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, reported = self.last.get() or (0, True)
        self.last.clear()
        yield from self._lost(key, [] if reported else [last + self.deadline_us])

    def close(self) -> None:
        pass


def silence_alerts(windows: DataFrame, key: str, deadline_s: float, width_s: int, most: int = BACKLOG_ROWS) -> DataFrame:
    """Moments at which a key has been silent for the deadline, each once, even if nothing follows.

    ``windows`` come from :func:`haulmark.streaming.windows.ping_windows` with a width of ``width_s``, up to
    the deadline. Serves heartbeats and upload stalls alike.
    """
    rows = windows.select(
        key, F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us")
    )
    return rows.groupBy(key).transformWithStateInPandas(
        SilenceWatch(key, deadline_s, width_s, most), f"{key} {dict(rows.dtypes)[key]}, lost_us long", "Append", "EventTime"
    )
