"""Runs that want a lock while another one holds it, decided without reading a key's runs one after the other.

A run is accepted if it starts when or after the lock of its key is free; it then holds the lock to its end. Rejected runs
hold nothing, so whether a run is accepted depends on all before it. The runs of a key are cut into slices of time, and for
each slice the tasks work out a *step function*: the time to which the lock is held when the slice begins -> the time to
which it is held when the slice ends. Such functions are small tables (all times up to ``upto`` lead to ``lock``) and they
compose: first those of neighbouring slices into one of a block, block by block in parallel, then block after block per
key. On the way back each block, then each slice learns the lock it begins with, and decides its own runs.

Within a slice, chains of accepted runs are followed by doubling pointers to the next acceptable run, over all slices of a
batch at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.session import written

#: Slices whose step functions are composed in one task before those of a key meet.
SLICES_PER_BLOCK = 256
#: Free since ever, and held for ever.
FREE, HELD = -(2**63), 2**63 - 1


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches regrouped so that rows with equal keys are never in two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        other = np.flatnonzero((batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy())
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or held and not (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            done = [*held, batch.iloc[:cut]] if cut else held
            if done:
                yield pd.concat(done, ignore_index=True)
            held = [batch.iloc[cut:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def starts_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a new combination of keys begins."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        values = frame[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def next_acceptable(first: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the next one of its group that starts at or after its end, and the end of its group.

    ``first`` holds the positions at which groups begin; within a group runs are ordered by start.
    """
    count = len(start)
    number = np.arange(count)
    group = np.searchsorted(first, number, side="right") - 1
    limit = np.append(first[1:], count)[group]
    # Ranks instead of times, so that group and time fit one number.
    times = np.unique(start)
    width = len(times) + 1
    found = np.searchsorted(group * width + np.searchsorted(times, start), group * width + np.searchsorted(times, end), side="left")
    return np.clip(found, number + 1, limit), limit


def step_table(first: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose start ends a step of their group's function, and the lock after the group for each run, if it is the first accepted."""
    following, limit = next_acceptable(first, start, end)
    final = np.where(following < limit, following, np.arange(len(start)))
    while True:
        further = final[final]
        if (further == final).all():
            break
        final = further
    lock = end[final]
    group = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    entry = np.ones(len(start), bool)  # of equal starts the first is accepted first
    entry[1:] = (start[1:] != start[:-1]) | (group[1:] != group[:-1])
    entries = np.flatnonzero(entry)
    same = (group[entries][1:] == group[entries][:-1]) & (lock[entries][1:] == lock[entries][:-1])
    return entries[np.append(~same, True)] if len(entries) else entries, lock


def accepted(first: np.ndarray, start: np.ndarray, end: np.ndarray, lock: np.ndarray) -> np.ndarray:
    """Which runs are accepted where the lock of their group is held until ``lock`` (one for each group)."""
    following, limit = next_acceptable(first, start, end)
    count = len(start)
    pointer = np.append(np.where(following < limit, following, count), count)
    reached = np.zeros(count + 1, bool)
    bounds = np.append(first, count)
    begin = [at + bisect_left(start[at:to], free) for at, to, free in zip(bounds[:-1], bounds[1:], lock.tolist())]
    reached[[b for b, to in zip(begin, bounds[1:]) if b < to]] = True
    while (pointer < count).any():
        reached[pointer[np.flatnonzero(reached)]] = True
        pointer = pointer[pointer]
    return reached[:count]


def composed(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One step function for several, applied in order. A time beyond the last step passes through unchanged."""
    upto, lock = tables[-1]
    for own, out in reversed(tables[:-1]):
        place = np.searchsorted(upto, out, side="left")
        through = np.where(place < len(upto), lock[np.minimum(place, len(upto) - 1)], out)
        later = np.searchsorted(upto, own[-1], side="right")
        upto, lock = np.append(own, upto[later:]), np.append(through, lock[later:])
        kept = np.append(lock[1:] != lock[:-1], True)
        upto, lock = upto[kept], lock[kept]
    return upto, lock


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["k", "slice"]):
        entries, lock = step_table(starts_of(frame, ["k", "slice"]), frame["start_s"].to_numpy(), frame["end_s"].to_numpy())
        yield pd.DataFrame({"k": frame["k"].iloc[entries], "slice": frame["slice"].iloc[entries],
                            "upto": frame["start_s"].iloc[entries], "lock": lock[entries]})


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["k", "block"]):
        upto, lock = frame["upto"].to_numpy(), frame["lock"].to_numpy()
        slices, blocks = np.append(starts_of(frame, ["k", "slice"]), len(frame)), np.append(starts_of(frame, ["k", "block"]), len(frame))
        keys, numbers, ups, locks = [], [], [], []
        for at, to in zip(blocks[:-1], blocks[1:]):
            cuts = slices[np.searchsorted(slices, at):np.searchsorted(slices, to) + 1]
            u, o = composed([(upto[a:b], lock[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
            ups.append(u), locks.append(o)
            keys.extend([frame["k"].iat[at]] * len(u)), numbers.extend([frame["block"].iat[at]] * len(u))
        yield pd.DataFrame({"k": keys, "block": numbers, "upto": np.concatenate(ups), "lock": np.concatenate(locks)})


def _walk(group: str, part: str):
    """Locks at the beginning of each ``part`` of a ``group``, along its parts; a row without ``upto`` gives that of the group."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        within = list(dict.fromkeys(["k", group]))
        current, held = None, FREE
        for frame in whole_groups(batches, ["k", part]):
            firsts = np.append(starts_of(frame, [*within, part, "seed"]), len(frame))
            keys, parts, locks = [], [], []
            upto, lock, seed = frame["upto"].tolist(), frame["lock"].tolist(), frame["seed"].tolist()
            k, number, of = frame["k"].tolist(), frame[part].tolist(), frame[group].tolist()
            for at, to in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                if (k[at], of[at]) != current:
                    current, held = (k[at], of[at]), FREE
                if seed[at] == 0:
                    held = lock[at]
                    continue
                keys.append(k[at]), parts.append(number[at]), locks.append(held)
                place = bisect_left(upto, held, at, to)
                held = lock[place] if place < to else held
            yield pd.DataFrame({"k": keys, part: parts, "lock": locks})

    return walk


def _reject(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["k", "slice"]):
        seeds = frame["seed"].to_numpy() == 0
        runs = frame[~seeds]
        first = starts_of(runs, ["k", "slice"])
        kept = accepted(first, runs["start_s"].to_numpy(), runs["end_s"].to_numpy(), frame["lock"].to_numpy()[seeds])
        yield runs.loc[~kept, ["k", "run_id", "start_s"]]


def busy_conflicts(runs: DataFrame, key: str, slice_by: Column, slices_per_block: int = SLICES_PER_BLOCK) -> DataFrame:
    """Starts rejected because an accepted run of the same key is still going; rejected runs extend nothing.

    ``runs`` has run_id (not null), start_s and end_s (long). Runs of one start are taken by run_id. A run without an end holds the
    lock for ever; one without a start or key has not begun and gives no row. ``slice_by`` cuts the time of a key into slices (long, not
    decreasing with start_s) that fit a task; neither it nor ``slices_per_block`` changes the result. The tables of the slices are written to the shared folder.
    """
    key_type, id_type = runs.schema[key].dataType.simpleString(), runs.schema["run_id"].dataType.simpleString()
    rows = runs.filter(F.col(key).isNotNull() & F.col("start_s").isNotNull()).select(
        F.col(key).alias("k"), slice_by.cast("long").alias("slice"), "start_s", "run_id", F.coalesce("end_s", F.lit(HELD)).alias("end_s"))
    sliced = rows.repartition("k", "slice").sortWithinPartitions("k", "slice", "start_s", "run_id")
    table = f"k {key_type}, {{}} long, upto long, lock long"
    block = F.floor(F.col("slice") / slices_per_block).cast("long")
    # Both the way up and the way back read the tables; written, they are worked out once.
    tables = written(sliced.mapInPandas(_tables, table.format("slice")).withColumn("block", block), "lock-tables")
    blocks = tables.repartition("k", "block").sortWithinPartitions("k", "block", "slice", "upto").mapInPandas(_compose, table.format("block"))
    along = blocks.withColumn("seed", F.lit(1)).repartition("k").sortWithinPartitions("k", "block", "upto")
    begins = along.mapInPandas(_walk("k", "block"), f"k {key_type}, block long, lock long")
    seeded = tables.withColumn("seed", F.lit(1)).unionByName(begins.select(
        "k", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("long").alias("upto"), "lock", "block", F.lit(0).alias("seed")))
    seeded = seeded.fillna({"slice": FREE, "upto": FREE}).repartition("k", "block").sortWithinPartitions("k", "block", "slice", "upto")
    locks = seeded.mapInPandas(_walk("block", "slice"), f"k {key_type}, slice long, lock long")
    decided = rows.withColumns({"lock": F.lit(0).cast("long"), "seed": F.lit(1)}).unionByName(locks.select(
        "k", "slice", F.lit(FREE).alias("start_s"), F.lit(0).cast(id_type).alias("run_id"), F.lit(0).cast("long").alias("end_s"), "lock", F.lit(0).alias("seed")))
    rejected = decided.repartition("k", "slice").sortWithinPartitions("k", "slice", "seed", "start_s", "run_id").mapInPandas(
        _reject, f"k {key_type}, run_id {id_type}, start_s long")
    return rejected.withColumnRenamed("k", key)
