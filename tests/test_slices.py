"""Sliced running columns and everything built on them against plain Python, with one dominant key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.operators import locks, retention, sequences, timeline
from haulmark.operators.slices import name_slice, running_by_slice, sequence_slice, time_slice


def hot_rows(seed, n=600, span=5000):
    """(key, seq, value): key 0 holds most rows; sequence numbers are distinct per key and have gaps."""
    rng = random.Random(seed)
    taken = {}
    for _ in range(n):
        key = 0 if rng.random() < 0.7 else rng.randrange(1, 6)
        taken.setdefault(key, {})[rng.randrange(span)] = rng.choice([None, rng.randrange(-50, 50)])
    return [(k, s, v) for k, rows in taken.items() for s, v in rows.items()]


def by_key(rows):
    keys = {}
    for k, s, v in sorted(rows, key=lambda r: (r[0], r[1])):
        keys.setdefault(k, []).append((s, v))
    return keys


@pytest.mark.parametrize("seed,width,descending", [(1, 7, False), (2, 100, False), (3, 100_000, False), (4, 50, True)])
def test_running_columns(spark, seed, width, descending):
    rows = hot_rows(seed)
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    got = running_by_slice(
        df, ["k"], ["seq"], sequence_slice("seq", width), descending=descending,
        sums={"n": F.lit(1), "total": F.col("v")}, maxes={"top": F.col("v")}, maxes_before={"top_before": F.col("v")},
        lasts={"last": F.col("v")}, previous={"prev": F.col("v"), "prev_seq": F.col("seq")},
    ).collect()
    expected = set()
    for k, items in by_key(rows).items():
        n, seen, last, prev = 0, [], None, (None, None)
        for s, v in (reversed(items) if descending else items):
            n += 1
            before = max(seen, default=None)
            seen += [] if v is None else [v]
            last = v if v is not None else last
            total = sum(seen) if seen else None
            expected.add((k, s, v, n, total, max(seen, default=None), before, last, prev[1], prev[0]))
            prev = (s, v)
    columns = ["k", "seq", "v", "n", "total", "top", "top_before", "last", "prev", "prev_seq"]
    assert {tuple(r[c] for c in columns) for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("width", [3, 64, 65_536])
def test_ranges_and_stats(spark, width):
    rows = hot_rows(5, span=900)
    df = spark.createDataFrame([(k, s, 10) for k, s, _ in rows], "session_id long, global_seq long, length long")
    gaps, islands, stats = set(), set(), {}
    for k, items in by_key(rows).items():
        seqs = [s for s, _ in items]
        start = prev = seqs[0]
        for s in seqs[1:]:
            if s != prev + 1:
                gaps.add((k, prev + 1, s - 1))
                islands.add((k, start, prev))
                start = s
            prev = s
        islands.add((k, start, prev))
        stats[k] = next(i for i in range(len(seqs) + 1) if i == len(seqs) or seqs[i] != i)
    assert {tuple(r) for r in sequences.missing_ranges(df, ["session_id"], "global_seq", width).collect()} == gaps
    assert {tuple(r) for r in sequences.values_to_ranges(df, ["session_id"], "global_seq", width).collect()} == islands
    got = {r["session_id"]: r for r in sequences.chunk_session_stats(df, width).collect()}
    assert {k: r["next_expected_seq"] for k, r in got.items()} == stats
    assert {k: r["gap_ranges"] for k, r in got.items()} == {k: sum(g[0] == k for g in gaps) for k in got}


def timed(spark, rows):
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))


@pytest.mark.parametrize("alpha", [0.05, 0.28, 0.9, 1.0])
def test_ewma_blocks(spark, alpha):
    rows = [(k, s, v or 0) for k, s, v in hot_rows(6, n=3000, span=200_000)]
    got = timeline.ewma(timed(spark, rows), ["k"], ["ts"], time_slice("ts"), "v", alpha).collect()
    expected = {}
    for k, items in by_key(rows).items():
        smooth = None
        for s, v in items:
            smooth = float(v) if smooth is None else smooth + alpha * (v - smooth)
            expected[k, s] = smooth
    assert len(got) == len(expected)
    for r in got:
        assert r["smoothed"] == pytest.approx(expected[r["k"], r["seq"]], rel=1e-9, abs=1e-9)


def conflicts(runs):
    """The rule run by run."""
    expected, held = set(), {}
    for job, run_id, start, end in sorted(runs, key=lambda r: (r[0], r[2], r[1])):
        if job in held and (held[job] is None or start < held[job]):
            expected.add(run_id)
        else:
            held[job] = end
    return expected


RUNS = "job long, run_id long, start_s long, end_s long"


@pytest.mark.parametrize("width,block", [(500, 4), (7, 2), (100_000, 256), (40, 1000)])
def test_busy_conflicts(spark, width, block):
    rng = random.Random(width)
    runs = []
    for run_id in range(1500):
        job = 0 if rng.random() < 0.6 else rng.randrange(1, 40)
        start = rng.randrange(-2_000, 20_000)
        runs.append((job, run_id, start, start + rng.choice([0, 1, 5, 40, 300, 3000, -2])))
    runs += [(50, 5000 + i, i * 10, i * 10 + 10) for i in range(300)]  # one chain of accepted runs without a gap
    runs += [(51, 6000 + i, i, 100_000 - i) for i in range(300)]  # every run would hold to the end
    df = spark.createDataFrame(runs, RUNS)
    got = [r["run_id"] for r in locks.busy_conflicts(df, "job", sequence_slice("start_s", width), block).collect()]
    assert len(got) == len(set(got)) and set(got) == conflicts(runs)


def test_busy_conflicts_of_open_ends_and_empty_tables(spark):
    runs = [(1, 1, 0, 10), (1, 2, 10, None), (1, 3, 10**12, 10**12 + 1), (2, 4, 5, 6), (2, 5, 6, 7)]
    df = spark.createDataFrame([*runs, (None, 6, 1, 2), (1, 7, None, 2)], RUNS)
    assert {r["run_id"] for r in locks.busy_conflicts(df, "job", sequence_slice("start_s", 4)).collect()} == conflicts(runs) == {3}
    assert locks.busy_conflicts(df.limit(0), "job", sequence_slice("start_s", 4)).count() == 0


def test_one_busy_job(spark):
    """All runs under one key: 200 slices, none of which sees more than its own runs."""
    rng = random.Random(3)
    runs = [("only", i, s, s + rng.randrange(1, 4_000)) for i, s in enumerate(sorted(rng.randrange(1_000_000) for _ in range(40_000)))]
    df = spark.createDataFrame(runs, RUNS.replace("job long", "job string"))
    got = {r["run_id"] for r in locks.busy_conflicts(df, "job", sequence_slice("start_s", 5_000), 16).collect()}
    assert got == conflicts(runs)


@pytest.mark.parametrize("seed", range(20))
def test_step_functions(seed):
    """A composed function says where the lock ends for every time it may begin with."""
    rng = random.Random(seed)
    starts = sorted(rng.randrange(60) for _ in range(30))
    runs = [(s, s + rng.choice([0, 1, 3, 10, 50])) for s in starts]
    cuts = sorted({0, 30, *rng.sample(range(30), 4)})
    cuts = [c for c in cuts if c in (0, 30) or starts[c] != starts[c - 1]]
    tables = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        s, e = (np.array(x) for x in zip(*runs[a:b]))
        entries, lock = locks.step_table(np.array([0]), s, e)
        tables.append((s[entries], lock[entries]))
    upto, lock = locks.composed(tables)
    s, e = (np.array(x) for x in zip(*runs))
    for begin in range(-1, 75):
        held, took = begin, []
        for start, end in runs:
            took.append(start >= held)
            held = end if start >= held else held
        place = int(np.searchsorted(upto, begin, side="left"))
        assert (int(lock[place]) if place < len(upto) else begin) == held
        assert locks.accepted(np.array([0]), s, e, np.array([begin])).tolist() == took


def test_hysteresis_and_probe(spark):
    rng = random.Random(8)
    rows = []
    for hour in range(500):
        drain = rng.choice([0.0, 10.0, 10.0, 10.0])
        rows.append((1, hour, rng.choice([5.0, 6.0, 8.0, 12.0, 13.0]), drain, rng.choice([0, 2, 3, 3])))
    df = spark.createDataFrame(rows, "agent long, hour_no long, producer_bps double, drain_bps double, active int")
    up = down = 0
    expected = set()
    for _, hour, p, d, active in rows:
        if d <= 0 or active <= 0:
            continue
        up = up + 1 if p / d > 1.0 else 0
        down = down + 1 if p / d < 0.7 else 0
        if max(up, down) >= 3:
            expected.add((hour, "scale_up" if up else "scale_down"))
            up = down = 0
    got = timeline.hysteresis_events(df, ["agent"], ["hour_no"], sequence_slice("hour_no", 20))
    assert {(r["hour_no"], r["decision"]) for r in got.collect()} == expected
    gains = timeline.probe_gain(df, ["agent"], ["hour_no"], sequence_slice("hour_no", 20)).collect()
    assert len(gains) == 497
    total = [p + d for _, _, p, d, _ in rows]
    assert all(r["gain"] == pytest.approx((total[r["hour_no"] + 3] - total[r["hour_no"]]) / total[r["hour_no"]]) for r in gains)


def test_grace_and_asof(spark):
    rng = random.Random(9)
    events = [(0 if rng.random() < 0.7 else 1, i, rng.randrange(100_000), rng.random() < 0.5) for i in range(700)]
    df = spark.createDataFrame(events, "agent long, event_id long, s long, lost boolean").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = timeline.grace_recovery(
        df.filter("lost"), df.filter("not lost"), ["agent"], "ts", time_slice("ts", 1000), "event_id", 300
    )
    back = {a: sorted(s for b, _, s, lost in events if b == a and not lost) for a in (0, 1)}
    expected = {}
    for a, i, s, lost in events:
        if lost:
            expected[i] = "recovered" if any(s <= t <= s + 300 for t in back[a]) else "control_lost"
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == expected
    stats = df.filter("not lost").withColumn("cpu", F.col("s"))
    joined = timeline.latest_stats_asof(
        df.filter("lost"), stats, ["agent"], "ts", ["cpu"], time_slice("ts", 1000), "event_id"
    )
    latest = {i: max((t for t in back[a] if t <= s), default=None) for a, i, s, lost in events if lost}
    assert {r["event_id"]: r["cpu"] for r in joined.collect()} == latest


def test_retention_and_tail(spark):
    rng = random.Random(10)
    names = {(0 if rng.random() < 0.7 else rng.randrange(1, 4), f"20{rng.randrange(10, 26)}-0{rng.randrange(1, 9)}-{i:04d}.tar.gz")
             for i in range(500)}
    rows = [(1, a, name, 30 if a == 0 else 2) for a, name in names] + [(1, 0, "notes.txt", 30), (1, 9, "x.tar.gz", 0)]
    df = spark.createDataFrame(rows, "storage long, agent long, file_name string, max_backups long")
    expected = set()
    for agent in range(4):
        mine = sorted(n for a, n in names if a == agent)
        expected |= {(agent, n) for n in mine[: -(30 if agent == 0 else 2)]}
    got = retention.retention_candidates(df)
    assert {(r["agent"], r["file_name"]) for r in got.collect()} == expected
    tail = timeline.recent_per_key(df, ["agent"], ["file_name"], name_slice("file_name", 4), 30)
    assert tail.filter("agent = 0").count() == 30


def test_bucket_retention_of_names_with_a_long_common_beginning(spark):
    from haulmark.operators.retention import bucket_retention

    keys = [f"p/production-database-01/{k:04d}.tar.gz" for k in range(120)] + ["p/a.tar.gz", "p/production", "other"]
    objects = spark.createDataFrame([(1, "b", key, "p/", 7) for key in keys], "storage int, bucket string, key string, prefix string, retain int")
    want = sorted(sorted(key for key in keys if key.startswith("p/"))[:-7])
    for rows in (5, 1_000_000):
        assert sorted(r.key for r in bucket_retention(objects, rows).collect()) == want


@pytest.mark.parametrize("rows_per_slice", [3, 40, 10_000])
def test_beyond_newest_equals_a_sort(spark, rows_per_slice):
    """A key with most rows whose names share 200 characters, copies of names, and keeps of every kind."""
    rng = random.Random(rows_per_slice)
    keep = {"hot": 700, "few": 5, "all": 0, "below": -1, "none": None, "more": 10**6}
    rows = [("hot", "x" * 200 + str(rng.randrange(5000)).zfill(5)) for _ in range(2000)]
    rows += [(k, f"{rng.randrange(50):03}-{n}") for k in keep for n in range(30) if k != "hot"]
    df = spark.createDataFrame([(k, n, keep[k]) for k, n in rows], "bucket string, name string, keep long").repartition(4)
    sliced = retention.with_name_slices(df, ["bucket"], "name", rows_per_slice)
    got = retention.beyond_newest(sliced, ["bucket"], "name", "keep").collect()
    want, first = [], []
    for k, n in keep.items():
        doomed = sorted((r[1] for r in rows if r[0] == k), reverse=True)[max(n, 0):] if n is not None else []
        want += [(k, name) for name in doomed]
        first += [(k, doomed[0])] if doomed else []
    assert sorted((r.bucket, r.name) for r in got) == sorted(want)
    assert sorted((r.bucket, r.name) for r in got if r.newest_removed) == sorted(first)
    slices = retention.name_bounds(df, ["bucket"], "name", rows_per_slice).filter("bucket = 'hot'").first()
    assert (slices is None) if rows_per_slice > 2000 else len(slices["_bounds"]) >= 40
    assert retention.beyond_newest(sliced.limit(0), ["bucket"], "name", "keep").count() == 0
