"""Samples over time per key: rates, smoothing, hysteresis, slow periods, as-of lookups, conflicts, stalls.

Every function takes ``slice_by``, an expression that cuts the time of a key into slices (see
:mod:`haulmark.operators.slices`), so no key's whole history meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from haulmark.operators.slices import running_by_slice

MIB = 1024 * 1024
# Smoothing factors, scaler thresholds, probing, deadlines and timeouts in seconds.
THROUGHPUT_ALPHA = 0.28
RTT_ALPHA = 0.25
SCALE_UP_ABOVE = 1.0
SCALE_DOWN_BELOW = 0.7
HYSTERESIS = 3
PROBE_WINDOWS = 3
PROBE_GAIN = 0.05
MIN_STREAM_MBPS = 1.0
GRACE_SECONDS = 300
UPLOAD_STALL_SECONDS = 300
FLUSH_STALL_SECONDS = 30
FLUSH_CAP_SECONDS = 1800
SPARKLINE_POINTS = 1800


def counter_delta_rate(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, counter: str, interval_s: float
) -> DataFrame:
    """Add ``rate_mbps``: growth of a counter since the sample before; a reset counts as 0, the first has none."""
    placed = running_by_slice(df, keys, order, slice_by, previous={"_before": F.col(counter)})
    growth = F.greatest(F.col(counter) - F.col("_before"), F.lit(0))
    rate = F.when(F.col("_before").isNotNull(), growth / F.lit(interval_s * MIB))
    return placed.withColumn("rate_mbps", rate).drop("_before")


def ewma(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, value: str, alpha: float = THROUGHPUT_ALPHA
) -> DataFrame:
    """Add ``smoothed``, the moving average ``s + alpha * (x - s)`` that starts at the first sample.

    Samples are numbered per key and cut into blocks so long that what a block inherits from before its
    predecessor has faded below the precision of a double. A block therefore needs only the end of the block
    before it, and a key with many samples is spread over its blocks.
    """
    if alpha >= 1:
        return df.withColumn("smoothed", F.col(value).cast("double"))
    kept = 1.0 - alpha
    length = math.ceil(64 / -math.log2(kept))
    number = F.col("_number") - 1
    placed = running_by_slice(df, keys, order, slice_by, sums={"_number": F.lit(1)}).withColumns(
        {"_block": F.floor(number / length), "_at": number % length}
    )
    share = F.when(F.col("_number") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    grown = placed.withColumn("_grown", share * F.col(value) * F.pow(F.lit(1.0 / kept), F.col("_at")))
    seeds = grown.groupBy(*keys, "_block").agg(F.sum("_grown").alias("_sum")).select(
        *keys,
        (F.col("_block") + 1).alias("_block"),
        F.lit(-1).cast("long").alias("_at"),
        (F.col("_sum") * F.lit(kept**length)).alias("_grown"),
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_grown").over(within)
    return (
        grown.unionByName(seeds, allowMissingColumns=True)
        .withColumn("smoothed", total * F.pow(F.lit(kept), F.col("_at")))
        .filter(F.col("_at") >= 0)
        .drop("_number", "_block", "_at", "_grown")
    )


def hysteresis_events(
    rates: DataFrame, keys: list[str], order: list[str], slice_by: Column, windows: int = HYSTERESIS
) -> DataFrame:
    """Scale decisions: every ``windows``-th consecutive sample above or below the stable band.

    Samples without drain or active streams are skipped and do not interrupt a run.
    """
    efficiency = F.col("producer_bps") / F.col("drain_bps")
    band = F.when(efficiency > SCALE_UP_ABOVE, "scale_up").when(efficiency < SCALE_DOWN_BELOW, "scale_down").otherwise(
        "stable"
    )
    usable = rates.filter((F.col("drain_bps") > 0) & (F.col("active") > 0)).withColumn("decision", band)
    numbered = running_by_slice(
        usable, keys, order, slice_by, sums={"_n": F.lit(1)}, previous={"_before": F.col("decision")}
    )
    starts = F.when(~F.col("_before").eqNullSafe(F.col("decision")), F.col("_n"))
    runs = running_by_slice(numbered, keys, order, slice_by, maxes={"_start": starts})
    return runs.filter(
        (F.col("decision") != "stable") & ((F.col("_n") - F.col("_start") + 1) % windows == 0)
    ).drop("_n", "_before", "_start")


def probe_gain(
    rates: DataFrame, keys: list[str], order: list[str], slice_by: Column, windows: int = PROBE_WINDOWS
) -> DataFrame:
    """Gain of producer and drain together some windows after each sample, and whether it is worth keeping.

    Pairs meet on (key, sample number), so no key is gathered in one place.
    """
    numbered = running_by_slice(
        rates.withColumn("_total", F.col("producer_bps") + F.col("drain_bps")), keys, order, slice_by,
        sums={"_n": F.lit(1)},
    )
    baseline = numbered.select(*keys, *order, "_n", F.col("_total").alias("baseline"))
    later = numbered.select(*keys, (F.col("_n") - windows).alias("_n"), F.col("_total").alias("later"))
    gain = F.coalesce(F.try_divide(F.col("later") - F.col("baseline"), F.col("baseline")), F.lit(0.0))
    return (
        baseline.unionByName(later, allowMissingColumns=True)
        .groupBy(*keys, "_n")
        .agg(*[F.max(c).alias(c) for c in (*order, "baseline", "later")])
        .filter(F.col("baseline").isNotNull() & F.col("later").isNotNull())
        .withColumn("gain", gain)
        .withColumn("keep", F.col("gain") >= PROBE_GAIN)
        .drop("_n")
    )


def slow_periods(
    ticks: DataFrame, keys: list[str], order: list[str], slice_by: Column, ts: str, rate: str,
    min_mbps: float = MIN_STREAM_MBPS,
) -> DataFrame:
    """Runs of ticks with traffic below the threshold; a tick without traffic or a fast one ends the run."""
    slow = (F.col(rate) > 0) & (F.col(rate) < min_mbps)
    marked = running_by_slice(
        ticks.withColumn("_slow", slow), keys, order, slice_by, previous={"_before": F.col("_slow")}
    )
    begins = (F.col("_slow") & ~F.coalesce(F.col("_before"), F.lit(False))).cast("int")
    runs = running_by_slice(marked, keys, order, slice_by, sums={"_run": begins})
    return (
        runs.filter("_slow").groupBy(*keys, "_run")
        .agg(F.min(ts).alias("slow_since"), F.max(ts).alias("slow_until"), F.count("*").alias("ticks"))
        .withColumn("duration_s", F.unix_seconds("slow_until") - F.unix_seconds("slow_since"))
        .drop("_run")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key, as an aggregation that folds on the map side."""
    rest = [c for c in df.columns if c not in keys]
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def recent_per_key(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, n: int = SPARKLINE_POINTS) -> DataFrame:
    """The last ``n`` rows of each key."""
    ranked = running_by_slice(df, keys, order, slice_by, descending=True, sums={"_age": F.lit(1)})
    return ranked.filter(F.col("_age") <= n).drop("_age")


def reconnect_ordinals(joins: DataFrame, keys: list[str], order: list[str], slice_by: Column) -> DataFrame:
    """Number each later join of a stream among its rotations or its reconnects; the first join has 0 and 0."""
    numbered = running_by_slice(joins, keys, order, slice_by, sums={"_n": F.lit(1)})
    later = F.col("_n") > 1
    return running_by_slice(
        numbered, keys, order, slice_by,
        sums={
            "rotation_no": (later & F.col("rotation")).cast("int"),
            "reconnect_no": (later & ~F.col("rotation")).cast("int"),
        },
    ).drop("_n")


def reconnect_counts(joins: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rotations and reconnects per stream; the first join is neither."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = F.min_by("rotation", by)
    return joins.groupBy(*keys).agg(
        (F.count_if("rotation") - first.cast("int")).alias("rotations"),
        (F.count_if(~F.col("rotation")) - (~first).cast("int")).alias("reconnects"),
    )


def idle_gap(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, ts: str) -> DataFrame:
    """Add ``idle_us``, microseconds since the row before of the key."""
    placed = running_by_slice(df, keys, order, slice_by, previous={"_before": F.col(ts)})
    return placed.withColumn("idle_us", F.unix_micros(ts) - F.unix_micros("_before")).drop("_before")


def idle_since(df: DataFrame, keys: list[str], ts: str, as_of: Column) -> DataFrame:
    """Seconds from the last activity of each key to ``as_of``."""
    return df.groupBy(*keys).agg(F.max(ts).alias("last_activity")).withColumn(
        "idle_secs", F.unix_seconds(as_of) - F.unix_seconds("last_activity")
    )


def latest_stats_asof(
    snapshots: DataFrame, stats: DataFrame, keys: list[str], ts: str, values: list[str], slice_by: Column, tie: str
) -> DataFrame:
    """Attach to each snapshot the newest stats at or before its time.

    One ordered pass over both tables, not a range join; stats of the same moment come first.
    """
    left = snapshots.select("*", F.lit(1).alias("_kind"))
    right = stats.select(*keys, ts, tie, F.struct(*values).alias("_stats"), F.lit(0).alias("_kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    carried = running_by_slice(both, keys, [ts, "_kind", tie], slice_by, lasts={"_newest": F.col("_stats")})
    return carried.filter(F.col("_kind") == 1).select(
        *snapshots.columns, *[F.col(f"_newest.{c}").alias(c) for c in values]
    )


def grace_recovery(
    lost: DataFrame, recovered: DataFrame, keys: list[str], ts: str, slice_by: Column, tie: str,
    grace_s: int = GRACE_SECONDS,
) -> DataFrame:
    """Each loss with the next recovery of its key, ``control_lost`` if none follows within the grace.

    Only the nearest recovery can decide, so one descending pass replaces an interval join.
    """
    left = lost.select(*keys, ts, tie, F.lit(0).alias("_kind"), F.lit(None).cast("timestamp").alias("_back"))
    right = recovered.select(*keys, ts, tie, F.lit(1).alias("_kind"), F.col(ts).alias("_back"))
    seen = running_by_slice(
        left.unionByName(right), keys, [ts, "_kind", tie], slice_by, descending=True, lasts={"_next": F.col("_back")}
    )
    wait_us = F.unix_micros("_next") - F.unix_micros(ts)
    within = F.coalesce(wait_us <= grace_s * 1_000_000, F.lit(False))
    return seen.filter(F.col("_kind") == 0).select(
        *keys, ts, tie,
        F.when(within, F.col("_next")).alias("recovered_at"),
        F.when(within, "recovered").otherwise("control_lost").alias("outcome"),
    )


def missed_heartbeats(
    pings: DataFrame, keys: list[str], order: list[str], slice_by: Column, ts: str, keepalive_s: float, side: str = "server",
    as_of: Column | None = None,
) -> DataFrame:
    """Moments at which a channel counts as lost: the first read deadline that passes without a ping.

    ``back_at`` is the ping that ends the silence. With ``as_of``, a channel that is still silent then has a row
    without it.
    """
    deadline_us = int((keepalive_s + 5 if side == "agent" else 2.5 * keepalive_s) * 1_000_000)
    gaps = idle_gap(pings, keys, order, slice_by, ts)
    lost = F.timestamp_micros(F.unix_micros(ts) - F.col("idle_us") + deadline_us)
    ended = gaps.filter(F.col("idle_us") > deadline_us).select(*keys, lost.alias("lost_at"), F.col(ts).alias("back_at"))
    if as_of is None:
        return ended
    last = pings.groupBy(*keys).agg(F.max(ts).alias("_last"))
    silent = last.filter(F.unix_micros(as_of) - F.unix_micros("_last") > deadline_us)
    return ended.unionByName(silent.select(
        *keys, F.timestamp_micros(F.unix_micros("_last") + deadline_us).alias("lost_at"), F.lit(None).cast("timestamp").alias("back_at")))


def stall_detect(
    samples: DataFrame, keys: list[str], order: list[str], slice_by: Column, ts: str, progress: Column,
    limit_s: int, cap_s: int | None = None,
) -> DataFrame:
    """Samples at which nothing has moved for ``limit_s``, or ``cap_s`` has passed since the first sample.

    ``progress`` grows while the transfer moves: bytes sent, or the bytes remaining negated.
    """
    moved = running_by_slice(
        samples.withColumn("_progress", progress), keys, order, slice_by,
        maxes_before={"_best": F.col("_progress")},
    )
    advance = F.when(F.coalesce(F.col("_progress") > F.col("_best"), F.lit(True)), F.col(ts))
    marked = running_by_slice(
        moved, keys, order, slice_by, lasts={"last_progress": advance},
        maxes={"_begun": F.when(F.col("_best").isNull(), F.col(ts))},
    )
    idle = F.unix_seconds(ts) - F.unix_seconds("last_progress")
    reason = F.when(idle >= limit_s, "stalled")
    if cap_s is not None:
        reason = F.when(F.unix_seconds(ts) - F.unix_seconds("_begun") >= cap_s, "timeout").otherwise(reason)
    return marked.withColumns({"idle_s": idle, "reason": reason}).filter(F.col("reason").isNotNull()).drop(
        "_progress", "_best", "_begun"
    )


def buffer_pressure(
    events: DataFrame, order: list[str], slice_by: Column, capacity: int, threshold: float = 0.5
) -> DataFrame:
    """Bytes in flight after each buffer event and whether draining is due.

    ``events`` has buffer, kind (push, drain, fallback, backpressure) and bytes; only pushes and drains move
    the level.
    """
    change = F.when(F.col("kind") == "push", F.col("bytes")).when(F.col("kind") == "drain", -F.col("bytes")).otherwise(0)
    level = running_by_slice(events, ["buffer"], order, slice_by, sums={"in_flight_bytes": change})
    fill = F.col("in_flight_bytes") / F.lit(float(capacity))
    return level.withColumns({"fill_ratio": fill, "drain_due": fill >= threshold})


def buffer_stats(events: DataFrame, ts: str, interval: str) -> DataFrame:
    """Pushes, drains, fallbacks and backpressure per interval; chunks drained count as one MiB each."""
    kind = F.col("kind")
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return (
        events.groupBy("buffer", F.window(ts, interval))
        .agg(
            F.count_if(kind == "push").alias("pushed"), F.count_if(kind == "drain").alias("drained"),
            F.count_if(kind == "fallback").alias("fallbacks"),
            F.count_if(kind == "backpressure").alias("backpressure_events"),
        )
        .withColumn("pending", F.greatest(F.lit(0), F.col("pushed") - F.col("drained")))
        .withColumn("drain_rate_mbps", F.col("drained") / seconds)
    )


def session_in_flight(events: DataFrame, capacity: int) -> DataFrame:
    """Bytes of each session still in the buffer, and their share of its capacity in percent."""
    change = F.when(F.col("kind") == "push", F.col("bytes")).when(F.col("kind") == "drain", -F.col("bytes")).otherwise(0)
    held = F.greatest(F.lit(0), F.col("net_bytes"))
    return events.groupBy("session_id").agg(F.sum(change).alias("net_bytes")).select(
        "session_id", held.alias("in_flight_bytes"), (held * 100.0 / F.lit(capacity)).alias("fill_percent")
    )
