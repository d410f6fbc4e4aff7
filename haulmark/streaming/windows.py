"""Streaming rollups that Spark's own windows and aggregates express.

All of them run on batch tables too. Inputs of streams need a watermark; :func:`with_event_time` sets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.progress import mbps

# Tick, snapshot interval, lifetime of a silent session.
TICK = "15 seconds"
SNAPSHOT_EVERY = "5 minutes"
SESSION_TTL = "1 hour"


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Make ``ts`` the event time; rows older than the newest by more than ``delay`` may be dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_throughput(ticks: DataFrame, tick: str = TICK) -> DataFrame:
    """Bytes and MB/s of each stream per tick; a tick without bytes has no row."""
    summed = ticks.groupBy(F.window("ts", tick), "session_id", "slot").agg(F.sum("bytes").alias("bytes"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return summed.withColumn("mbps", mbps("bytes", seconds))


def session_snapshots(samples: DataFrame, values: list[str], order: list[str], every: str = SNAPSHOT_EVERY) -> DataFrame:
    """The last sample of each session in every interval."""
    return samples.groupBy(F.window("ts", every), "session_id").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    ).select("window", "session_id", *[F.col(f"_last.{c}").alias(c) for c in values])


def expire_sessions(activity: DataFrame, ttl: str = SESSION_TTL) -> DataFrame:
    """Sessions silent for ``ttl``: one row per span of activity, once the watermark has passed its end.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` so that spans of a busy
    session are merged before the shuffle.
    """
    spans = activity.groupBy(F.session_window("ts", ttl), "session_id").agg(
        F.max("ts").alias("last_activity"), F.sum("bytes").alias("bytes_total")
    )
    return spans.select(
        "session_id", "last_activity", F.col("session_window.end").alias("expired_at"), "bytes_total",
        F.lit("expired").alias("result"), F.lit("error").alias("level"),
    )


def _newest(changes: DataFrame, keys: list[str], span: str, order: list[str], values: list[Column], flags: list[Column]) -> DataFrame:
    newest = F.struct(*order)
    return changes.groupBy(F.window("ts", span), *keys).agg(
        F.max(newest).alias("newest"), F.max_by(F.struct(*values), newest).alias("values"),
        F.struct(*[F.bool_or(flag).alias(f"flag_{n}") for n, flag in enumerate(flags)] or [F.lit(True).alias("none")]).alias("flags"),
    )


def progress_state(reports: DataFrame, order: list[str], span: str = SESSION_TTL) -> DataFrame:
    """Latest objects sent and total per session and span of time, and whether the file walk has finished in it.

    As a stream, each change of a span is emitted at once and its state ends when the watermark passes the span, so state
    holds the sessions of the last span however long the query runs. :func:`current` makes one row per session of it.
    Rows without a time belong to no span and are left out.
    """
    by_span = _newest(reports, ["session_id"], span, order, [F.col("objects_sent"), F.col("total_objects")], [F.col("walk_complete")])
    return by_span.select("window", "session_id", "newest", "values.*", F.col("flags.flag_0").alias("walk_complete"))


def slot_state(changes: DataFrame, order: list[str], span: str = SESSION_TTL) -> DataFrame:
    """Status of every slot of a session from connect, park, resume, disable and disconnect events, by span of time.

    State ends as in :func:`progress_state`.
    """
    # The slot status each event leads to.
    after = {
        "connect": "receiving", "resume": "receiving", "park": "idle", "disconnect": "disconnected",
        "disable": "disabled",
    }
    table = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
    by_span = _newest(changes, ["session_id", "slot"], span, order, [table[F.col("event")].alias("slot_status")], [])
    return by_span.select("window", "session_id", "slot", "newest", "values.*")


def phase_state(changes: DataFrame, order: list[str], span: str = SESSION_TTL) -> DataFrame:
    """Phase of every session by span of time; state ends as in :func:`progress_state`."""
    by_span = _newest(changes, ["session_id"], span, order, [F.col("phase")], [])
    return by_span.select("window", "session_id", "newest", "values.*")


def current(spans: DataFrame, keys: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of a table of spans: values of the newest, and ``flags`` that stay true once they were."""
    values = [c for c in spans.columns if c not in ("window", "newest", *keys, *flags)]
    return spans.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "newest").alias("last"), *[F.bool_or(flag).alias(flag) for flag in flags]
    ).select(*keys, "last.*", *flags)


def first_arrivals(chunks: DataFrame) -> DataFrame:
    """Chunks without the copies that arrive within the watermark."""
    return chunks.dropDuplicatesWithinWatermark(["session_id", "global_seq"])


def buffer_windows(events: DataFrame, interval: str) -> DataFrame:
    """Pushed and drained bytes and counts of the buffer per interval."""
    kind = F.col("kind")

    def bytes_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, F.col("bytes"))), F.lit(0))

    return events.groupBy(F.window("ts", interval), "buffer").agg(
        bytes_of("push").alias("pushed_bytes"), bytes_of("drain").alias("drained_bytes"),
        F.count_if(kind == "drain").alias("drained"), F.count_if(kind == "backpressure").alias("backpressure_events"),
    )


def rate_windows(samples: DataFrame, interval: str) -> DataFrame:
    """Producer and drain rate, and active streams, per agent and interval."""
    return samples.groupBy(F.window("ts", interval), "agent").agg(
        F.sum("produced").alias("producer_bps"), F.sum("drained").alias("drain_bps"),
        F.array_size(F.collect_set("slot")).alias("active"),
    )


def ping_windows(pings: DataFrame, key: str, width: str) -> DataFrame:
    """First and last ping of each interval: all that a gap longer than the interval depends on."""
    return pings.groupBy(F.window("ts", width), key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
