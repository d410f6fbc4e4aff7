"""Operational summaries: sessions, streams, jobs, agents, events and the metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from haulmark.functions import progress, status


def active_single_plus_parallel(single: DataFrame, parallel: DataFrame) -> DataFrame:
    """Both kinds of session in one list; columns of one kind only are null for the other."""
    return single.withColumn("mode", F.lit("single")).unionByName(
        parallel.withColumn("mode", F.lit("parallel")), allowMissingColumns=True
    )


def prune_inactive_keys(history: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """History of the keys that are still active."""
    return history.join(active.select(key), key, "left_semi")


def metrics_snapshot(sessions: DataFrame, agents: DataFrame, connections: Column) -> DataFrame:
    """Sessions by mode, active streams (a single session counts as one), agents and connections, one row."""
    parallel = F.col("mode") == "parallel"
    counts = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(~parallel).alias("single_sessions"),
        F.count_if(parallel).alias("parallel_sessions"),
        F.coalesce(F.sum(F.when(parallel, F.col("active_streams")).otherwise(1)), F.lit(0)).alias("active_streams"),
    )
    connected = agents.agg(F.count("*").alias("connected_agents"), F.coalesce(connections, F.lit(0)).alias("active_conns"))
    both = counts.unionByName(connected, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def metric_rows(snapshot: DataFrame, prefix: str = "server") -> DataFrame:
    """The snapshot as (name, labels, value, type) rows."""
    entries = [
        ("active_connections", "", "active_conns"),
        ("active_sessions", "", "sessions"),
        ("active_sessions_by_mode", 'mode="single"', "single_sessions"),
        ("active_sessions_by_mode", 'mode="parallel"', "parallel_sessions"),
        ("active_streams", "", "active_streams"),
        ("connected_agents", "", "connected_agents"),
    ]
    return _as_metrics(snapshot, prefix, entries, "gauge")


def buffer_metric_rows(buffer_totals: DataFrame, prefix: str = "server") -> DataFrame:
    """Metric rows of the chunk buffer; without a buffer there is no input row and no metric."""
    gauges = [
        ("chunk_buffer_capacity_bytes", "", "capacity_bytes"),
        ("chunk_buffer_in_flight_bytes", "", "in_flight_bytes"),
        ("chunk_buffer_fill_ratio", "", "fill_ratio"),
    ]
    counters = [
        ("chunk_buffer_total_pushed_total", "", "pushed"),
        ("chunk_buffer_total_drained_total", "", "drained"),
        ("chunk_buffer_fallbacks_total", "", "fallbacks"),
        ("chunk_buffer_backpressure_events_total", "", "backpressure_events"),
    ]
    return _as_metrics(buffer_totals, prefix, gauges, "gauge").unionByName(
        _as_metrics(buffer_totals, prefix, counters, "counter")
    )


def sync_metric_rows(sync_totals: DataFrame, prefix: str = "server") -> DataFrame:
    """Metric rows of the last mirror run, from its grand total row."""
    entries = [
        ("sync_files_uploaded_total", "", "uploaded"), ("sync_files_skipped_total", "", "skipped"),
        ("sync_files_errors_total", "", "errors"),
    ]
    return _as_metrics(sync_totals, prefix, entries, "gauge")


def _as_metrics(row: DataFrame, prefix: str, entries: list[tuple[str, str, str]], kind: str) -> DataFrame:
    items = F.array(*[
        F.struct(
            F.lit(f"{prefix}_{name}").alias("name"), F.lit(labels).alias("labels"),
            F.col(column).cast("double").alias("value"), F.lit(kind).alias("type"),
        )
        for name, labels, column in entries
    ])
    return row.select(F.inline(items))


def session_summary(sessions: DataFrame, streams: DataFrame, as_of: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per session: bytes over its streams, active streams, last activity, status and time left.

    ``sessions`` has objects_sent, total_objects, walk_complete, elapsed_s, closing and phase. Sessions without
    streams count zero bytes and streams. Where ``sessions`` has a ``mode``, those of mode ``single`` have one
    active stream and their own ``bytes_received``; ``last_activity`` of a session fills in for its streams'.
    ``extra`` are further named aggregates over the streams of a session.
    """
    per_session = streams.groupBy("session_id").agg(
        F.sum("offset").alias("_bytes"),
        F.count_if(F.col("slot_status") == "receiving").alias("_active"),
        F.max("last_activity").alias("_last"),
        *extra,
    )
    added = [c for c in per_session.columns if c not in ("session_id", "_bytes", "_active", "_last")]
    given = {"mode": F.lit("parallel"), "bytes_received": F.lit(0).cast("long"), "last_activity": F.lit(None).cast("timestamp")}
    own = sessions.withColumns({c: value for c, value in given.items() if c not in sessions.columns})
    single = F.col("mode") == "single"
    summed = own.join(per_session, "session_id", "left").withColumns({
        "bytes_received": F.when(single, F.col("bytes_received")).otherwise(F.coalesce("_bytes", F.lit(0))),
        "active_streams": F.when(single, F.lit(1)).otherwise(F.coalesce("_active", F.lit(0))).cast("long"),
        "last_activity": F.coalesce("_last", "last_activity"),
    })
    return summed.select(
        "session_id", "bytes_received", "active_streams", "last_activity", "phase",
        status.session_status("last_activity", as_of, "closing").alias("status"),
        progress.session_eta("objects_sent", "total_objects", "elapsed_s", "walk_complete").alias("eta"),
        *added,
    )


def session_detail(sessions: DataFrame, streams: DataFrame, as_of: Column) -> DataFrame:
    """The summary with the streams of the session, ordered by slot, and their total MB/s.

    A session has at most 256 slots and ``streams`` one row per slot, which bounds the list.
    """
    item = F.struct("slot", "offset", "slot_status", "mbps")
    nested = (F.array_sort(F.collect_list(item)).alias("streams"), F.sum("mbps").alias("total_mbps"))
    return session_summary(sessions, streams, as_of, nested)


def stream_display_order(streams: DataFrame) -> DataFrame:
    """Position of each stream on the page: active first, then disabled, then disconnected, each by slot."""
    rank = F.when(F.col("slot_status") == "disconnected", 2).when(F.col("slot_status") == "disabled", 1).otherwise(0)
    by = Window.partitionBy("session_id").orderBy("_rank", "slot")
    return streams.withColumn("_rank", rank).withColumn("position", F.row_number().over(by)).drop("_rank")


def streams_slow_hint(streams: DataFrame) -> DataFrame:
    """Sessions whose slow streams all had recent traffic: how many of how many active streams."""
    slow = F.col("active") & (F.col("status") == "slow")
    return (
        streams.groupBy("session_id")
        .agg(
            F.count_if(slow).alias("slow_streams"), F.count_if("active").alias("active_streams"),
            F.bool_and(F.when(slow, F.coalesce(F.col("idle_secs"), F.lit(0)) < 10)).alias("_recent"),
        )
        .filter((F.col("slow_streams") > 0) & F.col("_recent"))
        .drop("_recent")
    )


def agents_with_session(agents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Connected agents: is there a session, and the version, where a session's own version comes first.

    Of several sessions the one with the smallest id speaks for the agent.
    """
    one = sessions.groupBy("agent").agg(F.min_by("client_version", "session_id").alias("_version"))
    return agents.join(one.withColumn("_has", F.lit(True)), "agent", "left").select(
        "agent", F.coalesce(F.col("_has"), F.lit(False)).alias("has_session"),
        F.coalesce(F.nullif(F.col("_version"), F.lit("")), F.col("client_version")).alias("client_version"),
    )


def job_report(runs: DataFrame, as_of_s: int) -> DataFrame:
    """Per job: running or idle, finished runs, the last result, and the next start strictly after now."""
    start, end = F.col("start_s"), F.col("start_s") + F.col("duration_s")
    done = end <= as_of_s
    latest = F.struct(end.alias("end"), F.col("run_id"))
    return runs.groupBy("job").agg(
        F.when(F.bool_or((start <= as_of_s) & (end > as_of_s)), "running").otherwise("idle").alias("status"),
        F.count_if(done).alias("finished_runs"),
        F.max_by("status", F.when(done, latest)).alias("last_status"),
        F.max_by("duration_s", F.when(done, latest)).alias("last_duration_s"),
        F.min(F.when(start > as_of_s, start)).alias("next_start_s"),
    )


def next_run(report: DataFrame) -> DataFrame:
    """The job that starts next, one row."""
    return report.filter(F.col("next_start_s").isNotNull()).agg(
        F.min(F.struct("next_start_s", "job")).alias("n")
    ).filter(F.col("n").isNotNull()).select("n.job", "n.next_start_s")


def event_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("events"))


def upload_throughput(uploads: DataFrame) -> DataFrame:
    """Average MB/s of each upload; null for one that took no time."""
    return uploads.withColumn("mbps", progress.mbps("bytes", "duration_s"))


def object_progress(totals: DataFrame, latest: DataFrame) -> DataFrame:
    """Scanned totals against what was sent: percent and seconds left per session; nothing reported yet is zero sent."""
    eta = F.when(F.col("walk_complete"), progress.eta_linear("objects_sent", "total_objects", "elapsed_s"))
    reported = totals.join(latest, "session_id", "left").withColumn("objects_sent", F.coalesce("objects_sent", F.lit(0).cast("long")))
    return reported.select(
        "session_id", "total_objects", "objects_sent",
        progress.progress_pct("objects_sent", "total_objects").alias("progress_pct"), eta.alias("eta_s"),
    )
