"""Streaming queries, run over what is available in the driver tables.

Append streams hold back what the watermark has not passed, so their SQL leaves the same rows out. Ticks of
seconds in production are hours or days here, as the sample feed is sparse.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query, rounded
from haulmark.catalog.files import EVENT_SQL, _event_rows
from haulmark.schemas import EVENTS
from haulmark.session import scratch_path
from haulmark.sources import feeds, stores
from haulmark.streaming import assembly, grace, sinks, state, windows

HDFS_BACKED = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
WM_SQL = "wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events)"


def _stream(v: Views, table: str, store: str = HDFS_BACKED):
    """A table as a feed. The pattern matches a table that is one file as well as a folder of files."""
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    return feeds.read_chunk_stream(v.spark, f"{v.sf_dir}/{table}.parque[t]", v.table(table).schema)


def _ticks(v: Views, store: str = HDFS_BACKED):
    return windows.with_event_time(v.ticks(_stream(v, "events", store)), "ts", DELAY)


def _append(v: Views, stream, name: str):
    return sinks.run_append(stream, scratch_path(v.spark, name))


@query("s7_read_chunk_stream", "SELECT slot_id, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM v_chunks GROUP BY slot_id")
def read_chunk_stream(v: Views):
    slots = _stream(v, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("slot_id"), F.floor("l_quantity").cast("long").alias("length")
    )
    totals = slots.groupBy("slot_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
    return sinks.run_updates(totals, scratch_path(v.spark, "chunk-feed"), ["slot_id"])


@query("s8_read_telemetry_stream", f"""WITH {EVENT_SQL}
    SELECT agent, level, count(*) AS n, epoch_us(max(ts)) AS last_us FROM e GROUP BY ALL""")
def read_telemetry_stream(v: Views):
    path = scratch_path(v.spark, "telemetry")
    stores.append_store(_event_rows(v), path)
    feed = feeds.read_telemetry_stream(v.spark, path, EVENTS)
    counted = feed.groupBy("agent", "level").agg(F.count("*").alias("n"), F.unix_micros(F.max("timestamp")).alias("last_us"))
    return sinks.run_updates(counted, scratch_path(v.spark, "telemetry-feed"), ["agent", "level"])


@query("t1_stream_throughput", """
    SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS tick_us, session_id, slot, CAST(sum(bytes) AS BIGINT) AS bytes,
           round(sum(bytes) / 3600 / 1048576, 8) AS mbps FROM v_ticks GROUP BY ALL""")
def stream_throughput(v: Views):
    ticks = windows.stream_throughput(_ticks(v), "1 hour")
    done = sinks.run_updates(ticks, scratch_path(v.spark, "throughput"), ["window", "session_id", "slot"])
    return done.select(
        F.unix_micros("window.start").alias("tick_us"), "session_id", "slot", "bytes", rounded("mbps", 8).alias("mbps")
    )


@query("t1_stream_throughput_closed", f"""WITH {WM_SQL},
    t AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, session_id, slot, CAST(sum(bytes) AS BIGINT) AS bytes
          FROM v_ticks GROUP BY ALL)
    SELECT epoch_us(day) AS tick_us, session_id, slot, bytes FROM t, wm WHERE day + INTERVAL 1 DAY <= wm""")
def stream_throughput_closed(v: Views):
    """The same rollup by day in append mode: only ticks that can no longer change."""
    done = _append(v, windows.stream_throughput(_ticks(v), "1 day"), "throughput-closed")
    return done.select(F.unix_micros("window.start").alias("tick_us"), "session_id", "slot", "bytes")


@query("t2_session_snapshots", """
    SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, session_id, arg_max(bytes, (ts, event_id)) AS bytes,
           arg_max(slot, (ts, event_id)) AS slot FROM v_ticks GROUP BY ALL""")
def session_snapshots(v: Views):
    snapshots = windows.session_snapshots(_ticks(v), ["bytes", "slot"], ["ts", "event_id"], "1 day")
    done = sinks.run_updates(snapshots, scratch_path(v.spark, "snapshots"), ["window", "session_id"])
    return done.select(F.unix_micros("window.start").alias("start_us"), "session_id", "bytes", "slot")


@query("t3_expire_sessions", f"""WITH {WM_SQL},
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1
          END AS fresh FROM v_ticks),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts) AS span FROM g),
    e AS (SELECT session_id, max(ts) AS last, CAST(sum(bytes) AS BIGINT) AS bytes_total FROM s GROUP BY session_id, span)
    SELECT session_id, epoch_us(last) AS last_us, bytes_total, 'expired' AS result, 'error' AS level
    FROM e, wm WHERE last + INTERVAL 1 HOUR <= wm""")
def expire_sessions(v: Views):
    v.spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    done = _append(v, windows.expire_sessions(_ticks(v)), "expired")
    return done.select("session_id", F.unix_micros("last_activity").alias("last_us"), "bytes_total", "result", "level")


@query("t4_assemble_stream", """
    SELECT session_id, count(*) FILTER (global_seq = rk - 1) AS next_seq,
           CAST(coalesce(sum(length) FILTER (global_seq = rk - 1), 0) AS BIGINT) AS contiguous_bytes,
           count(*) FILTER (global_seq <> rk - 1) AS waiting
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS rk
          FROM (SELECT session_id, global_seq, min(global_seq + session_id % 5 + 1) AS length FROM v_chunks GROUP BY ALL))
    GROUP BY session_id""")
def assemble_stream(v: Views):
    waiting = F.col("note").cast("long")
    done = _assembled(v).filter("kind = 'progress'").groupBy("session_id").agg(
        F.max(F.struct("global_seq", waiting.alias("waiting"), "num_bytes")).alias("p")
    )
    return done.select("session_id", F.col("p.global_seq").alias("next_seq"), F.col("p.num_bytes").alias("contiguous_bytes"), "p.waiting")


def _assembled(v: Views):
    """Copies of a chunk have one length here, as it is not defined which of them a stream sees first."""
    chunks = _stream(v, "lineitem", ROCKSDB).select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") - 1).cast("long").alias("global_seq"),
        (F.col("l_linenumber") + F.col("l_orderkey") % 5).cast("long").alias("length"), F.col("l_shipdate").alias("ts"),
    )
    return _append(v, assembly.assemble_stream(windows.with_event_time(chunks, "ts", DELAY)), "assembly")


@query("t5_ignored_chunks_stream", """
    SELECT session_id, global_seq, count(*) - 1 AS ignored FROM v_chunks GROUP BY ALL HAVING count(*) > 1""")
def ignored_chunks_stream(v: Views):
    ignored = _assembled(v).filter("kind = 'ignored'")
    return ignored.groupBy("session_id", "global_seq").agg(F.count("*").alias("ignored"))


@query("t5_first_arrivals_stream", "SELECT DISTINCT session_id, global_seq FROM v_chunks")
def first_arrivals_stream(v: Views):
    chunks = _stream(v, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") - 1).cast("long").alias("global_seq"),
        F.col("l_shipdate").alias("ts"),
    )
    first = windows.first_arrivals(windows.with_event_time(chunks, "ts", DELAY))
    return _append(v, first, "first-arrivals").select("session_id", "global_seq")


ROTATION_SQL = f"""WITH RECURSIVE {WM_SQL},
    t AS (SELECT session_id, event_id % 2 AS slot, CAST(floor(epoch(ts) / 259200) AS BIGINT) * 259200 AS tick,
          CAST(sum(bytes) AS BIGINT) AS bytes FROM v_ticks GROUP BY ALL),
    r AS (SELECT session_id, slot, tick, bytes, bytes / 259200 / 1048576 AS mbps,
          row_number() OVER (PARTITION BY session_id ORDER BY tick, slot) AS n
          FROM t, wm WHERE tick + 259200 <= epoch(wm)),
    f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS tick,
                 CAST([-1, -1] AS BIGINT[]) AS since, CAST([-1, -1] AS BIGINT[]) AS reset,
                 CAST([-1, -1] AS BIGINT[]) AS seen, CAST(-1 AS BIGINT) AS alerted, false AS fired,
                 CAST(0 AS BIGINT) AS slow_s FROM r
          UNION ALL
          SELECT session_id, n, slot, tick,
                 CASE WHEN slot = 0 THEN [next_since, since[2]] ELSE [since[1], next_since] END,
                 CASE WHEN NOT fires THEN reset WHEN slot = 0 THEN [tick, reset[2]] ELSE [reset[1], tick] END,
                 CASE WHEN slot = 0 THEN [tick, seen[2]] ELSE [seen[1], tick] END,
                 CASE WHEN fires THEN tick ELSE alerted END, fires, tick - cur
          FROM (SELECT *, CASE WHEN NOT slow OR fires THEN -1 WHEN cur < 0 THEN tick ELSE cur END AS next_since
                FROM (SELECT *, slow AND cur >= 0 AND tick - cur >= 259200 AND alerted <> tick
                             AND (reset[slot + 1] < 0 OR tick - reset[slot + 1] >= 777600) AS fires
                      FROM (SELECT r.session_id, r.n, r.slot, r.tick, r.bytes > 0 AND r.mbps < 0.0005 AS slow, f.since,
                                   f.reset, f.seen, f.alerted,
                                   CASE WHEN f.seen[r.slot + 1] = r.tick - 259200 THEN f.since[r.slot + 1] ELSE -1 END AS cur
                            FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1))))
    SELECT session_id, tick AS tick_s, slot, slow_s FROM f WHERE fired"""


@query("t6_flow_rotation_alerts", ROTATION_SQL)
def flow_rotation_alerts(v: Views):
    """Ticks of three days; slow is less than a typical tick carries."""
    ticks = _ticks(v, ROCKSDB).withColumn("slot", F.col("event_id") % 2)
    throughput = windows.stream_throughput(ticks, "3 days")
    alerts = state.flow_rotation_alerts(
        throughput, tick_s=259_200, min_mbps=0.0005, eval_window_s=259_200, cooldown_s=777_600
    )
    return _append(v, alerts, "rotation").drop("mbps")


RATE_WINDOW_SQL = f"""{WM_SQL},
    rw AS (SELECT agent, hour_no, producer_bps, drain_bps, active,
           CASE WHEN producer_bps / drain_bps > 1.0 THEN 'scale_up' WHEN producer_bps / drain_bps < 0.7 THEN 'scale_down'
           ELSE 'stable' END AS band FROM v_rates, wm
           WHERE TIMESTAMP '1970-01-01' + to_hours(CAST(hour_no + 1 AS INTEGER)) <= wm),
    c AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY hour_no)
          - row_number() OVER (PARTITION BY agent, band ORDER BY hour_no) AS run FROM rw WHERE drain_bps > 0),
    d AS (SELECT *, row_number() OVER (PARTITION BY agent, band, run ORDER BY hour_no) AS pos FROM c)"""


@query("t7_hysteresis_stream", f"""WITH {RATE_WINDOW_SQL}
    SELECT rw.agent, rw.hour_no * 3600 AS tick_s, CASE WHEN d.band <> 'stable' AND d.pos % 3 = 0 THEN d.band
           ELSE 'stable' END AS decision
    FROM rw LEFT JOIN d ON rw.agent = d.agent AND rw.hour_no = d.hour_no""")
def hysteresis_stream(v: Views):
    produced = F.col("event_type").isin("click", "view", "signup")
    samples = windows.with_event_time(
        _stream(v, "events", ROCKSDB).select(
            (F.col("user_id") % 10).alias("agent"), (F.col("event_id") % 4).alias("slot"), "ts", "event_type",
            rounded(F.col("value") * 100).cast("long").alias("cents"),
        ), "ts", DELAY,
    )
    split = samples.withColumns({
        "produced": F.when(produced, F.col("cents")).otherwise(0), "drained": F.when(produced, 0).otherwise(F.col("cents"))
    })
    rates = windows.rate_windows(split, "1 hour")
    return _append(v, state.hysteresis_stream(rates, "agent"), "hysteresis").select("agent", "tick_s", "decision")


@query("t8_ewma_stream", f"""WITH {WM_SQL},
    t AS (SELECT session_id, time_bucket(INTERVAL 1 DAY, ts) AS day, sum(bytes) / 1048576.0 AS mb FROM v_ticks GROUP BY ALL),
    l AS (SELECT session_id, day, list(mb) OVER (PARTITION BY session_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS xs
          FROM t, wm WHERE day + INTERVAL 1 DAY <= wm)
    SELECT session_id, CAST(epoch(day) AS BIGINT) AS tick_s,
           round(list_reduce(xs, lambda a, x: a + 0.28 * (x - a)), 5) AS smoothed FROM l""")
def ewma_stream(v: Views):
    daily = _ticks(v, ROCKSDB).groupBy(F.window("ts", "1 day"), "session_id").agg((F.sum("bytes") / 1048576).alias("mb"))
    done = _append(v, state.ewma_stream(daily, "session_id", "mb"), "ewma")
    return done.withColumn("smoothed", rounded("smoothed", 5))


@query("t8_rtt_stream", f"""WITH {WM_SQL},
    t AS (SELECT agent, time_bucket(INTERVAL 1 HOUR, ts) AS hour, max(bytes) AS ns FROM v_ticks GROUP BY ALL),
    l AS (SELECT agent, hour, list(ns) OVER (PARTITION BY agent ORDER BY hour ROWS UNBOUNDED PRECEDING) AS xs
          FROM t, wm WHERE hour + INTERVAL 1 HOUR <= wm)
    SELECT agent, CAST(epoch(hour) AS BIGINT) AS tick_s, list_reduce(xs, lambda a, x: CASE WHEN a = 0 THEN x ELSE
           CAST(floor(0.25 * x + 0.75 * a + 0.5) AS BIGINT) END) AS rtt_ns FROM l""")
def rtt_stream(v: Views):
    hourly = _ticks(v, ROCKSDB).groupBy(F.window("ts", "1 hour"), "agent").agg(F.max("bytes").alias("ns"))
    return _append(v, state.rtt_stream(hourly, "agent", "ns"), "rtt")


@query("t9_buffer_pressure_stream", f"""WITH {WM_SQL},
    w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, sum(CASE WHEN event_type IN ('click', 'view') THEN bytes
          WHEN event_type IN ('purchase', 'signup') THEN -bytes ELSE 0 END) AS change,
          count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS backpressure_events FROM v_ticks GROUP BY ALL),
    l AS (SELECT hour, CAST(sum(change) OVER (ORDER BY hour) AS BIGINT) AS level, backpressure_events FROM w)
    SELECT CAST(epoch(hour) AS BIGINT) AS tick_s, level AS in_flight_bytes, level / 17179869184.0 >= 0.5 AS drain_due,
           backpressure_events FROM l, wm WHERE hour + INTERVAL 1 HOUR <= wm""")
def buffer_pressure_stream(v: Views):
    kind = F.col("event_type")
    events = _ticks(v, ROCKSDB).select(
        "ts", "bytes", F.lit("server").alias("buffer"),
        F.when(kind.isin("click", "view"), "push").when(kind.isin("purchase", "signup"), "drain")
        .when(F.col("event_id") % 2 == 0, "fallback").otherwise("backpressure").alias("kind"),
    )
    done = _append(v, state.buffer_pressure_stream(windows.buffer_windows(events, "1 hour"), 1 << 34), "buffer")
    return done.select("tick_s", "in_flight_bytes", "drain_due", "backpressure_events")


def _silence_sql(key: str, where: str, seconds: int, width: int) -> str:
    return f"""WITH {WM_SQL},
    g AS (SELECT {key}, ts, lead(ts) OVER (PARTITION BY {key} ORDER BY ts) AS following FROM v_ticks WHERE {where})
    SELECT {key}, epoch_us(ts) + {seconds * 1_000_000} AS lost_us FROM g, wm
    WHERE (floor((epoch(ts) + {seconds}) / {width}) + 1) * {width} <= epoch(wm) AND (following IS NULL OR following > ts + INTERVAL {seconds} SECOND)"""


@query("t10_missed_heartbeats_stream", _silence_sql("session_id", "true", 4500, 3600))
def missed_heartbeats_stream(v: Views):
    """Server side of a channel with a keepalive of 1800 seconds."""
    pings = windows.ping_windows(_ticks(v, ROCKSDB), "session_id", "1 hour")
    return _append(v, state.silence_alerts(pings, "session_id", 2.5 * 1800, 3600), "heartbeats")


@query("t12_stall_detect_stream", _silence_sql("session_id", "bytes > 20000000", 432_000, 86_400))
def stall_detect_stream(v: Views):
    """Sessions without traffic worth mention for five days."""
    moving = windows.ping_windows(_ticks(v, ROCKSDB).filter("bytes > 20000000"), "session_id", "1 day")
    return _append(v, state.silence_alerts(moving, "session_id", 432_000, 86_400), "stalls")


@query("t11_control_loss_grace", f"""WITH {WM_SQL},
    l AS (SELECT c.* FROM v_ctrl c, wm WHERE event_type = 'error'
          AND (floor(epoch(ts) / 3600) + 2) * 3600 <= epoch(wm)),
    m AS (SELECT l.agent, l.event_id, min(r.ts) AS back FROM l LEFT JOIN (SELECT * FROM v_ctrl WHERE event_type = 'signup') r
          ON l.agent = r.agent AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 1 HOUR GROUP BY ALL)
    SELECT agent, event_id, CASE WHEN back IS NULL THEN 'control_lost' ELSE 'recovered' END AS outcome,
           epoch_us(back) AS recovered_us FROM m""")
def control_loss_grace(v: Views):
    events = _ticks(v).filter(F.col("event_type").isin("error", "signup")).select(
        F.col("session_id").alias("agent"), "event_id", "ts", (F.col("event_type") == "error").alias("lost")
    )
    return grace.control_loss_grace(events, scratch_path(v.spark, "grace"), "agent", 3600, delay_s=600)


@query("t13_progress_state", """
    SELECT session_id, arg_max(bytes, (ts, event_id)) AS objects_sent, arg_max(bytes * 2, (ts, event_id))
           AS total_objects, bool_or(event_id % 37 = 0) AS walk_complete FROM v_ticks GROUP BY session_id""")
def progress_state(v: Views):
    reports = _ticks(v).select(
        "session_id", "ts", "event_id", F.col("bytes").alias("objects_sent"),
        (F.col("bytes") * 2).alias("total_objects"), (F.col("event_id") % 37 == 0).alias("walk_complete"),
    )
    spans = windows.progress_state(reports, ["ts", "event_id"], "1 day")
    done = sinks.run_updates(spans, scratch_path(v.spark, "progress"), ["window", "session_id"])
    return windows.current(done, ["session_id"], ("walk_complete",))


@query("t14_slot_state", """
    SELECT session_id, slot, arg_max(CASE event_type WHEN 'click' THEN 'receiving' WHEN 'signup' THEN 'receiving'
        WHEN 'view' THEN 'idle' WHEN 'error' THEN 'disconnected' ELSE 'disabled' END, (ts, event_id)) AS slot_status
    FROM v_ticks GROUP BY ALL""")
def slot_state(v: Views):
    kind = F.col("event_type")
    event = (
        F.when(kind == "click", "connect").when(kind == "signup", "resume").when(kind == "view", "park")
        .when(kind == "error", "disconnect").otherwise("disable")
    )
    spans = windows.slot_state(_ticks(v).withColumn("event", event), ["ts", "event_id"], "1 day")
    done = sinks.run_updates(spans, scratch_path(v.spark, "slots"), ["window", "session_id", "slot"])
    return windows.current(done, ["session_id", "slot"])


@query("t15_phase_state", """
    SELECT session_id, arg_max(CASE event_type WHEN 'click' THEN 'receiving' WHEN 'signup' THEN 'assembling'
        WHEN 'view' THEN 'verifying' WHEN 'error' THEN 'failed' ELSE 'done' END, (ts, event_id)) AS phase
    FROM v_ticks GROUP BY ALL""")
def phase_state(v: Views):
    kind = F.col("event_type")
    phase = (
        F.when(kind == "click", "receiving").when(kind == "signup", "assembling").when(kind == "view", "verifying")
        .when(kind == "error", "failed").otherwise("done")
    )
    spans = windows.phase_state(_ticks(v).withColumn("phase", phase), ["ts", "event_id"], "1 day")
    done = sinks.run_updates(spans, scratch_path(v.spark, "phases"), ["window", "session_id"])
    return windows.current(done, ["session_id"])


@query("t16_session_end_fanout", """
    SELECT 'history' AS sink, result AS kind, count(*) AS n FROM v_history GROUP BY ALL UNION ALL
    SELECT 'events', CASE WHEN result = 'ok' THEN 'info' ELSE 'error' END, count(*) FROM v_history GROUP BY ALL""")
def session_end_fanout(v: Views):
    status = F.col("o_orderstatus")
    ended = _stream(v, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("agent"),
        F.when(status == "F", "ok").when(status == "O", "write_error").otherwise("checksum_mismatch").alias("result"),
        F.col("o_orderdate").cast("timestamp").alias("finished_at"),
    )
    history, events = scratch_path(v.spark, "history"), scratch_path(v.spark, "session-events")
    sinks.session_end_fanout(ended, history, events)
    counted = [
        v.spark.read.parquet(path).groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("sink"), "kind", "n")
        for name, path, column in (("history", history, "result"), ("events", events, "level"))
    ]
    return counted[0].unionByName(counted[1])
