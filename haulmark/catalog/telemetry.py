"""Queries on telemetry: rates, sessions, streams, jobs, agents, buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query, rounded
from haulmark.functions import progress, status
from haulmark.operators import locks, lookups, mirroring, rollups, tails, timeline
from haulmark.operators.slices import sequence_slice, time_slice

DAY = 86_400
AS_OF = "2024-01-31"
JOBS_AS_OF_S = 900_000_000
# The sample feed is sparse: spans of seconds in production are hours here.
TICK_KEYS, TICK_ORDER = ["session_id", "slot"], ["ts", "event_id"]
OVER_SLOT = "(PARTITION BY session_id, slot ORDER BY ts, event_id)"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def day(column: str = "ts"):
    return time_slice(column, DAY)


@query("w7_counter_delta_rate", f"""
    WITH p AS (SELECT event_id, bytes, lag(bytes) OVER {OVER_SLOT} AS before FROM v_ticks)
    SELECT event_id, CASE WHEN before IS NOT NULL THEN round(greatest(bytes - before, 0) / 2.0 / 1048576, 6) END
           AS rate_mbps FROM p""")
def counter_delta_rate(v: Views):
    rated = timeline.counter_delta_rate(v.ticks(), TICK_KEYS, TICK_ORDER, day(), "bytes", 2)
    return rated.select("event_id", rounded("rate_mbps", 6).alias("rate_mbps"))


@query("w8_ewma", """
    WITH l AS (SELECT event_id, list(bytes / 1048576.0) OVER (PARTITION BY session_id ORDER BY ts, event_id
               ROWS UNBOUNDED PRECEDING) AS xs FROM v_ticks)
    SELECT event_id, round(list_reduce(xs, lambda a, x: a + 0.28 * (x - a)), 5) AS smoothed FROM l""")
def ewma(v: Views):
    ticks = v.ticks().withColumn("mb", F.col("bytes") / timeline.MIB)
    smoothed = timeline.ewma(ticks, ["session_id"], TICK_ORDER, day(), "mb")
    return smoothed.select("event_id", rounded("smoothed", 5).alias("smoothed"))


BANDS_SQL = """b AS (SELECT *, CASE WHEN producer_bps / drain_bps > 1.0 THEN 'scale_up'
        WHEN producer_bps / drain_bps < 0.7 THEN 'scale_down' ELSE 'stable' END AS decision
        FROM v_rates WHERE drain_bps > 0 AND active > 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY hour_no) AS n,
          row_number() OVER (PARTITION BY agent, decision ORDER BY hour_no) AS m FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY agent, decision, n - m ORDER BY hour_no) AS pos FROM c)"""


@query("w9_hysteresis_events", f"""WITH {BANDS_SQL}
    SELECT agent, hour_no, decision FROM d WHERE decision <> 'stable' AND pos % 3 = 0""")
def hysteresis_events(v: Views):
    fired = timeline.hysteresis_events(v.rates(), ["agent"], ["hour_no"], sequence_slice("hour_no", 24))
    return fired.select("agent", "hour_no", "decision")


@query("w10_probe_gain", """
    WITH t AS (SELECT agent, hour_no, producer_bps + drain_bps AS baseline, lead(producer_bps + drain_bps, 3)
               OVER (PARTITION BY agent ORDER BY hour_no) AS later FROM v_rates)
    SELECT agent, hour_no, round(CASE WHEN baseline > 0 THEN (later - baseline) / baseline ELSE 0 END, 5) AS gain,
           CASE WHEN baseline > 0 THEN (later - baseline) / baseline ELSE 0 END >= 0.05 AS keep
    FROM t WHERE later IS NOT NULL""")
def probe_gain(v: Views):
    gains = timeline.probe_gain(v.rates(), ["agent"], ["hour_no"], sequence_slice("hour_no", 24))
    return gains.select("agent", "hour_no", rounded("gain", 5).alias("gain"), "keep")


SLOW_SQL = """t AS (SELECT session_id, slot, ts, event_id, bytes % 40 * 0.05 AS rate FROM v_ticks),
    s AS (SELECT *, rate > 0 AND rate < 1.0 AS slow, row_number() OVER (PARTITION BY session_id, slot
          ORDER BY ts, event_id) - row_number() OVER (PARTITION BY session_id, slot, rate > 0 AND rate < 1.0
          ORDER BY ts, event_id) AS run FROM t)"""


@query("w11_slow_periods", f"""WITH {SLOW_SQL}
    SELECT session_id, slot, epoch_us(min(ts)) AS since_us, epoch_us(max(ts)) AS until_us, count(*) AS ticks,
           CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration_s
    FROM s WHERE slow GROUP BY session_id, slot, run""")
def slow_periods(v: Views):
    ticks = v.ticks().withColumn("rate", F.col("bytes") % 40 * 0.05)
    periods = timeline.slow_periods(ticks, TICK_KEYS, TICK_ORDER, day(), "ts", "rate")
    return periods.select(
        "session_id", "slot", F.unix_micros("slow_since").alias("since_us"),
        F.unix_micros("slow_until").alias("until_us"), "ticks", "duration_s",
    )


@query("w12_latest_per_key", """
    SELECT session_id, slot, event_id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_id, slot
        ORDER BY ts DESC, event_id DESC) AS rn FROM v_ticks) WHERE rn = 1""")
def latest_per_key(v: Views):
    return timeline.latest_per_key(v.ticks(), TICK_KEYS, TICK_ORDER).select("session_id", "slot", "event_id", "bytes")


def _joins(v: Views):
    return v.ticks().withColumn("rotation", F.col("event_type").isin("view", "purchase"))


JOINS_SQL = f"""j AS (SELECT *, event_type IN ('view', 'purchase') AS rotation,
    row_number() OVER {OVER_SLOT} AS n FROM v_ticks)"""


@query("w13_reconnect_ordinal", f"""WITH {JOINS_SQL}
    SELECT event_id, count(*) FILTER (n > 1 AND rotation) OVER w AS rotation_no,
           count(*) FILTER (n > 1 AND NOT rotation) OVER w AS reconnect_no
    FROM j WINDOW w AS (PARTITION BY session_id, slot ORDER BY n)""")
def reconnect_ordinal(v: Views):
    return timeline.reconnect_ordinals(_joins(v), TICK_KEYS, TICK_ORDER, day()).select(
        "event_id", "rotation_no", "reconnect_no"
    )


@query("a23_reconnect_counts", f"""WITH {JOINS_SQL}
    SELECT session_id, slot, count(*) FILTER (n > 1 AND rotation) AS rotations,
           count(*) FILTER (n > 1 AND NOT rotation) AS reconnects FROM j GROUP BY session_id, slot""")
def reconnect_counts(v: Views):
    return timeline.reconnect_counts(_joins(v), TICK_KEYS, TICK_ORDER)


@query("w14_idle_gap", f"""
    SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER {OVER_SLOT} AS idle_us FROM v_ticks""")
def idle_gap(v: Views):
    return timeline.idle_gap(v.ticks(), TICK_KEYS, TICK_ORDER, day(), "ts").select("event_id", "idle_us")


@query("w14_idle_since", f"""
    SELECT session_id, slot, CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts))) AS BIGINT) AS idle_secs
    FROM v_ticks GROUP BY ALL""")
def idle_since(v: Views):
    return timeline.idle_since(v.ticks(), TICK_KEYS, "ts", as_of()).drop("last_activity")


@query("o1_recent", """
    SELECT event_id, session_id FROM v_ticks ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def recent(v: Views):
    return tails.recent(v.ticks(), 1000, TICK_ORDER).select("event_id", "session_id")


@query("o2_recent_per_key", """
    SELECT event_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC,
        event_id DESC) AS rn FROM v_ticks) WHERE rn <= 18""")
def recent_per_key(v: Views):
    return timeline.recent_per_key(v.ticks(), ["session_id"], TICK_ORDER, day(), 18).select("event_id", "session_id")


@query("o3_trim_store", """
    SELECT event_id FROM v_ticks ORDER BY ts DESC, event_id DESC
    LIMIT (SELECT CASE WHEN count(*) > 2000 THEN 1000 ELSE count(*) END FROM v_ticks)""")
def trim_store(v: Views):
    return tails.trim_store(v.ticks(), 2000, TICK_ORDER).select("event_id")


@query("o4_ordered_listing", "SELECT storage, rel_path FROM v_backups ORDER BY rel_path")
def ordered_listing(v: Views):
    return tails.ordered_listing(v.backups().select("storage", "rel_path"), ["rel_path"])


@query("o5_newest_first_view", """
    SELECT session_id, bucket_name, success FROM v_uploads ORDER BY timestamp DESC, session_id DESC""")
def newest_first_view(v: Views):
    return tails.newest_first_view(v.uploads(), ["timestamp", "session_id"]).select(
        "session_id", "bucket_name", "success"
    )


@query("o6_stream_display_order", """
    SELECT session_id, slot, CAST(row_number() OVER (PARTITION BY session_id ORDER BY CASE slot_status
        WHEN 'disconnected' THEN 2 WHEN 'disabled' THEN 1 ELSE 0 END, slot) AS INTEGER) AS position FROM v_streams""")
def stream_display_order(v: Views):
    return rollups.stream_display_order(v.streams()).select("session_id", "slot", "position")


@query("f5_filter_session", """
    SELECT event_id, bytes FROM v_ticks WHERE session_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20""")
def filter_session(v: Views):
    return tails.filter_session(v.ticks(), 7, 20, TICK_ORDER).select("event_id", "bytes")


@query("j4_agents_with_session", """
    WITH a AS (SELECT s_suppkey AS agent, client_version FROM v_agents),
         s AS (SELECT agent, min(session_id) AS sid FROM v_history GROUP BY agent)
    SELECT a.agent, s.sid IS NOT NULL AS has_session, CASE WHEN s.sid % 2 = 0 THEN 'v5.' || s.sid % 10
           ELSE a.client_version END AS client_version FROM a LEFT JOIN s ON a.agent = s.agent""")
def agents_with_session(v: Views):
    agents = v.agents().select(F.col("s_suppkey").alias("agent"), "client_version")
    own = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("v5."), (F.col("session_id") % 10).cast("string")))
    sessions = v.history().withColumn("client_version", F.coalesce(own, F.lit("")))
    return rollups.agents_with_session(agents, sessions)


@query("j5_latest_stats_asof", """
    WITH st AS (SELECT user_id % 10 AS agent, ts, event_id, CAST(floor(value) AS BIGINT) AS cpu FROM events
                WHERE event_type = 'view')
    SELECT t.event_id, arg_max(st.cpu, (st.ts, st.event_id)) AS cpu
    FROM (SELECT * FROM v_ticks WHERE event_type = 'error') t
    LEFT JOIN st ON st.agent = t.agent AND st.ts <= t.ts GROUP BY t.event_id""")
def latest_stats_asof(v: Views):
    ticks = v.ticks()
    snapshots = ticks.filter("event_type = 'error'").select("agent", "ts", "event_id")
    stats = v.table("events").filter("event_type = 'view'").select(
        (F.col("user_id") % 10).alias("agent"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.floor("value").cast("long").alias("cpu"),
    )
    joined = timeline.latest_stats_asof(snapshots, stats, ["agent"], "ts", ["cpu"], time_slice("ts"), "event_id")
    return joined.select("event_id", "cpu")


@query("j8_grace_recovery", """
    WITH l AS (SELECT * FROM v_ctrl WHERE event_type = 'error'), r AS (SELECT * FROM v_ctrl WHERE event_type = 'signup'),
         m AS (SELECT l.event_id, min(r.ts) AS back FROM l LEFT JOIN r ON l.agent = r.agent AND r.ts >= l.ts
               AND r.ts <= l.ts + INTERVAL 1 HOUR GROUP BY l.event_id)
    SELECT event_id, epoch_us(back) AS recovered_us, CASE WHEN back IS NULL THEN 'control_lost' ELSE 'recovered' END
           AS outcome FROM m""")
def grace_recovery(v: Views):
    lost = v.ctrl().filter("event_type = 'error'")
    recovered = v.ctrl().filter("event_type = 'signup'")
    found = timeline.grace_recovery(lost, recovered, ["agent"], "ts", day(), "event_id", grace_s=3600)
    return found.select("event_id", F.unix_micros("recovered_at").alias("recovered_us"), "outcome")


@query("j9_busy_conflicts", """
    WITH RECURSIVE r AS (SELECT run_id, job, start_s, start_s + 400 * duration_s AS end_s,
            row_number() OVER (PARTITION BY job ORDER BY start_s, run_id) AS n FROM v_jobs),
        f AS (SELECT job, n, run_id, start_s, end_s AS lock_s, false AS busy FROM r WHERE n = 1
              UNION ALL
              SELECT r.job, r.n, r.run_id, r.start_s, CASE WHEN r.start_s < f.lock_s THEN f.lock_s ELSE r.end_s END,
                     r.start_s < f.lock_s
              FROM f JOIN r ON r.job = f.job AND r.n = f.n + 1)
    SELECT job, run_id, start_s FROM f WHERE busy""")
def busy_conflicts(v: Views):
    runs = v.jobs().withColumn("end_s", F.col("start_s") + 400 * F.col("duration_s"))
    return locks.busy_conflicts(runs, "job", sequence_slice("start_s", 30 * DAY))


def _addresses(v: Views):
    """Addresses of the events: IPv6 in brackets with a port, IPv4 written as IPv6, and plain IPv4."""
    group, last, kind = F.col("user_id") % 30, F.col("event_id") % 256, F.col("event_id") % 3
    hexed = lambda n: F.lower(F.hex(n))
    v4 = F.concat_ws(".", F.lit("10"), group.cast("string"), last.cast("string"), F.lit("7"))
    v6 = F.concat(F.lit("[2001:db8:"), hexed(group), F.lit(":"), hexed(last), F.lit("::7]:9847"))
    address = F.when(kind == 0, v6).when(kind == 1, F.concat(F.lit("::ffff:"), v4)).otherwise(v4)
    return v.table("events").select("event_id", address.alias("addr"))


@query("j10_ip_range_semi", """
    SELECT event_id FROM events WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = user_id % 30
        AND (n_nationkey % 4 = 0 OR event_id % 256 < 64))""")
def ip_range_semi(v: Views):
    """Networks of all nations in both families: whole ones of 16 and 48 bits, and quarters of 18 and 58."""
    key, whole = F.col("n_nationkey"), F.col("n_nationkey") % 4 == 0
    v4 = F.concat(F.lit("10."), key.cast("string"), F.lit(".0.0/"), F.when(whole, "16").otherwise("18"))
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(key)), F.when(whole, "::/48").otherwise(":0::/58"))
    ranges = v.table("nation").select(F.explode(F.array(v4, v6)).alias("cidr"))
    return lookups.ip_range_semi(_addresses(v), ranges).select("event_id")


def _sessions(v: Views):
    """Sessions of the tick feed with the progress figures the rollups need."""
    key = F.col("session_id")
    return v.ticks().select("session_id").distinct().select(
        "session_id",
        F.when(key % 2 == 0, "parallel").otherwise("single").alias("mode"),
        (key % 7 * 100).alias("objects_sent"), F.lit(500).alias("total_objects"),
        (key % 3 != 0).alias("walk_complete"), (key + 10).alias("elapsed_s"), (key % 11 == 0).alias("closing"),
        F.when(key % 5 == 0, "assembling").otherwise("receiving").alias("phase"),
        (key * 1000).alias("bytes_received"), F.timestamp_micros(F.unix_micros(as_of()) - key * 1_000_000).alias("last_activity"),
    )


SESSION_SQL = f"""s AS (SELECT DISTINCT session_id, session_id % 7 * 100 AS sent, session_id % 3 <> 0 AS walked,
        session_id + 10 AS elapsed_s, session_id % 11 = 0 AS closing,
        CASE WHEN session_id % 5 = 0 THEN 'assembling' ELSE 'receiving' END AS phase, session_id % 2 = 1 AS single,
        epoch_us(TIMESTAMP '{AS_OF}') - session_id * 1000000 AS own_last FROM v_ticks),
    g AS (SELECT session_id, CAST(sum("offset") AS BIGINT) AS bytes_received, count(*) FILTER (slot_status = 'receiving')
          AS active_streams, max(last_activity) AS last FROM v_streams GROUP BY session_id),
    e AS (SELECT s.*, CASE WHEN single THEN s.session_id * 1000 ELSE coalesce(g.bytes_received, 0) END AS bytes_received,
          CASE WHEN single THEN 1 ELSE coalesce(g.active_streams, 0) END AS active_streams,
          (epoch_us(TIMESTAMP '{AS_OF}') - coalesce(epoch_us(g.last), own_last)) / 1000000.0 AS idle,
          CASE WHEN walked AND sent >= 500 THEN 0 WHEN walked AND sent > 0
               THEN CAST(floor((500 - sent) / (sent / elapsed_s)) AS BIGINT) END AS eta_s
          FROM s LEFT JOIN g ON s.session_id = g.session_id),
    summary AS (SELECT session_id, bytes_received, active_streams, phase,
          CASE WHEN closing THEN 'finalizing' WHEN idle < 10 THEN 'running' WHEN idle < 60 THEN 'idle'
               ELSE 'degraded' END AS status,
          CASE WHEN eta_s IS NULL THEN '∞' ELSE
               CASE WHEN eta_s >= 3600 THEN eta_s // 3600 || 'h' ELSE '' END ||
               CASE WHEN eta_s >= 60 THEN eta_s % 3600 // 60 || 'm' ELSE '' END || eta_s % 60 || 's' END AS eta FROM e)"""


@query("a6_metrics_snapshot", """
    WITH g AS (SELECT session_id, count(*) FILTER (slot_status IN ('receiving', 'idle')) AS n FROM v_streams
               GROUP BY session_id)
    SELECT count(*) AS sessions, count(*) FILTER (session_id % 2 = 1) AS single_sessions,
           count(*) FILTER (session_id % 2 = 0) AS parallel_sessions,
           CAST(sum(CASE WHEN session_id % 2 = 0 THEN n ELSE 1 END) AS BIGINT) AS active_streams,
           (SELECT count(*) FROM v_agents) AS connected_agents, 2 * (SELECT count(*) FROM v_agents) AS active_conns
    FROM g""")
def metrics_snapshot(v: Views):
    return rollups.metrics_snapshot(_moded(v), v.agents(), F.count("*") * 2)


def _moded(v: Views):
    active = v.streams().groupBy("session_id").agg(
        F.count_if(F.col("slot_status").isin("receiving", "idle")).alias("active_streams")
    )
    single = active.filter("session_id % 2 = 1").select("session_id")
    parallel = active.filter("session_id % 2 = 0")
    return rollups.active_single_plus_parallel(single, parallel)


@query("u3_active_single_plus_parallel", """
    SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'parallel' ELSE 'single' END AS mode,
           CASE WHEN session_id % 2 = 0 THEN count(*) FILTER (slot_status IN ('receiving', 'idle')) END
               AS active_streams FROM v_streams GROUP BY session_id""")
def active_single_plus_parallel(v: Views):
    return _moded(v)


@query("u4_prune_inactive_keys", """
    SELECT event_id FROM v_ticks WHERE session_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def prune_inactive_keys(v: Views):
    active = v.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("session_id"))
    return rollups.prune_inactive_keys(v.ticks(), active, "session_id").select("event_id")


@query("a7_session_summary", f"WITH {SESSION_SQL} SELECT * FROM summary")
def session_summary(v: Views):
    return rollups.session_summary(_sessions(v), v.streams(), as_of()).drop("last_activity")


@query("a8_session_detail", f"""WITH {SESSION_SQL},
    n AS (SELECT session_id, string_agg(slot || ':' || "offset" || ':' || slot_status, ',' ORDER BY slot) AS streams,
          round(sum("offset" / 15 / 1048576), 4) AS total_mbps FROM v_streams GROUP BY session_id)
    SELECT * FROM summary LEFT JOIN n USING (session_id)""")
def session_detail(v: Views):
    streams = v.streams().withColumn("mbps", progress.mbps("offset", F.lit(15)))
    detail = rollups.session_detail(_sessions(v), streams, as_of()).drop("last_activity")
    text = F.transform("streams", lambda s: F.concat_ws(":", s["slot"], s["offset"], s["slot_status"]))
    return detail.withColumns({"streams": F.array_join(text, ","), "total_mbps": rounded("total_mbps", 4)})


JOB_SQL = f"""g AS (SELECT job, CASE WHEN bool_or(start_s <= {JOBS_AS_OF_S} AND start_s + duration_s > {JOBS_AS_OF_S})
        THEN 'running' ELSE 'idle' END AS status, count(*) FILTER (start_s + duration_s <= {JOBS_AS_OF_S})
        AS finished_runs, arg_max(status, (start_s + duration_s, run_id)) FILTER (start_s + duration_s <= {JOBS_AS_OF_S})
        AS last_status, arg_max(duration_s, (start_s + duration_s, run_id))
        FILTER (start_s + duration_s <= {JOBS_AS_OF_S}) AS last_duration_s,
        min(start_s) FILTER (start_s > {JOBS_AS_OF_S}) AS next_start_s FROM v_jobs GROUP BY job)"""


@query("a11_job_report", f"WITH {JOB_SQL} SELECT * FROM g")
def job_report(v: Views):
    return rollups.job_report(v.jobs(), JOBS_AS_OF_S)


@query("a11_next_run", f"""WITH {JOB_SQL} SELECT job, next_start_s FROM g WHERE next_start_s IS NOT NULL
    ORDER BY next_start_s, job LIMIT 1""")
def next_run(v: Views):
    return rollups.next_run(rollups.job_report(v.jobs(), JOBS_AS_OF_S))


@query("a17_compression_ratio", """
    SELECT session_id, CASE WHEN total > 0 AND done > 0 THEN round(done / total * 100, 4) END AS ratio FROM v_progress""")
def compression_ratio(v: Views):
    return v.progress().select("session_id", rounded(progress.compression_ratio("done", "total"), 4).alias("ratio"))


@query("a18_upload_throughput", """
    SELECT session_id, bucket_name, round(bytes / duration_s / 1048576, 6) AS mbps FROM v_uploads""")
def upload_throughput(v: Views):
    return rollups.upload_throughput(v.uploads()).select("session_id", "bucket_name", rounded("mbps", 6).alias("mbps"))


@query("a19_streams_slow_hint", """
    WITH x AS (SELECT session_id, slot <> 2 AS active, CASE WHEN "offset" % 2 = 0 THEN 'slow' ELSE 'running' END AS st,
               ticks % 12 AS idle FROM v_streams)
    SELECT session_id, count(*) FILTER (active AND st = 'slow') AS slow_streams,
           count(*) FILTER (active) AS active_streams
    FROM x GROUP BY session_id HAVING count(*) FILTER (active AND st = 'slow') > 0
        AND count(*) FILTER (active AND st = 'slow' AND idle >= 10) = 0""")
def streams_slow_hint(v: Views):
    streams = v.streams().withColumns({
        "active": F.col("slot") != 2,
        "status": F.when(F.col("offset") % 2 == 0, "slow").otherwise("running"),
        "idle_secs": F.col("ticks") % 12,
    })
    return rollups.streams_slow_hint(streams)


def _buffer_events(v: Views):
    kind = F.col("event_type")
    return v.ticks().select(
        "event_id", "session_id", "ts", (F.col("bytes") + 0).alias("bytes"), F.lit("server").alias("buffer"),
        F.when(kind.isin("click", "view"), "push").when(kind.isin("purchase", "signup"), "drain")
        .when(F.col("event_id") % 2 == 0, "fallback").otherwise("backpressure").alias("kind"),
    )


BUFFER_SQL = """b AS (SELECT event_id, session_id, ts, bytes, CASE WHEN event_type IN ('click', 'view') THEN 'push'
    WHEN event_type IN ('purchase', 'signup') THEN 'drain' WHEN event_id % 2 = 0 THEN 'fallback' ELSE 'backpressure'
    END AS kind, CASE WHEN event_type IN ('click', 'view') THEN bytes WHEN event_type IN ('purchase', 'signup')
    THEN -bytes ELSE 0 END AS change FROM v_ticks)"""


@query("a20_prometheus_rows", f"""
    WITH g AS (SELECT session_id, count(*) FILTER (slot_status IN ('receiving', 'idle')) AS n FROM v_streams
               GROUP BY session_id),
         t AS (SELECT count(*) AS sessions, count(*) FILTER (session_id % 2 = 1) AS single,
               count(*) FILTER (session_id % 2 = 0) AS par, sum(CASE WHEN session_id % 2 = 0 THEN n ELSE 1 END) AS act,
               (SELECT count(*) FROM v_agents) AS agents FROM g), {BUFFER_SQL},
         c AS (SELECT kind, count(*) AS n FROM b GROUP BY kind)
    SELECT 'server_' || name AS name, labels, CAST(value AS DOUBLE) AS value, type FROM (
        SELECT 'active_connections' AS name, '' AS labels, 2 * agents AS value, 'gauge' AS type FROM t
        UNION ALL SELECT 'active_sessions', '', sessions, 'gauge' FROM t
        UNION ALL SELECT 'active_sessions_by_mode', 'mode="single"', single, 'gauge' FROM t
        UNION ALL SELECT 'active_sessions_by_mode', 'mode="parallel"', par, 'gauge' FROM t
        UNION ALL SELECT 'active_streams', '', act, 'gauge' FROM t
        UNION ALL SELECT 'connected_agents', '', agents, 'gauge' FROM t
        UNION ALL SELECT 'chunk_buffer_capacity_bytes', '', 1099511627776, 'gauge'
        UNION ALL SELECT 'chunk_buffer_in_flight_bytes', '', sum(change), 'gauge' FROM b
        UNION ALL SELECT 'chunk_buffer_fill_ratio', '', sum(change) / 1099511627776.0, 'gauge' FROM b
        UNION ALL SELECT CASE kind WHEN 'push' THEN 'chunk_buffer_total_pushed_total'
            WHEN 'drain' THEN 'chunk_buffer_total_drained_total' WHEN 'fallback' THEN 'chunk_buffer_fallbacks_total'
            ELSE 'chunk_buffer_backpressure_events_total' END, '', n, 'counter' FROM c
        UNION ALL SELECT 'sync_files_uploaded_total', '', count(*) FILTER (success), 'gauge' FROM v_uploads
        UNION ALL SELECT 'sync_files_skipped_total', '', 0, 'gauge'
        UNION ALL SELECT 'sync_files_errors_total', '', count(*) FILTER (NOT success), 'gauge' FROM v_uploads)""")
def prometheus_rows(v: Views):
    snapshot = rollups.metrics_snapshot(_moded(v), v.agents(), F.count("*") * 2)
    kind = F.col("kind")
    change = F.when(kind == "push", F.col("bytes")).when(kind == "drain", -F.col("bytes")).otherwise(0)
    totals = _buffer_events(v).agg(
        F.lit(1 << 40).alias("capacity_bytes"), F.sum(change).alias("in_flight_bytes"),
        (F.sum(change) / F.lit(float(1 << 40))).alias("fill_ratio"), F.count_if(kind == "push").alias("pushed"),
        F.count_if(kind == "drain").alias("drained"), F.count_if(kind == "fallback").alias("fallbacks"),
        F.count_if(kind == "backpressure").alias("backpressure_events"),
    )
    outcome = F.when(F.col("success"), "uploaded").otherwise("error")
    synced = mirroring.sync_result(
        v.uploads().select("storage", F.col("bucket_name").alias("bucket"), outcome.alias("outcome"))
    ).filter(F.col("storage").isNull())
    return (
        rollups.metric_rows(snapshot).unionByName(rollups.buffer_metric_rows(totals))
        .unionByName(rollups.sync_metric_rows(synced))
    )


@query("a21_buffer_stats", f"""WITH {BUFFER_SQL},
    w AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) FILTER (kind = 'push') AS pushed,
          count(*) FILTER (kind = 'drain') AS drained, count(*) FILTER (kind = 'fallback') AS fallbacks,
          count(*) FILTER (kind = 'backpressure') AS backpressure_events FROM b GROUP BY ALL)
    SELECT *, greatest(0, pushed - drained) AS pending, round(drained / 3600, 8) AS drain_rate_mbps FROM w""")
def buffer_stats(v: Views):
    stats = timeline.buffer_stats(_buffer_events(v), "ts", "1 hour")
    return stats.select(
        F.unix_micros("window.start").alias("start_us"), "pushed", "drained", "fallbacks", "backpressure_events",
        "pending", rounded("drain_rate_mbps", 8).alias("drain_rate_mbps"),
    )


@query("a21_session_in_flight", f"""WITH {BUFFER_SQL},
    n AS (SELECT session_id, CAST(greatest(0, sum(change)) AS BIGINT) AS held FROM b GROUP BY session_id)
    SELECT session_id, held AS in_flight_bytes, round(held * 100.0 / 1099511627776, 6) AS fill_percent FROM n""")
def session_in_flight(v: Views):
    return timeline.session_in_flight(_buffer_events(v), 1 << 40).withColumn(
        "fill_percent", rounded("fill_percent", 6)
    )


@query("t9_buffer_pressure", f"""WITH {BUFFER_SQL},
    l AS (SELECT event_id, CAST(sum(change) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
          AS in_flight_bytes FROM b)
    SELECT event_id, in_flight_bytes, in_flight_bytes / 17179869184.0 >= 0.5 AS drain_due FROM l""")
def buffer_pressure(v: Views):
    return timeline.buffer_pressure(_buffer_events(v), TICK_ORDER, time_slice("ts"), 1 << 34).select(
        "event_id", "in_flight_bytes", "drain_due"
    )


@query("t10_missed_heartbeats", """
    WITH g AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM v_ticks)
    SELECT session_id, epoch_us(prev) + 4500000000 AS lost_us, epoch_us(ts) AS back_us
    FROM g WHERE epoch_us(ts) - epoch_us(prev) > 4500000000
    UNION ALL SELECT session_id, epoch_us(max(ts)) + 4500000000, NULL FROM v_ticks GROUP BY session_id
    HAVING epoch_us(TIMESTAMP '""" + AS_OF + """') - epoch_us(max(ts)) > 4500000000""")
def missed_heartbeats(v: Views):
    lost = timeline.missed_heartbeats(v.ticks(), ["session_id"], TICK_ORDER, day(), "ts", 1800, as_of=as_of())
    return lost.select("session_id", F.unix_micros("lost_at").alias("lost_us"), F.unix_micros("back_at").alias("back_us"))


@query("t12_stall_detect", """
    WITH p AS (SELECT event_id, session_id, ts, bytes AS progress, max(bytes) OVER (PARTITION BY session_id
               ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v_ticks),
         q AS (SELECT *, max(CASE WHEN best IS NULL OR progress > best THEN ts END) OVER (PARTITION BY session_id
               ORDER BY ts, event_id) AS moved, min(ts) OVER (PARTITION BY session_id) AS begun FROM p),
         r AS (SELECT *, CAST(floor(epoch(ts)) - floor(epoch(moved)) AS BIGINT) AS idle_s,
               CAST(floor(epoch(ts)) - floor(epoch(begun)) AS BIGINT) AS age_s FROM q)
    SELECT event_id, idle_s, CASE WHEN age_s >= 1728000 THEN 'timeout' ELSE 'stalled' END AS reason
    FROM r WHERE idle_s >= 432000 OR age_s >= 1728000""")
def stall_detect(v: Views):
    """Five days without growth, twenty days in all, as the sample feed is sparse."""
    stalled = timeline.stall_detect(
        v.ticks(), ["session_id"], TICK_ORDER, day(), "ts", F.col("bytes"), 5 * DAY, 20 * DAY
    )
    return stalled.select("event_id", "idle_s", "reason")


@query("a22_event_counts", """
    SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'info' END AS level,
           event_type AS type, agent, count(*) AS events FROM v_ticks GROUP BY ALL""")
def event_counts(v: Views):
    raw = F.when(F.col("event_type") == "view", "warning").otherwise(F.col("event_type"))
    events = v.ticks().withColumns({"level": status.normalize_level(raw), "type": F.col("event_type")})
    return rollups.event_counts(events, ["level", "type", "agent"])


@query("k10_object_progress", """
    WITH t AS (SELECT o_custkey AS session_id, count(*) AS total_objects FROM orders GROUP BY o_custkey)
    SELECT t.session_id, total_objects, coalesce(total_objects * (p.session_id % 11) // 10, 0) AS objects_sent,
           round(coalesce(total_objects * (p.session_id % 11) // 10, 0) * 100.0 / total_objects, 4) AS progress_pct,
           CASE WHEN walk_complete THEN CASE WHEN total_objects * (p.session_id % 11) // 10 >= total_objects THEN 0
                WHEN total_objects * (p.session_id % 11) // 10 > 0 THEN CAST(floor((total_objects - total_objects *
                (p.session_id % 11) // 10) / ((total_objects * (p.session_id % 11) // 10) / elapsed_s)) AS BIGINT) END END
                AS eta_s
    FROM t LEFT JOIN v_progress p ON t.session_id = p.session_id AND t.session_id % 13 <> 0""")
def object_progress(v: Views):
    totals = v.table("orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.count("*").alias("total_objects"))
    sent = F.floor(F.col("total_objects") * (F.col("session_id") % 11) / 10).cast("long")
    reported = v.progress().filter("session_id % 13 <> 0")  # the others have sent nothing yet
    latest = reported.select("session_id", "walk_complete", "elapsed_s").join(totals, "session_id").select(
        "session_id", "walk_complete", "elapsed_s", sent.alias("objects_sent")
    )
    return rollups.object_progress(totals, latest).withColumn("progress_pct", rounded("progress_pct", 4))
