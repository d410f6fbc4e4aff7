"""Queries for scalar functions, predicates and filters, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query, rounded
from haulmark.functions import network, paths, progress, sizes, status
from haulmark.operators import inventory, mirroring

EXCLUDES = ["*.log", "src1/*/doc-?.txt", "de/**", "*/fr/", "doc-[0-4]*.tar.gz"]


def size_texts(v: Views):
    """Size texts in every form the parser knows, some of them malformed."""
    number, key = F.col("n_chars").cast("string"), F.col("doc_id") % 8
    return v.table("documents").select(
        "doc_id",
        F.when(key == 0, F.concat(number, F.lit("gb"))).when(key == 1, F.concat(F.lit(" "), number, F.lit("MB ")))
        .when(key == 2, F.concat(number, F.lit("Kb"))).when(key == 3, F.concat(number, F.lit("b")))
        .when(key == 4, number).when(key == 5, F.concat(number, F.lit(" mb")))
        .when(key == 6, F.concat(number, F.lit(".5gb"))).otherwise("").alias("size_text"),
    )


@query("x1_parse_byte_size", """
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN n_chars * 1073741824 WHEN 1 THEN n_chars * 1048576
                   WHEN 2 THEN n_chars * 1024 WHEN 3 THEN n_chars WHEN 4 THEN n_chars END AS bytes FROM documents""")
def parse_byte_size(v: Views):
    return size_texts(v).select("doc_id", sizes.parse_byte_size("size_text").alias("bytes"))


def _bytes(v: Views):
    """Byte counts from a few to many terabytes."""
    scale = F.element_at(
        F.array(*[F.lit(x).cast("long") for x in (0, 1, 999, 1 << 20, 7_777_777, 1 << 34, 99_999_999_999)]),
        (F.col("o_orderkey") % 7 + 1).cast("int"),
    )
    return v.table("orders").select("o_orderkey", (F.floor("o_totalprice").cast("long") * scale).alias("b"))


BYTES_SQL = """WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 7 WHEN 0 THEN 0
    WHEN 1 THEN 1 WHEN 2 THEN 999 WHEN 3 THEN 1048576 WHEN 4 THEN 7777777 WHEN 5 THEN 17179869184
    ELSE 99999999999 END AS b FROM orders) """


def _units_sql(units: list[str], fmt: str, value: str = "b / {p}.0") -> str:
    cases = []
    for power in range(len(units), 0, -1):
        amount = value.format(p=1024**power)
        cases.append(f"WHEN b >= {1024**power} THEN printf('{fmt} {units[power - 1]}', {amount})")
    return "CASE " + " ".join(cases) + " ELSE b || ' B' END"


@query("x2_format_bytes_short", BYTES_SQL + f"SELECT o_orderkey, {_units_sql(['KB', 'MB', 'GB'], '%.1f')} AS t FROM x")
def format_bytes_short(v: Views):
    return _bytes(v).select("o_orderkey", sizes.format_bytes_short("b").alias("t"))


@query("x3_format_bytes_si", BYTES_SQL
       + f"SELECT o_orderkey, {_units_sql(['KB', 'MB', 'GB', 'TB', 'PB', 'EB'], '%.1f')} AS t FROM x")
def format_bytes_si(v: Views):
    return _bytes(v).select("o_orderkey", sizes.format_bytes_si("b").alias("t"))


@query("x4_human_size", BYTES_SQL
       + f"SELECT o_orderkey, {_units_sql(['KB', 'MB', 'GB', 'TB'], '%.2f')} AS t FROM x")
def human_size(v: Views):
    return _bytes(v).select("o_orderkey", sizes.human_size("b").alias("t"))


@query("x5_format_bytes_ui", BYTES_SQL + "SELECT o_orderkey, "
       + _units_sql(["KB", "MB", "GB", "TB"], "%.1f", "floor(b / {p}.0 * 10 + 0.5) / 10") + " AS t FROM x")
def format_bytes_ui(v: Views):
    return _bytes(v).select("o_orderkey", sizes.format_bytes_ui("b").alias("t"))


@query("x6_format_duration", """
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60)
                            ELSE printf('%d:%02d', s // 60, s % 60) END AS t
    FROM (SELECT o_orderkey, CAST(floor(floor(o_totalprice) / 4.0 + 0.5) AS BIGINT) % 20000 AS s FROM orders)""")
def format_duration(v: Views):
    seconds = F.floor(F.floor("o_totalprice") / 4.0 + 0.5) % 20000 + 0.25
    return v.table("orders").select("o_orderkey", sizes.format_duration(seconds).alias("t"))


@query("x7_format_elapsed", """
    SELECT o_orderkey, concat_ws(' ', CASE WHEN s >= 3600 THEN (s // 3600) || 'h' END,
           CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' END, (s % 60) || 's') AS t
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)""")
def format_elapsed(v: Views):
    return v.table("orders").select("o_orderkey", sizes.format_elapsed("o_totalprice").alias("t"))


@query("x8_format_number", BYTES_SQL + "SELECT o_orderkey, format('{:,}', b) AS t FROM x")
def format_number(v: Views):
    return _bytes(v).select("o_orderkey", sizes.format_number("b").alias("t"))


@query("x9_fmt_objects", """
    SELECT session_id, CASE WHEN total > 100 THEN format('{:,}', done) || '/' || format('{:,}', total)
                            ELSE format('{:,}', done) END AS t FROM v_progress""")
def fmt_objects(v: Views):
    known = F.when(F.col("total") > 100, F.col("total")).otherwise(0)
    return v.progress().select("session_id", sizes.fmt_objects("done", known).alias("t"))


@query("x10_go_durations", """
    SELECT o_orderkey, CAST(h * 3600 + m * 60 + s + 0.25 AS DOUBLE) AS seconds,
           concat_ws(' ', CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END,
                     CASE WHEN s > 0 OR (h = 0 AND m = 0) THEN s || 's' END) AS uptime
    FROM (SELECT o_orderkey, o_orderkey % 5 AS h, o_orderkey // 5 % 60 AS m, o_custkey % 60 AS s FROM orders)""")
def go_durations(v: Views):
    hours, minutes = F.col("o_orderkey") % 5, F.floor(F.col("o_orderkey") / 5) % 60
    text = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""),
        F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""),
        (F.col("o_custkey") % 60).cast("string"), F.lit(".25s"),
    )
    return v.table("orders").select(
        "o_orderkey", sizes.parse_go_duration(text).alias("seconds"), sizes.format_uptime(text).alias("uptime")
    )


@query("x11_eta_pessimistic", """
    WITH r AS (SELECT session_id, total * 1000 AS tb, done * 900 AS db, total AS t, done AS d,
               CASE WHEN elapsed_s >= 3 THEN done * 900.0 / elapsed_s ELSE 0 END AS bs,
               CASE WHEN elapsed_s >= 3 THEN done * 1.0 / elapsed_s ELSE 0 END AS os FROM v_progress)
    SELECT session_id, round(CASE WHEN (tb > 0 OR t > 0) AND (bs > 0 OR os > 0) THEN
        greatest(CASE WHEN tb > 0 AND bs > 0 THEN greatest(tb - db, 0) / bs ELSE 0 END,
                 CASE WHEN t > 0 AND os > 0 THEN greatest(t - d, 0) / os ELSE 0 END) END, 4) AS eta_s FROM r""")
def eta_pessimistic(v: Views):
    done_bytes = F.col("done") * 900
    eta = progress.eta_pessimistic(
        F.col("total") * 1000, done_bytes, progress.speed(done_bytes, "elapsed_s"),
        "total", "done", progress.speed("done", "elapsed_s"),
    )
    return v.progress().select("session_id", rounded(eta, 4).alias("eta_s"))


@query("x12_eta_linear", """
    SELECT session_id, CASE WHEN total > 0 AND done >= total THEN 0
        WHEN done > 0 AND total > done THEN CAST(floor((total - done) / (done / elapsed_s)) AS BIGINT) END AS eta_s,
        walk_complete AND total > 0 AND done > 0 AS eta_known FROM v_progress""")
def eta_linear(v: Views):
    text = progress.session_eta("done", "total", "elapsed_s", "walk_complete")
    return v.progress().select(
        "session_id", progress.eta_linear("done", "total", "elapsed_s").alias("eta_s"), (text != "∞").alias("eta_known")
    )


@query("x13_progress_pct", """
    SELECT session_id, round(CASE WHEN total > 0 THEN done * 2.0 / total * 100 ELSE 0 END, 4) AS pct,
           round(least(CASE WHEN total > 0 THEN done * 2.0 / total * 100 ELSE 0 END, 100), 4) AS pct_ui
    FROM v_progress""")
def progress_pct(v: Views):
    twice = F.col("done") * 2
    return v.progress().select(
        "session_id", rounded(progress.progress_pct(twice, "total"), 4).alias("pct"),
        rounded(progress.progress_pct(twice, "total", cap=True), 4).alias("pct_ui"),
    )


@query("x14_mbps", "SELECT event_id, round(bytes / 15 / 1048576, 6) AS mbps FROM v_ticks")
def mbps(v: Views):
    return v.ticks().select("event_id", rounded(progress.mbps("bytes", F.lit(15)), 6).alias("mbps"))


@query("x15_basename_rel_path", """
    SELECT page_id, list_last(string_split(url, '/')) AS base,
           regexp_replace(regexp_replace(url, '^https?:/', ''), '^/', '') AS rel FROM pages""")
def basename_rel_path(v: Views):
    absolute = F.regexp_replace("url", "^https?:/", "")
    return v.table("pages").select(
        "page_id", paths.basename("url").alias("base"), paths.rel_path(absolute).alias("rel")
    )


@query("x17_truncate_text", """
    SELECT session_id, bucket_name, CASE WHEN length(coalesce(error, '')) > 25 THEN substr(error, 1, 25) || '…'
                                         ELSE coalesce(error, '') END AS error_text FROM v_uploads""")
def truncate_text(v: Views):
    return v.uploads().select("session_id", "bucket_name", sizes.truncate_text("error", 25).alias("error_text"))


@query("x18_archive_name", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S-') || printf('%03d', millisecond(ts) % 1000)
           || CASE WHEN event_id % 2 = 0 THEN '.tar.zst' ELSE '.tar.gz' END AS name FROM v_ticks""")
def archive_name(v: Views):
    mode = F.when(F.col("event_id") % 2 == 0, "zst").otherwise("gzip")
    return v.ticks().select("event_id", paths.archive_name("ts", paths.archive_extension(mode)).alias("name"))


@query("x19_archive_extension", """
    SELECT slot, CASE WHEN slot = 1 THEN '.tar.zst' ELSE '.tar.gz' END AS ext, count(*) AS n FROM v_ticks GROUP BY ALL""")
def archive_extension(v: Views):
    mode = F.when(F.col("slot") == 1, "zst").when(F.col("slot") == 2, "gzip")
    return v.ticks().groupBy("slot", paths.archive_extension(mode).alias("ext")).agg(F.count("*").alias("n"))


@query("x20_remote_key", """
    SELECT o_orderkey, 'mirror/' || rel_path AS retro_key, 'mirror/' || file_name AS commit_key FROM v_backups""")
def remote_key(v: Views):
    prefix = F.lit("mirror/")
    return v.backups().select(
        "o_orderkey", paths.remote_key(prefix, "rel_path").alias("retro_key"),
        paths.remote_key(prefix, "rel_path", layout="basename").alias("commit_key"),
    )


@query("x21_normalize_level", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'debug' WHEN 'view' THEN 'warn' WHEN 'error' THEN 'error'
                     WHEN 'signup' THEN 'warn' ELSE 'info' END AS level FROM events""")
def normalize_level(v: Views):
    kind = F.col("event_type")
    raw = F.when(kind == "click", "DEBUG").when(kind == "view", "Warning").when(kind == "signup", "warn").otherwise(
        F.upper(kind)
    )
    return v.table("events").select("event_id", status.normalize_level(raw).alias("level"))


@query("x22_server_load", "SELECT session_id, slot, round(least(1, ticks / 100), 4) AS load FROM v_streams")
def server_load(v: Views):
    return v.streams().select("session_id", "slot", rounded(progress.server_load("ticks"), 4).alias("load"))


@query("x23_efficiency_gauge", """
    SELECT agent, hour_no, CAST(least(100, floor(e * 50 + 0.5)) AS BIGINT) AS pct,
           CASE WHEN e >= 1 THEN 'low' WHEN e >= 0.6 THEN 'med' ELSE 'high' END AS band
    FROM (SELECT agent, hour_no, producer_bps / drain_bps AS e FROM v_rates WHERE drain_bps > 0)""")
def efficiency_gauge(v: Views):
    rated = v.rates().filter("drain_bps > 0").withColumn("e", F.col("producer_bps") / F.col("drain_bps"))
    return rated.select(
        "agent", "hour_no", status.efficiency_percent("e").alias("pct"), status.efficiency_band("e").alias("band")
    )


@query("x24_should_async", """
    SELECT storage, count(*) FILTER (bmode <> 'archive') > 0
           AND count(*) FILTER (bmode <> 'archive' AND NOT async_upload) = 0 AS should_async
    FROM v_buckets GROUP BY storage""")
def should_async(v: Views):
    return mirroring.should_async(v.buckets())


@query("f1_glob_exclude", """
    SELECT doc_id, rel_path FROM v_files
    WHERE NOT regexp_matches(rel_path, '\\.log$') AND NOT regexp_matches(rel_path, '^src1/[^/]*/doc-[^/]\\.txt$')
      AND NOT regexp_matches(rel_path, '(^|/)de(/|$)') AND NOT regexp_matches(rel_path, '/doc-[0-4][^/]*\\.tar\\.gz$')""")
def glob_exclude(v: Views):
    return inventory.glob_exclude(v.files(), EXCLUDES).select("doc_id", "rel_path")


@query("f1_glob_nested", """
    SELECT doc_id, rel_path FROM v_files WHERE NOT regexp_matches(rel_path, '(^|/)fr(/|$)')""")
def glob_nested(v: Views):
    """Forms for one component that hold a slash match nothing: only ``fr/**`` excludes."""
    return inventory.glob_exclude(v.files(), ["src1/de/**", "src2/en/", "*/src3/en/", "fr/**"]).select("doc_id", "rel_path")


@query("f2_prune_excluded_dirs", """
    SELECT doc_id, rel_path FROM v_files
    WHERE NOT regexp_matches(rel_path, '\\.log$') AND NOT regexp_matches(rel_path, '^src1/[^/]*/doc-[^/]\\.txt$')
      AND NOT regexp_matches(rel_path, '(^|/)de(/|$)') AND NOT regexp_matches(rel_path, '/doc-[0-4][^/]*\\.tar\\.gz$')
      AND NOT regexp_matches(rel_path, '(^|/)fr/')""")
def prune_excluded_dirs(v: Views):
    return inventory.prune_excluded_dirs(v.files(), EXCLUDES).select("doc_id", "rel_path")


@query("f3_is_backup_file", """
    SELECT rel_path LIKE '%.tar.gz' OR rel_path LIKE '%.tar.zst' AS is_backup, count(*) AS n FROM v_files GROUP BY ALL""")
def is_backup_file(v: Views):
    return v.files().groupBy(paths.is_backup_file("rel_path").alias("is_backup")).agg(F.count("*").alias("n"))


@query("f4_filter_by_mode", "SELECT name, storage FROM v_buckets WHERE bmode = 'sync'")
def filter_by_mode(v: Views):
    return mirroring.filter_by_mode(v.buckets(), "sync").select("name", "storage")


@query("f4_filter_excluding_mode", "SELECT name, storage FROM v_buckets WHERE bmode <> 'archive'")
def filter_excluding_mode(v: Views):
    return mirroring.filter_excluding_mode(v.buckets(), "archive").select("name", "storage")


@query("f6_session_status", """
    WITH s AS (SELECT session_id, max(ts) AS last FROM v_ticks GROUP BY session_id),
         n AS (SELECT session_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 1000000.0 / 3600 AS idle FROM s)
    SELECT session_id, CASE WHEN session_id % 9 = 0 THEN 'finalizing' WHEN idle < 10 THEN 'running'
                            WHEN idle < 60 THEN 'idle' ELSE 'degraded' END AS status FROM n""")
def session_status(v: Views):
    """Idle hours stand in for idle seconds, as the sample feed is sparse."""
    last = v.ticks().groupBy("session_id").agg(F.max("ts").alias("last"))
    now = F.lit("2024-01-31").cast("timestamp")
    idle = status.idle_seconds("last", now) / 3600
    as_of = F.timestamp_micros(F.unix_micros(now))
    scaled = F.timestamp_micros((F.unix_micros(as_of) - rounded(idle * 1e6)).cast("long"))
    return last.withColumn("closing", F.col("session_id") % 9 == 0).select(
        "session_id", status.session_status(scaled, as_of, "closing").alias("status")
    )


@query("f7_stream_status", """
    WITH n AS (SELECT session_id, slot, slot_status,
                      CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_activity)) / 3600000000.0) AS BIGINT)
                          AS idle, CASE WHEN "offset" % 3 = 0 THEN "offset" % 120 END AS slow FROM v_streams)
    SELECT session_id, slot, CASE WHEN slot_status = 'disabled' THEN 'disabled'
           WHEN slot_status = 'disconnected' THEN 'disconnected' WHEN slow >= 60 THEN 'degraded'
           WHEN slow IS NOT NULL THEN 'slow' WHEN idle < 10 THEN 'running' WHEN idle < 60 THEN 'idle'
           ELSE 'degraded' END AS status FROM n""")
def stream_status(v: Views):
    idle = F.floor(status.idle_seconds("last_activity", F.lit("2024-01-31").cast("timestamp")) / 3600)
    slow = F.when(F.col("offset") % 3 == 0, F.col("offset") % 120)
    active = F.col("slot_status").isin("receiving", "idle")
    return v.streams().select(
        "session_id", "slot", status.stream_status(active, "slot_status", idle, slow, 60).alias("status")
    )


@query("f8_usage_band", """
    SELECT s_suppkey, CASE WHEN cpu >= 80 THEN 'high' WHEN cpu >= 50 THEN 'med' ELSE 'low' END AS agent_band,
           CASE WHEN disk >= 90 THEN 'high' WHEN disk >= 70 THEN 'med' ELSE 'low' END AS storage_band,
           disk >= 90 AS critical, CASE WHEN mem >= 80 THEN 'high' WHEN mem >= 40 THEN 'med' ELSE 'low' END AS sync_band
    FROM v_agents""")
def usage_band(v: Views):
    return v.agents().select(
        "s_suppkey", status.usage_band("cpu", "agents").alias("agent_band"),
        status.usage_band("disk", "storage").alias("storage_band"), status.is_critical("disk").alias("critical"),
        status.usage_band("mem", "sync").alias("sync_band"),
    )


RATE_MS_SQL = """WITH r AS (SELECT *, CAST(floor(producer_bps) AS BIGINT) % 400 AS blocked_ms,
    CAST(floor(drain_bps) AS BIGINT) % 400 AS idle_ms FROM v_rates) """


@query("f9_bottleneck", RATE_MS_SQL + """
    SELECT agent, hour_no, CASE WHEN blocked_ms > idle_ms AND blocked_ms > 100 THEN 'network'
        WHEN idle_ms > blocked_ms AND idle_ms > 100 THEN 'producer' ELSE 'balanced' END AS bottleneck FROM r""")
def bottleneck(v: Views):
    blocked = F.floor("producer_bps") % 400
    idle = F.floor("drain_bps") % 400
    return v.rates().select("agent", "hour_no", status.bottleneck(blocked, idle).alias("bottleneck"))


@query("f10_flow_hint", """
    SELECT agent, hour_no, CASE WHEN producer_bps < drain_bps * 0.92 AND hour_no % 14 < 10 THEN 'Producer-Limited'
        WHEN drain_bps < producer_bps * 0.92 OR hour_no % 14 >= 10 THEN 'Transport/Drain-Limited' ELSE 'Balanced' END
        AS hint, round((producer_bps - drain_bps) / CASE WHEN drain_bps > 0 THEN drain_bps ELSE 1 END * 100, 4)
        AS skew_pct FROM v_rates""")
def flow_hint(v: Views):
    return v.rates().select(
        "agent", "hour_no", status.flow_hint("producer_bps", "drain_bps", F.col("hour_no") % 14).alias("hint"),
        rounded(status.skew_percent("producer_bps", "drain_bps"), 4).alias("skew_pct"),
    )


@query("f11_valid_path_component", """
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN CASE WHEN n_chars + 4 > 255 THEN 'too long' END
        WHEN 2 THEN 'separator' WHEN 3 THEN 'traversal' WHEN 4 THEN 'starts with dot' WHEN 5 THEN 'separator' END
        AS reason FROM documents""")
def valid_path_component(v: Views):
    key = F.col("doc_id") % 7
    name = (
        F.when(key == 0, "").when(key == 1, F.concat(F.lit("name"), F.repeat(F.lit("x"), F.col("n_chars").cast("int"))))
        .when(key == 2, F.concat_ws("/", "source", "lang")).when(key == 3, F.concat(F.lit(".."), "lang"))
        .when(key == 4, F.concat(F.lit("."), "lang")).when(key == 5, F.concat_ws("\\", "source", "lang"))
        .otherwise(F.col("source"))
    )
    return v.table("documents").select("doc_id", paths.invalid_component_reason(name).alias("reason"))


@query("f12_path_within", """
    SELECT doc_id, doc_id % 6 IN (0, 2, 5) AS within FROM documents""")
def path_within(v: Views):
    key = F.col("doc_id") % 6
    base = F.concat(F.lit("/data/"), "source")
    path = (
        F.when(key == 0, F.concat(base, F.lit("/./"), "lang", F.lit("//f")))
        .when(key == 1, F.concat(base, F.lit("/../other")))
        .when(key == 2, F.concat(base, F.lit("/a/../b")))
        .when(key == 3, F.concat(base, F.lit("/..x/f")))
        .when(key == 4, F.concat(base, F.lit("-suffix/f")))
        .otherwise(base)
    )
    return v.table("documents").select("doc_id", paths.path_within(base, path).alias("within"))


def _addresses(v: Views):
    key = F.col("event_id")
    plain = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 30).cast("string"), (key % 300).cast("string"), F.lit("7"))
    return v.table("events").select(
        "event_id", F.when(key % 2 == 0, F.concat(plain, F.lit(":9847"))).otherwise(plain).alias("addr")
    )


@query("f13_ip_allowed", """
    SELECT event_id, event_id % 300 <= 255 AND (user_id % 30 IN (3, 12, 13, 14, 15)
                     OR user_id % 30 = 20 AND event_id % 300 BETWEEN 64 AND 127) AS allowed FROM events""")
def ip_allowed(v: Views):
    acl = ["10.3.0.0/16", "10.12.0.0/14", "10.20.64.0/18"]
    return _addresses(v).select("event_id", network.ip_allowed("addr", acl).alias("allowed"))


@query("f13_ip_allowed_mapped", """
    SELECT event_id, event_id % 300 <= 255 AND user_id % 30 IN (3, 12, 13, 14, 15) AS allowed FROM events""")
def ip_allowed_mapped(v: Views):
    """IPv4 addresses written as IPv6 count as what they are."""
    plain = _addresses(v).withColumn("addr", F.concat(F.lit("::ffff:"), F.regexp_extract("addr", "^[0-9.]+", 0)))
    return plain.select("event_id", network.ip_allowed("addr", ["10.3.0.0/16", "10.12.0.0/14"]).alias("allowed"))


@query("f13_ip_allowed_v6", """
    SELECT user_id, user_id BETWEEN 16 AND 31 AS allowed, count(*) AS n FROM events GROUP BY ALL""")
def ip_allowed_v6(v: Views):
    """IPv6 addresses built from user ids against a mixed list."""
    addr = F.concat(F.lit("[2001:db8:"), F.lower(F.hex(F.col("user_id"))), F.lit("::1]:443"))
    allowed = network.ip_allowed("addr", ["2001:db8:10::/44", "10.0.0.0/8"])
    users = v.table("events").select("user_id", addr.alias("addr"))
    return users.groupBy("user_id", allowed.alias("allowed")).agg(F.count("*").alias("n"))


@query("f15_derive_level", """
    SELECT CASE WHEN result = 'ok' THEN 'info' ELSE 'error' END AS level, count(*) AS n FROM v_history GROUP BY ALL""")
def derive_level(v: Views):
    return v.history().groupBy(status.derive_level("result").alias("level")).agg(F.count("*").alias("n"))


@query("f16_effective_scaler_state", """
    SELECT agent, hour_no, CASE hour_no % 5 WHEN 1 THEN CASE WHEN active >= max_streams THEN 'stable' ELSE 'scaling_up' END
        WHEN 2 THEN 'scaling_down' WHEN 3 THEN 'probing' ELSE 'stable' END AS state FROM v_rates""")
def effective_scaler_state(v: Views):
    state = status.scaler_state(F.col("hour_no") % 5)
    return v.rates().select(
        "agent", "hour_no", status.effective_scaler_state(state, F.col("active"), F.col("max_streams")).alias("state")
    )
