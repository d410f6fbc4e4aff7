"""Registration of queries, and the driver tables seen as transfer and backup tables.

Each view exists twice, as a DataFrame and as SQL, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(value, digits: int = 0) -> Column:
    """Round the product with the power of ten, half away from zero, as the SQL side does for doubles."""
    number = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.signum(number) * F.floor(F.abs(number) * scale + 0.5) / scale


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Views` under ``name``, with its SQL if there is one."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Views(prepare(spark), sf_dir))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# View name -> (views it reads, SQL).
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_chunks": ((), """
        SELECT l_orderkey AS session_id, CAST(l_linenumber - 1 AS BIGINT) AS global_seq, l_suppkey % 4 AS slot_id,
               CAST(floor(l_quantity) AS BIGINT) AS length, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
               l_discount, l_tax
        FROM lineitem"""),
    "v_first": (("v_chunks",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, global_seq ORDER BY l_shipdate,
            l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, length) AS rn FROM v_chunks) WHERE rn = 1"""),
    "v_conv": ((), """
        SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS global_seq, text AS payload FROM conversations"""),
    "v_files": ((), """
        SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.' ||
               CASE doc_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'txt' WHEN 2 THEN 'tar.gz' ELSE 'tar.zst' END AS rel_path,
               'file' AS entry_type, n_chars AS size
        FROM documents"""),
    "v_backups": ((), """
        SELECT o_orderkey, CAST(o_custkey % 5 AS BIGINT) AS storage, o_custkey AS agent,
               strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '-' || o_orderkey || '.tar.gz' AS file_name,
               o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '-' || o_orderkey || '.tar.gz'
                   AS rel_path,
               CAST(floor(o_totalprice) AS BIGINT) AS size
        FROM orders"""),
    "v_storages": ((), """
        SELECT CAST(r_regionkey AS BIGINT) AS storage, r_name AS name, CAST(r_regionkey + 1 AS BIGINT) AS max_backups,
               CAST(r_regionkey + 1 AS BIGINT) * 1000000000 AS total_bytes
        FROM region"""),
    "v_buckets": ((), """
        SELECT CAST(n_regionkey AS BIGINT) AS storage, n_name AS name, lower(n_name) || '/' AS prefix,
               CASE n_nationkey % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'offload' ELSE 'archive' END AS bmode,
               CAST(CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 + n_nationkey % 4 END AS BIGINT) AS retain,
               CASE WHEN n_nationkey % 3 <> 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'safe'
                    ELSE 'space_efficient' END AS sync_strategy,
               n_nationkey % 3 <> 1 AND n_nationkey % 2 = 0 AS async_upload
        FROM nation"""),
    "v_remote": (("v_backups", "v_buckets"), """
        SELECT k.storage, k.name AS bucket, k.prefix || b.rel_path AS key, b.size, b.o_orderkey
        FROM v_backups b JOIN v_buckets k ON b.storage = k.storage
        WHERE b.o_orderkey % 3 <> 0"""),
    "v_history": ((), """
        SELECT o_orderkey AS session_id, o_custkey AS agent, CAST(o_custkey % 5 AS BIGINT) AS storage,
               CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'write_error' ELSE 'checksum_mismatch' END AS result,
               CAST(floor(o_totalprice) AS BIGINT) AS bytes_total, o_orderdate AS finished_at
        FROM orders"""),
    "v_ticks": ((), """
        SELECT event_id, user_id AS session_id, user_id % 10 AS agent, event_id % 4 AS slot, ts,
               CAST(floor(value * 1048576) AS BIGINT) AS bytes, event_type
        FROM events"""),
    "v_log": ((), """
        SELECT event_id, user_id AS session_id, ts,
               CASE event_type WHEN 'signup' THEN 'chunk_receive_started' WHEN 'click' THEN 'chunk_received'
                    WHEN 'view' THEN 'ChunkSACK sent' WHEN 'error' THEN 'chunk_receive_failed'
                    ELSE 'missing_chunk_in_assembly' END AS msg,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq
        FROM events"""),
    "v_uploads": (("v_buckets",), """
        SELECT o.o_orderkey AS session_id, o.o_custkey AS agent, k.storage, k.name AS bucket_name, k.bmode,
               o.o_orderstatus = 'F' AS success, o.o_orderdate AS timestamp,
               CAST(1 + o.o_orderkey % 300 AS BIGINT) AS duration_s, CAST(floor(o.o_totalprice) AS BIGINT) AS bytes,
               CASE WHEN o.o_orderstatus = 'F' THEN NULL
                    ELSE 'upload of order ' || o.o_orderkey || ' failed: ' || o.o_orderpriority END AS error
        FROM orders o JOIN v_buckets k ON o.o_custkey % 5 = k.storage AND k.bmode = 'sync'"""),
    "v_agents": ((), """
        SELECT s_suppkey, s_suppkey % 10 AS agent, epoch_us(TIMESTAMP '2024-01-01') + s_suppkey * 3600000000 AS stats_us,
               CAST(floor(abs(s_acctbal)) AS BIGINT) % 101 AS cpu,
               CAST(floor(abs(s_acctbal)) AS BIGINT) * 7 % 101 AS mem,
               CAST(floor(abs(s_acctbal)) AS BIGINT) * 13 % 101 AS disk,
               CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'v4.1' ELSE 'v4.2' END AS client_version
        FROM supplier"""),
    "v_rates": ((), """
        SELECT user_id % 10 AS agent, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_no,
               coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type IN ('click', 'view', 'signup')), 0)
                   / 100.0 AS producer_bps,
               coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type IN ('error', 'purchase')), 0)
                   / 100.0 AS drain_bps,
               count(DISTINCT event_id % 4) AS active, 4 AS max_streams
        FROM events GROUP BY ALL"""),
    "v_streams": (("v_ticks",), """
        SELECT session_id, slot, CAST(sum(bytes) AS BIGINT) AS "offset", max(ts) AS last_activity, count(*) AS ticks,
               CASE slot WHEN 0 THEN 'receiving' WHEN 1 THEN 'idle' WHEN 2 THEN 'disconnected' ELSE 'disabled' END
                   AS slot_status
        FROM v_ticks GROUP BY session_id, slot"""),
    "v_jobs": ((), """
        SELECT o_orderkey AS run_id, o_custkey AS job,
               CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS start_s,
               CAST(3600 * (1 + o_orderkey % 48) AS BIGINT) AS duration_s,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status
        FROM orders"""),
    "v_progress": ((), """
        SELECT c_custkey AS session_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS total,
               CAST(floor(abs(c_acctbal)) AS BIGINT) * (c_custkey % 11) // 10 AS done,
               c_custkey % 4 <> 0 AS walk_complete, 1 + c_custkey % 600 AS elapsed_s
        FROM customer"""),
    "v_ctrl": ((), """
        SELECT event_id, user_id AS agent, event_type, ts FROM events WHERE event_type IN ('error', 'signup')"""),
}


def with_views(sql: str) -> str:
    """Prefix a statement with the definitions of the views it names."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for parent in VIEW_SQL[name][0]:
                add(parent)
            needed.append(name)

    words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in sql).split())
    for name in VIEW_SQL:
        if name in words:
            add(name)
    if not needed:
        return sql
    heads = ", ".join(f"{name} AS ({VIEW_SQL[name][1]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


class Views:
    """The driver tables of one scale, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def chunks(self) -> DataFrame:
        arrival = F.struct(
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
        )
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("session_id"),
            (F.col("l_linenumber") - 1).cast("long").alias("global_seq"),
            (F.col("l_suppkey") % 4).alias("slot_id"),
            F.floor("l_quantity").cast("long").alias("length"),
            arrival.alias("arrival"),
        )

    def conv(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.col("turn").cast("long").alias("global_seq"),
            F.encode("text", "UTF-8").alias("payload"),
        )

    def files(self) -> DataFrame:
        extension = (
            F.when(F.col("doc_id") % 4 == 0, "log").when(F.col("doc_id") % 4 == 1, "txt")
            .when(F.col("doc_id") % 4 == 2, "tar.gz").otherwise("tar.zst")
        )
        path = F.concat(
            "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), extension
        )
        return self.table("documents").select(
            "doc_id", path.alias("rel_path"), F.lit("file").alias("entry_type"), F.col("n_chars").alias("size")
        )

    def backups(self) -> DataFrame:
        stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss")
        name = F.concat(stamp, F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".tar.gz"))
        return self.table("orders").select(
            "o_orderkey",
            (F.col("o_custkey") % 5).cast("long").alias("storage"),
            F.col("o_custkey").alias("agent"),
            name.alias("file_name"),
            F.concat(F.col("o_custkey").cast("string"), F.lit("/"), name).alias("rel_path"),
            F.floor("o_totalprice").cast("long").alias("size"),
        )

    def storages(self) -> DataFrame:
        number = F.col("r_regionkey").cast("long")
        return self.table("region").select(
            number.alias("storage"), F.col("r_name").alias("name"),
            (number + 1).alias("max_backups"), ((number + 1) * 1_000_000_000).alias("total_bytes"),
        )

    def buckets(self) -> DataFrame:
        nation = F.col("n_nationkey")
        return self.table("nation").select(
            F.col("n_regionkey").cast("long").alias("storage"),
            F.col("n_name").alias("name"),
            F.concat(F.lower("n_name"), F.lit("/")).alias("prefix"),
            F.when(nation % 3 == 0, "sync").when(nation % 3 == 1, "offload").otherwise("archive").alias("bmode"),
            F.when(nation % 3 == 0, 0).otherwise(1 + nation % 4).cast("long").alias("retain"),
            F.when(nation % 3 == 0, F.when(nation % 2 == 0, "safe").otherwise("space_efficient")).alias("sync_strategy"),
            ((nation % 3 != 1) & (nation % 2 == 0)).alias("async_upload"),
        )

    def remote(self) -> DataFrame:
        buckets = self.buckets().select("storage", F.col("name").alias("bucket"), "prefix")
        return self.backups().filter(F.col("o_orderkey") % 3 != 0).join(buckets, "storage").select(
            "storage", "bucket", F.concat("prefix", "rel_path").alias("key"), "size", "o_orderkey"
        )

    def history(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("session_id"),
            F.col("o_custkey").alias("agent"),
            (F.col("o_custkey") % 5).cast("long").alias("storage"),
            F.when(status == "F", "ok").when(status == "O", "write_error").otherwise("checksum_mismatch").alias("result"),
            F.floor("o_totalprice").cast("long").alias("bytes_total"),
            F.col("o_orderdate").cast("timestamp").alias("finished_at"),
        )

    def ticks(self, events: DataFrame | None = None) -> DataFrame:
        return (events if events is not None else self.table("events")).select(
            "event_id",
            F.col("user_id").alias("session_id"),
            (F.col("user_id") % 10).alias("agent"),
            (F.col("event_id") % 4).alias("slot"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.floor(F.col("value") * 1048576).cast("long").alias("bytes"),
            "event_type",
        )

    def log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("session_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(kind == "signup", "chunk_receive_started").when(kind == "click", "chunk_received")
            .when(kind == "view", "ChunkSACK sent").when(kind == "error", "chunk_receive_failed")
            .otherwise("missing_chunk_in_assembly").alias("msg"),
            F.get_json_object("props", "$.k").cast("long").alias("seq"),
        )

    def uploads(self) -> DataFrame:
        buckets = self.buckets().filter(F.col("bmode") == "sync").select(
            "storage", F.col("name").alias("bucket_name"), "bmode"
        )
        failed = F.concat(
            F.lit("upload of order "), F.col("o_orderkey").cast("string"), F.lit(" failed: "), "o_orderpriority"
        )
        return (
            self.table("orders").withColumn("storage", (F.col("o_custkey") % 5).cast("long")).join(buckets, "storage")
            .select(
                F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("agent"), "storage", "bucket_name",
                "bmode", (F.col("o_orderstatus") == "F").alias("success"),
                F.col("o_orderdate").cast("timestamp").alias("timestamp"),
                (1 + F.col("o_orderkey") % 300).alias("duration_s"),
                F.floor("o_totalprice").cast("long").alias("bytes"),
                F.when(F.col("o_orderstatus") != "F", failed).alias("error"),
            )
        )

    def agents(self) -> DataFrame:
        balance = F.floor(F.abs("s_acctbal")).cast("long")
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key, (key % 10).alias("agent"),
            F.timestamp_micros(F.lit(1_704_067_200_000_000) + key * 3_600_000_000).alias("stats_ts"),
            (balance % 101).alias("cpu"), (balance * 7 % 101).alias("mem"), (balance * 13 % 101).alias("disk"),
            F.when(key % 3 == 0, "").when(key % 3 == 1, "v4.1").otherwise("v4.2").alias("client_version"),
        )

    def rates(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long")
        produced = F.col("event_type").isin("click", "view", "signup")
        return (
            self.table("events")
            .groupBy(
                (F.col("user_id") % 10).alias("agent"),
                F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour_no"),
            )
            .agg(
                (F.coalesce(F.sum(F.when(produced, cents)), F.lit(0)) / 100.0).alias("producer_bps"),
                (F.coalesce(F.sum(F.when(~produced, cents)), F.lit(0)) / 100.0).alias("drain_bps"),
                F.array_size(F.collect_set(F.col("event_id") % 4)).cast("long").alias("active"),
                F.lit(4).alias("max_streams"),
            )
            .withColumn("ts", F.timestamp_seconds(F.col("hour_no") * 3600))
        )

    def streams(self) -> DataFrame:
        slot = F.col("slot")
        return (
            self.ticks().groupBy("session_id", "slot")
            .agg(F.sum("bytes").alias("offset"), F.max("ts").alias("last_activity"), F.count("*").alias("ticks"))
            .withColumn("slot_status", F.when(slot == 0, "receiving").when(slot == 1, "idle")
                        .when(slot == 2, "disconnected").otherwise("disabled"))
        )

    def jobs(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job"),
            (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("start_s"),
            (3600 * (1 + F.col("o_orderkey") % 48)).alias("duration_s"),
            F.when(status == "F", "completed").when(status == "O", "failed").otherwise("skipped").alias("status"),
        )

    def progress(self) -> DataFrame:
        total = F.floor(F.abs("c_acctbal")).cast("long")
        return self.table("customer").select(
            F.col("c_custkey").alias("session_id"), total.alias("total"),
            F.floor(total * (F.col("c_custkey") % 11) / 10).cast("long").alias("done"),
            (F.col("c_custkey") % 4 != 0).alias("walk_complete"),
            (1 + F.col("c_custkey") % 600).alias("elapsed_s"),
        )

    def ctrl(self) -> DataFrame:
        return self.table("events").filter(F.col("event_type").isin("error", "signup")).select(
            "event_id", F.col("user_id").alias("agent"), "event_type", F.col("ts").cast("timestamp").alias("ts")
        )
