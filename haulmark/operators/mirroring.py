"""Local archives against remote buckets: what to send, what is there, what to delete.

Bucket and storage tables are plain join sides. Spark broadcasts them while their size stays below
``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.paths import remote_key


def filter_by_mode(buckets: DataFrame, mode: str) -> DataFrame:
    return buckets.filter(F.col("bmode") == mode)


def filter_excluding_mode(buckets: DataFrame, mode: str) -> DataFrame:
    return buckets.filter(F.col("bmode") != mode)


def should_async(buckets: DataFrame) -> DataFrame:
    """Per storage: is there a bucket besides archives, and are all of those asynchronous?"""
    active = F.col("bmode") != "archive"
    return buckets.groupBy("storage").agg(
        ((F.count_if(active) > 0) & (F.count_if(active & ~F.col("async_upload")) == 0)).alias("should_async")
    )


def expand_storage_buckets(backups: DataFrame, buckets: DataFrame, layout: str = "rel_path") -> DataFrame:
    """Each archive with each sync bucket of its storage, and the key it has there."""
    sync = filter_by_mode(buckets, "sync").select("storage", F.col("name").alias("bucket"), "prefix")
    return backups.join(sync, "storage").withColumn("key", remote_key("prefix", "rel_path", layout))


def missing_remote(backups: DataFrame, buckets: DataFrame, remote: DataFrame, layout: str = "rel_path") -> DataFrame:
    """Archives whose key a sync bucket lacks: to upload."""
    return expand_storage_buckets(backups, buckets, layout).join(remote, ["storage", "bucket", "key"], "left_anti")


def already_synced(backups: DataFrame, buckets: DataFrame, remote: DataFrame, layout: str = "rel_path") -> DataFrame:
    """Archives whose key a sync bucket holds: skipped."""
    return expand_storage_buckets(backups, buckets, layout).join(remote, ["storage", "bucket", "key"], "left_semi")


def mirror_delete_keys(rotated: DataFrame, buckets: DataFrame) -> DataFrame:
    """Remote keys of locally removed archives, per sync bucket."""
    sync = filter_by_mode(buckets, "sync").select("storage", F.col("name").alias("bucket"), "prefix")
    return rotated.join(sync, "storage").select(
        "storage", "agent", "bucket", F.concat("prefix", "file_name").alias("key")
    )


def sync_result(outcomes: DataFrame) -> DataFrame:
    """Uploads, skips and errors per bucket, and the grand total in a row without storage and bucket."""
    return (
        outcomes.rollup("storage", "bucket")
        .agg(
            F.count_if(F.col("outcome") == "uploaded").alias("uploaded"),
            F.count_if(F.col("outcome") == "skipped").alias("skipped"),
            F.count_if(F.col("outcome") == "error").alias("errors"),
            F.grouping_id().alias("_level"),
        )
        .filter(F.col("_level") != 1)
        .drop("_level")
    )


def storage_usage(backups: DataFrame, storages: DataFrame) -> DataFrame:
    """Archives and space per storage; capacities are an input, and a storage without archives still shows."""
    used = backups.groupBy("storage").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    used_bytes = F.coalesce(F.col("bytes"), F.lit(0))
    return storages.join(used, "storage", "left").select(
        "storage", "name", "max_backups", F.coalesce("n", F.lit(0)).alias("backups_count"),
        used_bytes.alias("used_bytes"), "total_bytes", (F.col("total_bytes") - used_bytes).alias("free_bytes"),
        F.coalesce(F.try_divide(used_bytes * 100.0, F.col("total_bytes")), F.lit(0.0)).alias("usage_percent"),
    )


def upload_summary(uploads: DataFrame) -> DataFrame:
    """Uploads in all, done and failed, and the rounded share that went well (0 without uploads)."""
    counts = uploads.agg(F.count("*").alias("total"), F.count_if("success").alias("success"))
    return counts.select(
        "total", "success", (F.col("total") - F.col("success")).alias("failed"),
        F.coalesce(F.floor(F.try_divide(F.col("success") * 100.0, F.col("total")) + 0.5), F.lit(0)).cast("long")
        .alias("success_pct"),
    )


def upload_context(uploads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Uploads with agent, storage and backup of their session, blank where unknown.

    The session id itself stays only for parallel sessions.
    """
    known = sessions.select(
        "session_id", F.col("agent").alias("_agent"), F.col("storage").alias("_storage"),
        F.col("backup").alias("_backup"), F.col("mode").alias("_mode"),
    )

    def blank(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    return uploads.drop("agent", "storage", "backup").join(known, "session_id", "left").select(
        *[c for c in uploads.columns if c not in ("agent", "storage", "backup", "session_id")],
        F.when(F.col("_mode") == "parallel", F.col("session_id").cast("string")).otherwise("").alias("session_id"),
        blank("_agent").alias("agent"), blank("_storage").alias("storage"), blank("_backup").alias("backup"),
    )


def session_log_retention(log_rows: DataFrame, history: DataFrame) -> DataFrame:
    """Detailed log rows of every session that did not end well."""
    return log_rows.join(history.filter(F.col("result") == "ok").select("session_id"), "session_id", "left_anti")
