"""Queries on retention, buckets and mirroring."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query, rounded
from haulmark.operators import mirroring, retention
from haulmark.plans import mirror

DOOMED = """doomed AS (SELECT * FROM (SELECT b.*, s.max_backups, row_number() OVER (PARTITION BY b.storage, b.agent
    ORDER BY b.file_name DESC) AS rn FROM v_backups b JOIN v_storages s ON b.storage = s.storage)
    WHERE rn > max_backups)"""


def _limited(v: Views):
    return v.backups().join(v.storages().select("storage", "max_backups"), "storage")


@query("w5_retention_candidates", f"WITH {DOOMED} SELECT storage, agent, file_name FROM doomed")
def retention_candidates(v: Views):
    return retention.retention_candidates(_limited(v)).select("storage", "agent", "file_name")


def _objects(v: Views):
    sides = v.buckets().filter(F.col("bmode") != "sync").select(
        "storage", F.col("name").alias("bucket"), "prefix", "retain"
    )
    return v.remote().join(sides, ["storage", "bucket"])


@query("w6_bucket_retention", """
    SELECT storage, bucket, key FROM (
        SELECT r.storage, r.bucket, r.key, k.retain,
               row_number() OVER (PARTITION BY r.storage, r.bucket ORDER BY r.key DESC) AS rn
        FROM v_remote r JOIN v_buckets k ON r.storage = k.storage AND r.bucket = k.name WHERE k.bmode <> 'sync')
    WHERE rn > retain""")
def bucket_retention(v: Views):
    return retention.bucket_retention(_objects(v)).select("storage", "bucket", "key")


EXPANDED = """ex AS (SELECT b.storage, b.agent, k.name AS bucket, k.prefix || b.rel_path AS key, b.size
    FROM v_backups b JOIN v_buckets k ON b.storage = k.storage AND k.bmode = 'sync')"""


@query("j1_missing_remote", f"""WITH {EXPANDED} SELECT storage, bucket, key FROM ex
    ANTI JOIN v_remote USING (storage, bucket, key)""")
def missing_remote(v: Views):
    return mirroring.missing_remote(v.backups(), v.buckets(), v.remote()).select("storage", "bucket", "key")


@query("j2_already_synced", f"""WITH {EXPANDED} SELECT storage, bucket, key FROM ex
    SEMI JOIN v_remote USING (storage, bucket, key)""")
def already_synced(v: Views):
    return mirroring.already_synced(v.backups(), v.buckets(), v.remote()).select("storage", "bucket", "key")


@query("j3_expand_storage_buckets", f"WITH {EXPANDED} SELECT storage, agent, bucket, key FROM ex")
def expand_storage_buckets(v: Views):
    return mirroring.expand_storage_buckets(v.backups(), v.buckets()).select("storage", "agent", "bucket", "key")


@query("j6_upload_context", """
    SELECT u.bucket_name, u.success,
           CASE WHEN h.session_id % 2 = 0 THEN CAST(u.session_id AS VARCHAR) ELSE '' END AS session_id,
           coalesce(CAST(h.agent AS VARCHAR), '') AS agent, coalesce(CAST(h.storage AS VARCHAR), '') AS storage,
           CASE WHEN h.session_id IS NULL THEN '' ELSE 'nightly' END AS backup
    FROM v_uploads u LEFT JOIN (SELECT * FROM v_history WHERE session_id % 5 <> 0) h ON u.session_id = h.session_id""")
def upload_context(v: Views):
    sessions = v.history().filter(F.col("session_id") % 5 != 0).withColumns({
        "backup": F.lit("nightly"),
        "mode": F.when(F.col("session_id") % 2 == 0, "parallel").otherwise("single"),
    })
    return mirroring.upload_context(v.uploads(), sessions).select(
        "bucket_name", "success", "session_id", "agent", "storage", "backup"
    )


@query("j7_mirror_delete_keys", f"""WITH {DOOMED}
    SELECT d.storage, d.agent, k.name AS bucket, k.prefix || d.file_name AS key
    FROM doomed d JOIN v_buckets k ON d.storage = k.storage AND k.bmode = 'sync'""")
def mirror_delete_keys(v: Views):
    return mirroring.mirror_delete_keys(retention.retention_candidates(_limited(v)), v.buckets())


@query("a5_sync_result", """
    WITH o AS (SELECT storage, bucket, CASE WHEN o_orderkey % 17 = 0 THEN 'error' WHEN o_orderkey % 2 = 0 THEN 'uploaded'
               ELSE 'skipped' END AS outcome FROM v_remote)
    SELECT storage, bucket, count(*) FILTER (outcome = 'uploaded') AS uploaded,
           count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors
    FROM o GROUP BY GROUPING SETS ((storage, bucket), ())""")
def sync_result(v: Views):
    key = F.col("o_orderkey")
    outcome = F.when(key % 17 == 0, "error").when(key % 2 == 0, "uploaded").otherwise("skipped")
    return mirroring.sync_result(v.remote().withColumn("outcome", outcome))


@query("a9_storage_usage", """
    SELECT s.storage, s.name, s.max_backups, coalesce(b.n, 0) AS backups_count, coalesce(b.used, 0) AS used_bytes,
           s.total_bytes, s.total_bytes - coalesce(b.used, 0) AS free_bytes,
           round(coalesce(b.used, 0) * 100.0 / s.total_bytes, 4) AS usage_percent
    FROM v_storages s LEFT JOIN (SELECT storage, count(*) AS n, CAST(sum(size) AS BIGINT) AS used FROM v_backups
                                 GROUP BY storage) b ON s.storage = b.storage""")
def storage_usage(v: Views):
    usage = mirroring.storage_usage(v.backups(), v.storages())
    return usage.withColumn("usage_percent", rounded("usage_percent", 4))


@query("a10_upload_summary", """
    SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
           CAST(floor(count(*) FILTER (success) * 100.0 / count(*) + 0.5) AS BIGINT) AS success_pct FROM v_uploads""")
def upload_summary(v: Views):
    return mirroring.upload_summary(v.uploads())


@query("k5_plan_retention", f"""WITH {DOOMED}
    SELECT d.storage, d.agent, 1 AS step, 'archive_upload' AS action, k.name AS bucket, k.prefix || d.file_name AS target
    FROM doomed d JOIN v_buckets k ON d.storage = k.storage AND k.bmode = 'archive'
    UNION ALL SELECT storage, agent, 2, 'delete_local', NULL, file_name FROM doomed""")
def plan_retention(v: Views):
    return mirror.plan_retention(v.backups(), v.storages(), v.buckets())


@query("k6_plan_post_commit", f"""WITH {DOOMED},
    c AS (SELECT storage, agent, max(file_name) AS file_name FROM v_backups GROUP BY storage, agent),
    cb AS (SELECT c.*, k.name AS bucket, k.prefix, k.bmode, k.sync_strategy FROM c JOIN v_buckets k
           ON c.storage = k.storage),
    db AS (SELECT d.storage, d.agent, d.file_name, k.name AS bucket, k.prefix, k.bmode, k.sync_strategy
           FROM doomed d JOIN v_buckets k ON d.storage = k.storage)
    SELECT storage, agent, bucket, bmode, CASE WHEN sync_strategy = 'space_efficient' THEN 2 ELSE 1 END AS step,
           'upload' AS action, prefix || file_name AS key, 'stop' AS on_failure FROM cb WHERE bmode <> 'archive'
    UNION ALL SELECT storage, agent, bucket, bmode, 2, 'delete_local', file_name, 'continue' FROM cb
              WHERE bmode = 'offload'
    UNION ALL SELECT storage, agent, bucket, bmode, 3, 'rotate_bucket', prefix, 'continue' FROM cb
              WHERE bmode = 'offload'
    UNION ALL SELECT storage, agent, bucket, bmode, CASE WHEN sync_strategy = 'space_efficient' THEN 1 ELSE 2 END,
              'delete_remote', prefix || file_name, 'continue' FROM db WHERE bmode = 'sync'
    UNION ALL SELECT storage, agent, bucket, bmode, 1, 'upload_rotated', prefix || file_name, 'continue' FROM db
              WHERE bmode = 'archive'
    UNION ALL SELECT DISTINCT storage, agent, bucket, bmode, 2, 'rotate_bucket', prefix, 'continue' FROM db
              WHERE bmode = 'archive'""")
def plan_post_commit(v: Views):
    commits = v.backups().groupBy("storage", "agent").agg(F.max("file_name").alias("file_name"))
    return mirror.plan_post_commit(commits, retention.retention_candidates(_limited(v)), v.buckets())


@query("k5_plan_retention_gated", f"""WITH {DOOMED}, passed AS (SELECT * FROM doomed WHERE agent % 4 <> 1)
    SELECT d.storage, d.agent, 1 AS step, 'archive_upload' AS action, k.name AS bucket, k.prefix || d.file_name AS target
    FROM passed d JOIN v_buckets k ON d.storage = k.storage AND k.bmode = 'archive'
    UNION ALL SELECT storage, agent, 2, 'delete_local', NULL, file_name FROM passed""")
def plan_retention_gated(v: Views):
    """A quarter of the agents have an archive that did not pass its check."""
    failed = v.backups().filter("agent % 4 = 1").select("storage", "agent").distinct()
    return mirror.plan_retention(v.backups(), v.storages(), v.buckets(), failed)


@query("k6_plan_post_commit_gated", f"""WITH {DOOMED},
    c AS (SELECT storage, agent, max(file_name) AS file_name FROM v_backups WHERE agent % 4 <> 1 GROUP BY storage, agent),
    cb AS (SELECT c.*, k.name AS bucket, k.prefix, k.bmode, k.sync_strategy FROM c JOIN v_buckets k ON c.storage = k.storage),
    db AS (SELECT d.storage, d.agent, d.file_name, k.name AS bucket, k.prefix, k.bmode FROM doomed d JOIN v_buckets k
           ON d.storage = k.storage WHERE d.agent % 4 <> 1)
    SELECT agent, bucket, action, count(*) AS n FROM (
        SELECT agent, bucket, 'upload' AS action FROM cb WHERE bmode <> 'archive'
        UNION ALL SELECT agent, bucket, unnest(['delete_local', 'rotate_bucket']) FROM cb WHERE bmode = 'offload'
        UNION ALL SELECT agent, bucket, CASE bmode WHEN 'sync' THEN 'delete_remote' ELSE 'upload_rotated' END FROM db WHERE bmode <> 'offload'
        UNION ALL SELECT DISTINCT agent, bucket, 'rotate_bucket' FROM db WHERE bmode = 'archive') GROUP BY ALL""")
def plan_post_commit_gated(v: Views):
    """Actions per agent and bucket, where archives of a quarter of the agents did not pass."""
    commits = v.backups().groupBy("storage", "agent").agg(F.max("file_name").alias("file_name")).withColumn("integrity_ok", F.col("agent") % 4 != 1)
    plan = mirror.plan_post_commit(commits, retention.retention_candidates(_limited(v)), v.buckets())
    return plan.groupBy("agent", "bucket", "action").agg(F.count("*").alias("n"))


@query("k7_plan_retro_sync", f"""WITH {EXPANDED}
    SELECT ex.storage, ex.bucket, ex.key, CASE WHEN r.key IS NULL THEN 'upload' ELSE 'skip' END AS action
    FROM ex LEFT JOIN v_remote r ON ex.storage = r.storage AND ex.bucket = r.bucket AND ex.key = r.key""")
def plan_retro_sync(v: Views):
    return mirror.plan_retro_sync(v.backups(), v.buckets(), v.remote()).select("storage", "bucket", "key", "action")


@query("k7_retro_sync_totals", f"""WITH {EXPANDED},
    p AS (SELECT ex.storage, ex.bucket, r.key IS NULL AS todo FROM ex LEFT JOIN v_remote r
          ON ex.storage = r.storage AND ex.bucket = r.bucket AND ex.key = r.key)
    SELECT storage, bucket, count(*) FILTER (todo) AS uploaded, count(*) FILTER (NOT todo) AS skipped,
           CAST(0 AS BIGINT) AS errors FROM p GROUP BY GROUPING SETS ((storage, bucket), ())""")
def retro_sync_totals(v: Views):
    return mirror.retro_sync_totals(mirror.plan_retro_sync(v.backups(), v.buckets(), v.remote()))


@query("k11_session_log_retention", """
    SELECT c.session_id, count(*) AS kept_rows FROM v_chunks c
    ANTI JOIN (SELECT * FROM v_history WHERE result = 'ok') h USING (session_id) GROUP BY c.session_id""")
def session_log_retention(v: Views):
    kept = mirroring.session_log_retention(v.chunks(), v.history())
    return kept.groupBy("session_id").agg(F.count("*").alias("kept_rows"))
