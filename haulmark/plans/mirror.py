"""Ordered action tables: local retention, what follows a commit, and a retroactive mirror run.

The tables say what is to be done and in which order; nothing is uploaded or deleted here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.operators import mirroring
from haulmark.operators.retention import retention_candidates


def plan_retention(backups: DataFrame, storages: DataFrame, buckets: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Step 1 sends what retention will remove to the archive buckets, step 2 removes it locally.

    ``failed`` names the (storage, agent) whose newest archive did not pass its integrity check: nothing of theirs
    is removed.
    """
    limits = storages.select("storage", "max_backups")
    doomed = retention_candidates(backups.join(limits, "storage")).select("storage", "agent", "file_name")
    if failed is not None:
        doomed = doomed.join(failed, ["storage", "agent"], "left_anti")
    archives = mirroring.filter_by_mode(buckets, "archive").select("storage", F.col("name").alias("bucket"), "prefix")
    uploads = doomed.join(archives, "storage").select(
        "storage", "agent", F.lit(1).alias("step"), F.lit("archive_upload").alias("action"), "bucket",
        F.concat("prefix", "file_name").alias("target"),
    )
    deletes = doomed.select(
        "storage", "agent", F.lit(2).alias("step"), F.lit("delete_local").alias("action"),
        F.lit(None).cast("string").alias("bucket"), F.col("file_name").alias("target"),
    )
    return uploads.unionByName(deletes)


def plan_post_commit(commits: DataFrame, rotated: DataFrame, buckets: DataFrame) -> DataFrame:
    """Actions after a commit, numbered per agent and bucket.

    ``commits`` has storage, agent, file_name of the new archive; ``rotated`` the archives retention removed, of
    which ``newest_removed`` marks one per agent. ``on_failure`` is ``stop`` where a failure ends the later steps of that bucket.
    Where ``commits`` has a boolean ``integrity_ok``, an archive that did not pass is neither mirrored nor followed
    by the removal of older ones.
    """
    if "integrity_ok" in commits.columns:
        passed = F.coalesce(F.col("integrity_ok"), F.lit(False))
        rotated = rotated.join(commits.filter(~passed).select("storage", "agent"), ["storage", "agent"], "left_anti")
        commits = commits.filter(passed)
    sides = buckets.select("storage", F.col("name").alias("bucket"), "prefix", "bmode", "sync_strategy", "retain")
    early_delete = F.coalesce(F.col("sync_strategy") == "space_efficient", F.lit(False))

    def action(step, name: str, key, on_failure: str):
        return F.struct(
            F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"),
            F.lit(name).alias("action"), key.alias("key"), F.lit(on_failure).alias("on_failure"),
        )

    new_key = F.concat("prefix", "file_name")
    upload_step = F.when(early_delete, 2).otherwise(1)
    per_commit = (
        commits.join(sides.filter(F.col("bmode") != "archive"), "storage")
        .withColumn("a", F.explode(
            F.when(
                F.col("bmode") == "offload",
                F.array(
                    action(1, "upload", new_key, "stop"), action(2, "delete_local", F.col("file_name"), "continue"),
                    action(3, "rotate_bucket", F.col("prefix"), "continue"),
                ),
            ).otherwise(F.array(action(upload_step, "upload", new_key, "stop")))
        ))
    )
    rotated_key = F.concat("prefix", "file_name")
    archived = F.array_compact(F.array(
        action(1, "upload_rotated", rotated_key, "continue"),
        F.when(F.col("newest_removed"), action(2, "rotate_bucket", F.col("prefix"), "continue")),
    ))
    mirrored = F.array(action(F.when(early_delete, 1).otherwise(2), "delete_remote", rotated_key, "continue"))
    per_rotated = (
        rotated.join(sides.filter(F.col("bmode") != "offload"), "storage")
        .withColumn("a", F.explode(F.when(F.col("bmode") == "archive", archived).otherwise(mirrored)))
    )
    columns = ["storage", "agent", "bucket", "bmode", "a.step", "a.action", "a.key", "a.on_failure"]
    return per_commit.select(*columns).unionByName(per_rotated.select(*columns))


def plan_retro_sync(backups: DataFrame, buckets: DataFrame, remote: DataFrame, layout: str = "rel_path") -> DataFrame:
    """Every archive and sync bucket with ``upload`` or ``skip``, by what the bucket already holds."""
    held = remote.select("storage", "bucket", "key").distinct().withColumn("_held", F.lit(True))
    return (
        mirroring.expand_storage_buckets(backups, buckets, layout)
        .join(held, ["storage", "bucket", "key"], "left")
        .withColumn("action", F.when(F.col("_held"), "skip").otherwise("upload"))
        .drop("_held")
    )


def retro_sync_totals(plan: DataFrame) -> DataFrame:
    """The totals expected if every planned upload works."""
    return mirroring.sync_result(
        plan.withColumn("outcome", F.when(F.col("action") == "skip", "skipped").otherwise("uploaded"))
    )
