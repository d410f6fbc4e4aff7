"""Listings of files, local archives and remote objects.

Spark's own file index leaves out empty files, hidden files and directories, which an inventory must hold. So
the tree is walked level by level: tasks list the directories of one level, the level is written to the shared
folder, and its directories that no rule excludes are the work of the next round.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.paths import basename, is_excluded, rel_path
from haulmark.operators.inventory import backup_files
from haulmark.session import scratch_path

ENTRIES_PER_BATCH = 10_000
_COLUMNS = ["root_no", "path", "entry_type", "size", "mtime_us"]
_ENTRY = "root_no int, path string, entry_type string, size long, mtime_us long"


def local_path(address: str) -> str | None:
    """The path behind a local address, None for another file system."""
    if address.startswith("file:/"):
        return "/" + address[len("file:/"):].lstrip("/")
    return address if address.startswith("/") else None


def _local_entry(path: str, info: os.stat_result) -> tuple:
    kind = "dir" if stat.S_ISDIR(info.st_mode) else "symlink" if stat.S_ISLNK(info.st_mode) else "file"
    if kind == "file" and not stat.S_ISREG(info.st_mode):
        kind = "other"
    return path, kind, info.st_size, info.st_mtime_ns // 1000


def _children(address: str) -> Iterator[tuple]:
    """Entries of one directory. Only local entries that may not be read, or are gone meanwhile, are skipped; any other
    failure, and every one of a remote store, fails the task, so that no listing is silently incomplete."""
    path = local_path(address)
    if path is not None:
        try:
            with os.scandir(path) as entries:
                for entry in entries:
                    try:
                        yield _local_entry(entry.path, entry.stat(follow_symlinks=False))
                    except (PermissionError, FileNotFoundError):
                        continue
        except (PermissionError, FileNotFoundError):
            return
        return
    system, name = pafs.FileSystem.from_uri(address)
    scheme = address.split("://")[0]
    for info in system.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
        kind = "dir" if info.type == pafs.FileType.Directory else "file"
        yield f"{scheme}://{info.path}", kind, info.size or 0, (info.mtime_ns or 0) // 1000


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for root_no, path in zip(batch["root_no"].tolist(), batch["path"].tolist()):
            for entry in _children(path):
                rows.append((root_no, *entry))
                if len(rows) >= ENTRIES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
    yield pd.DataFrame(rows, columns=_COLUMNS)


def _describe_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for root_no, address in zip(batch["root_no"].tolist(), batch["path"].tolist()):
            path = local_path(address)
            if path is None:
                rows.append((root_no, address.rstrip("/"), "dir", 0, 0))
                continue
            try:
                rows.append((root_no, *_local_entry(os.path.normpath(path), os.lstat(path))))
            except (PermissionError, FileNotFoundError):
                continue
        yield pd.DataFrame(rows, columns=_COLUMNS)


def walk(spark: SparkSession, roots: list[str], skipped: Column) -> DataFrame:
    """Everything below the roots and the roots themselves; skipped directories are not entered.

    ``skipped`` may use path, rel_path and entry_type. A root listed twice, or inside another, counts twice.
    """
    target = scratch_path(spark, "inventory")
    entries = spark.createDataFrame(list(enumerate(roots)), "root_no int, path string").mapInPandas(_describe_roots, _ENTRY)
    level = 0
    while True:
        plain = F.regexp_replace("path", "^[A-Za-z0-9]+:/*(?=/)", "")
        entries.withColumn("rel_path", rel_path(plain)).filter(~skipped).write.parquet(f"{target}/level={level}")
        directories = spark.read.parquet(f"{target}/level={level}").filter("entry_type = 'dir'").select("root_no", "path")
        if directories.isEmpty():
            break
        entries = directories.repartition("root_no", "path").mapInPandas(_list_level, _ENTRY)
        level += 1
    return spark.read.parquet(target).withColumn("mtime", F.timestamp_micros("mtime_us")).drop("mtime_us", "level")


def scan_inventory(spark: SparkSession, roots: list[str], excludes: list[str] = ()) -> DataFrame:
    """Files, directories and links below the roots, in the order of the roots, without excluded subtrees."""
    return walk(spark, roots, is_excluded("rel_path", F.col("entry_type") == "dir", list(excludes)))


def scan_backups(spark: SparkSession, base_dir: str) -> DataFrame:
    """Finished archives below a folder in order of their path within it, without unfinished chunk folders."""
    unfinished = (F.col("entry_type") == "dir") & basename("path").startswith("chunks_")
    found = walk(spark, [base_dir], unfinished).filter("entry_type <> 'dir'")
    base = local_path(base_dir) or base_dir
    inside = F.substr(F.col("path"), F.lit(len(base.rstrip("/")) + 2))
    return list_backups(found.withColumn("rel_path", inside))


def list_backups(listing: DataFrame) -> DataFrame:
    """Finished archives of a listing with ``rel_path``, in order."""
    return backup_files(listing).orderBy("rel_path")


def scan_remote_listing(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects whose key starts with the prefix, in order of the key."""
    return objects.filter(F.col("key").startswith(prefix)).orderBy("key")
