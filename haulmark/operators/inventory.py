"""File inventories: exclusion, roots, totals, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import paths


def _is_dir():
    return F.col("entry_type") == "dir"


def glob_exclude(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    """Drop entries that a pattern matches themselves."""
    return files.filter(~paths.is_excluded(path, _is_dir(), patterns))


def prune_excluded_dirs(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    """Drop entries that a pattern matches, and everything below a matched directory."""
    return files.filter(~paths.is_pruned(path, _is_dir(), patterns))


def prescan(files: DataFrame) -> DataFrame:
    """Number of entries, directories included, and bytes of the regular files."""
    return files.agg(
        F.count("*").alias("total_objects"),
        F.coalesce(F.sum(F.when(F.col("entry_type") == "file", F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def with_directories(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Add one ``dir`` entry per directory above the given files."""
    parts = F.split(F.col(path), "/")
    parents = files.filter(F.col(path).contains("/")).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
            )
        ).alias(path)
    )
    dirs = parents.filter(F.col(path) != "").distinct().withColumn("entry_type", F.lit("dir"))
    return files.unionByName(dirs, allowMissingColumns=True)


def multi_root_union(roots: list[DataFrame]) -> DataFrame:
    """Entries of all roots in order of the roots; overlapping roots are listed twice."""
    numbered = [root.withColumn("root_no", F.lit(n)) for n, root in enumerate(roots)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def backup_files(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Finished archives outside the folders of unfinished chunks."""
    return files.filter(paths.is_backup_file(path) & ~F.col(path).rlike("(^|/)chunks_[^/]*/"))
