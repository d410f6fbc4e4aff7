"""Which archives to remove: all but the newest of a directory or of a bucket.

Only the rows around the cut are ever ordered: names are cut into slices, slices are counted, and of the one slice
of a key in which the number kept is reached, rows are ranked. Older slices go and newer ones stay as they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from haulmark.functions.paths import is_backup_file
from haulmark.operators.slices import ROWS_PER_SLICE, name_slice

#: Names of a key that are candidates for bounds, and how many bounds one step of the search passes over.
CANDIDATES, STRIDE = 1024, 32


def name_bounds(df: DataFrame, keys: list[str], name: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Names that cut the rows of each key into slices of about ``rows_per_slice``: ``_bounds`` in order, ``_steps`` every 32nd of them.

    Keys with fewer rows have no row here. Candidates are at most 1,024 names a key, chosen by hash from a share of the rows;
    names that share a long beginning are cut like any others.
    """
    every = max(1, rows_per_slice // (4 * CANDIDATES))
    sample = df.filter(F.pmod(F.xxhash64(name), F.lit(every)) == 0)
    cells = sample.groupBy(*keys, F.pmod(F.xxhash64(name, F.lit(1)), F.lit(CANDIDATES)).alias("_cell")).agg(
        F.count("*").alias("_n"), F.min_by(name, F.xxhash64(name, F.lit(2))).alias("_name")
    )
    per_key = cells.groupBy(*keys).agg((F.sum("_n") * every).alias("_rows"), F.sort_array(F.collect_list("_name")).alias("_names"))
    apart = F.greatest(F.lit(1), F.ceil(F.size("_names") * F.lit(rows_per_slice) / F.col("_rows")))
    large = per_key.filter(F.col("_rows") > rows_per_slice).withColumn("_apart", apart)
    bounds = large.withColumn("_bounds", F.filter("_names", lambda x, i: i % F.col("_apart") == 0))
    return bounds.select(*keys, "_bounds", F.filter("_bounds", lambda x, i: i % STRIDE == 0).alias("_steps"))


def with_name_slices(df: DataFrame, keys: list[str], name: str, rows_per_slice: int) -> DataFrame:
    """Add ``_slice``, the number of bounds of the key that are not above the name."""
    def up_to(bounds) -> Column:
        return F.size(F.filter(bounds, lambda x: x <= F.col(name)))

    stride = F.greatest(up_to("_steps") - 1, F.lit(0)) * STRIDE
    bounded = df.join(name_bounds(df, keys, name, rows_per_slice), keys, "left").withColumn("_stride", stride)
    place = F.col("_stride") + up_to(F.slice("_bounds", F.col("_stride") + 1, STRIDE))
    return bounded.withColumn("_slice", F.when(F.col("_bounds").isNull(), 0).otherwise(place)).drop("_bounds", "_steps", "_stride")


def beyond_newest(sliced: DataFrame, keys: list[str], name: str, keep: str) -> DataFrame:
    """Rows beyond the newest ``keep`` by ``name`` of each key; ``newest_removed`` marks one row a key, the newest of them.

    ``_slice`` of the rows must not decrease along the names; it is what one task orders, and any slices give the same result.
    ``keep`` is the same on all rows of a key; null removes nothing, less than zero counts as zero. Of rows alike in name it is
    not defined which come first. Keys and names must not be null.
    """
    counted = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"), F.max(F.when(F.col(keep) < 0, 0).otherwise(F.col(keep))).alias("_keep"))
    before = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_newer", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = counted.filter("_keep IS NOT NULL AND _newer <= _keep AND _keep < _newer + _n").select(*keys, F.col("_slice").alias("_cut"), "_newer", "_keep")

    placed = sliced.join(cut, keys)
    older = placed.filter("_slice < _cut").withColumn("newest_removed", F.lit(False))
    rank = F.col("_newer") + F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(name).desc()))
    ranked = placed.filter("_slice = _cut").withColumn("_rank", rank).filter("_rank > _keep")
    ranked = ranked.withColumn("newest_removed", F.col("_rank") == F.col("_keep") + 1).drop("_rank")
    return older.unionByName(ranked).drop("_slice", "_cut", "_newer", "_keep")


def retention_candidates(backups: DataFrame, keep: str = "max_backups", directory: tuple[str, ...] = ("storage", "agent")) -> DataFrame:
    """Archives beyond the newest ``keep`` by name of each directory; none where ``keep`` is zero or less.

    Names begin with their day, which slices them. ``newest_removed`` marks one row per directory, the newest of those to go.
    """
    limited = backups.filter(is_backup_file("file_name") & (F.col(keep) > 0))
    return beyond_newest(limited.withColumn("_slice", name_slice("file_name")), list(directory), "file_name", keep)


def bucket_retention(objects: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Keys beyond the newest ``retain`` under the prefix of each bucket, over all agents together.

    ``objects`` carries ``prefix`` and ``retain`` of its bucket on every row. Any ``rows_per_slice`` gives the same
    result.
    """
    under = with_name_slices(objects.filter(F.startswith(F.col("key"), F.col("prefix"))), ["storage", "bucket"], "key", rows_per_slice)
    return beyond_newest(under, ["storage", "bucket"], "key", "retain").drop("newest_removed")
