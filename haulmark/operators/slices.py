"""Ordered computations per key that survive one key holding a large share of all rows.

A plain window ``partitionBy(key).orderBy(ts)`` sends every row of a key to one task. Here the ordered
domain of each key is cut into slices (a span of time, a span of sequence numbers, a name prefix). Rows are
windowed per (key, slice); what a slice needs from the ones before it is one aggregated row per slice, which
enters the slice as a seed row. The large shuffle is therefore spread over (key, slice), and only the slice
totals, partially aggregated on the map side, are ever ordered per key.

Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SEQUENCES_PER_SLICE = 65_536
SECONDS_PER_SLICE = 3_600
ROWS_PER_SLICE = 1_000_000  # of names, where bounds come from a sample

_SLICE = "_slice"
_SEED = "_seed"


def sequence_slice(column: str, width: int = SEQUENCES_PER_SLICE) -> Column:
    """Slice of an integer sequence number: at most ``width`` distinct values share one."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def time_slice(column: str, seconds: int = SECONDS_PER_SLICE) -> Column:
    """Slice of a timestamp column."""
    return F.floor(F.unix_seconds(F.col(column)) / F.lit(seconds)).cast("long")


def name_slice(column: str, length: int = 10) -> Column:
    """Slice of a string column: its first characters, ten for the day of a dated archive name."""
    return F.substring(F.col(column), 1, length)


def running_by_slice(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    *,
    descending: bool = False,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over ``order`` within ``keys``.

    sums          running total up to and including the row
    maxes         running maximum up to and including the row
    maxes_before  running maximum of the rows before
    lasts         last value that is not null up to and including the row
    previous      value of the row before, null on the first row of a key

    ``slice_by`` must not decrease along ``order`` (not increase where ``descending``).
    """
    sums, maxes, maxes_before, lasts, previous = (
        group or {} for group in (sums, maxes, maxes_before, lasts, previous)
    )
    measures = {**sums, **maxes, **maxes_before, **lasts, **previous}
    inputs = {name: f"_in_{name}" for name in measures}

    rows = df.withColumns({inputs[name]: expr for name, expr in measures.items()} | {_SLICE: slice_by})
    order_value = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    latest = F.min_by if descending else F.max_by

    totals = []
    for name in sums:
        totals.append(F.sum(inputs[name]).alias(inputs[name]))
    for name in (*maxes, *maxes_before):
        totals.append(F.max(inputs[name]).alias(inputs[name]))
    for name in lasts:
        known = F.when(F.col(inputs[name]).isNotNull(), order_value)
        totals.append(latest(inputs[name], known).alias(inputs[name]))
    for name in previous:
        totals.append(latest(inputs[name], order_value).alias(inputs[name]))
    per_slice = rows.groupBy(*keys, _SLICE).agg(*totals)

    slice_order = F.col(_SLICE).desc() if descending else F.col(_SLICE).asc()
    along = Window.partitionBy(*keys).orderBy(slice_order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(inputs[n]).over(before).alias(inputs[n]) for n in sums]
    carried += [F.max(inputs[n]).over(before).alias(inputs[n]) for n in (*maxes, *maxes_before)]
    carried += [F.last(inputs[n], ignorenulls=True).over(before).alias(inputs[n]) for n in lasts]
    carried += [F.lag(inputs[n]).over(along).alias(inputs[n]) for n in previous]
    seeds = (
        per_slice.select(*keys, _SLICE, F.lit(True).alias(_SEED), F.lag(_SLICE).over(along).alias("_earlier"), *carried)
        .filter(F.col("_earlier").isNotNull())
        .drop("_earlier")
    )

    seeded = rows.withColumn(_SEED, F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    row_order = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    within = Window.partitionBy(*keys, _SLICE).orderBy(F.col(_SEED).desc(), *row_order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    results = {n: F.sum(inputs[n]).over(so_far) for n in sums}
    results |= {n: F.max(inputs[n]).over(so_far) for n in maxes}
    results |= {
        n: F.max(inputs[n]).over(within.rowsBetween(Window.unboundedPreceding, -1)) for n in maxes_before
    }
    results |= {n: F.last(inputs[n], ignorenulls=True).over(so_far) for n in lasts}
    results |= {n: F.lag(inputs[n]).over(within) for n in previous}
    kept = [c for c in df.columns if c not in results]
    return (
        seeded.select(*kept, _SEED, *[expr.alias(name) for name, expr in results.items()])
        .filter(~F.col(_SEED))
        .drop(_SEED)
    )
