"""Rates, progress and estimates of the time left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.sizes import _col, go_duration

MIB = 1024 * 1024
# Speeds stay hidden for the first seconds; full load in connections.
WARM_UP_SECONDS = 3.0
FULL_LOAD_CONNECTIONS = 100


def mbps(num_bytes, seconds) -> Column:
    """MiB per second; null where no time has passed."""
    return F.try_divide(_col(num_bytes), _col(seconds)) / F.lit(float(MIB))


def progress_pct(done, total, cap: bool = False) -> Column:
    """Percent done, 0 while the total is 0; ``cap`` limits it to 100 as the display does."""
    pct = F.when(_col(total) > 0, _col(done) / _col(total) * 100.0).otherwise(F.lit(0.0))
    return F.least(pct, F.lit(100.0)) if cap else pct


def speed(amount, elapsed_s) -> Column:
    """Amount per second, 0 during the warm-up."""
    return F.when(_col(elapsed_s) >= WARM_UP_SECONDS, _col(amount) / _col(elapsed_s)).otherwise(F.lit(0.0))


def eta_pessimistic(total_bytes, done_bytes, bytes_per_s, total_objects, done_objects, objects_per_s) -> Column:
    """Seconds left: the later of the byte and the object estimate; null while neither can be known."""

    def left(total, done, rate) -> Column:
        known = (_col(total) > 0) & (_col(rate) > 0)
        return F.when(known, F.greatest(_col(total) - _col(done), F.lit(0)) / _col(rate)).otherwise(F.lit(0.0))

    has_totals = (_col(total_bytes) > 0) | (_col(total_objects) > 0)
    has_speed = (_col(bytes_per_s) > 0) | (_col(objects_per_s) > 0)
    return F.when(
        has_totals & has_speed,
        F.greatest(
            left(total_bytes, done_bytes, bytes_per_s), left(total_objects, done_objects, objects_per_s)
        ),
    )


def eta_linear(done, total, elapsed_s) -> Column:
    """Whole seconds left at the average rate so far; null before the first step, 0 once done."""
    d, t = _col(done), _col(total)
    rate = F.try_divide(d, _col(elapsed_s))
    remaining = F.try_divide((t - d).cast("double"), rate)
    return F.when((t > 0) & (d >= t), F.lit(0).cast("long")).when((d > 0) & (t > d), F.floor(remaining).cast("long"))


def session_eta(done, total, elapsed_s, walk_complete) -> Column:
    """Estimate as text; unknown until the file walk has ended."""
    seconds = F.when(_col(walk_complete), eta_linear(done, total, elapsed_s))
    return F.coalesce(go_duration(seconds), F.lit("∞"))


def server_load(connections) -> Column:
    """Share of the load limit, at most 1."""
    return F.least(F.lit(1.0), _col(connections) / F.lit(float(FULL_LOAD_CONNECTIONS)))


def compression_ratio(disk_write, received) -> Column:
    """Bytes written per byte received in percent, null unless both are above zero."""
    return F.when((_col(received) > 0) & (_col(disk_write) > 0), _col(disk_write) / _col(received) * 100.0)
