"""Status words, bands and hints derived from measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.sizes import _col

# Thresholds of the status words and gauges.
RUNNING_BELOW_S = 10
IDLE_BELOW_S = 60
BANDS = {"agents": (50, 80), "buffer": (50, 80), "storage": (70, 90), "sync": (40, 80)}
BLOCKED_FLOOR_MS = 100
FLOW_MARGIN = 0.92
FLOW_FILL_PERCENT = 10
SCALER_STATES = {0: "stable", 1: "scaling_up", 2: "scaling_down", 3: "probing"}


def idle_seconds(last_activity, now) -> Column:
    """Seconds between two timestamps, with fractions."""
    return (F.unix_micros(_col(now)) - F.unix_micros(_col(last_activity))) / 1e6


def _by_idle(idle: Column) -> Column:
    return F.when(idle < RUNNING_BELOW_S, "running").when(idle < IDLE_BELOW_S, "idle").otherwise("degraded")


def session_status(last_activity, now, closing=None) -> Column:
    """Status of a session by its idle time; ``finalizing`` while it closes."""
    status = _by_idle(idle_seconds(last_activity, now))
    return status if closing is None else F.when(_col(closing), "finalizing").otherwise(status)


def stream_status(active, slot_status, idle_s, slow_s, eval_window_s: float) -> Column:
    """Status of one stream; ``slow_s`` is how long it has been slow, null if it is not."""
    return (
        F.when(~_col(active), F.when(_col(slot_status) == "disabled", "disabled").otherwise("disconnected"))
        .when(_col(slow_s) >= eval_window_s, "degraded")
        .when(_col(slow_s).isNotNull(), "slow")
        .otherwise(_by_idle(F.floor(_col(idle_s))))
    )


def usage_band(pct, kind: str) -> Column:
    """low, med or high by the thresholds of the gauge; a missing value counts as 0."""
    medium, high = BANDS[kind]
    value = F.coalesce(_col(pct), F.lit(0))
    return F.when(value >= high, "high").when(value >= medium, "med").otherwise("low")


def is_critical(pct) -> Column:
    """Storage alert: 90 percent or more in use."""
    return F.coalesce(_col(pct), F.lit(0)) >= BANDS["storage"][1]


def bottleneck(blocked_ms, idle_ms) -> Column:
    """Which side holds the transfer back."""
    blocked, idle = _col(blocked_ms), _col(idle_ms)
    return (
        F.when((blocked > idle) & (blocked > BLOCKED_FLOOR_MS), "network")
        .when((idle > blocked) & (idle > BLOCKED_FLOOR_MS), "producer")
        .otherwise("balanced")
    )


def flow_hint(producer, drain, fill_percent) -> Column:
    """Is the producer or the drain the limit?"""
    p, d, fill = _col(producer), _col(drain), _col(fill_percent)
    return (
        F.when((p < d * FLOW_MARGIN) & (fill < FLOW_FILL_PERCENT), "Producer-Limited")
        .when((d < p * FLOW_MARGIN) | (fill >= FLOW_FILL_PERCENT), "Transport/Drain-Limited")
        .otherwise("Balanced")
    )


def skew_percent(producer, drain) -> Column:
    """How far the producer is from the drain, in percent of the drain (of 1 if there is none)."""
    base = F.when(_col(drain) > 0, _col(drain)).otherwise(F.lit(1.0))
    return (_col(producer) - _col(drain)) / base * 100.0


def derive_level(result) -> Column:
    """Event level of a session result."""
    return F.when(_col(result) == "ok", "info").otherwise("error")


def normalize_level(level) -> Column:
    """Log level; anything unknown is info."""
    low = F.lower(_col(level))
    return (
        F.when(low == "debug", "debug").when(low.isin("warn", "warning"), "warn").when(low == "error", "error")
        .otherwise("info")
    )


def scaler_state(code) -> Column:
    """Text of a numeric scaler state; unknown numbers are stable."""
    text = F.lit("stable")
    for number, name in SCALER_STATES.items():
        text = F.when(_col(code) == number, name).otherwise(text)
    return text


def effective_scaler_state(state, active, max_streams) -> Column:
    """Scaling up at the maximum of streams shows as stable."""
    return F.when((_col(state) == "scaling_up") & (_col(active) >= _col(max_streams)), "stable").otherwise(_col(state))


def efficiency_percent(efficiency) -> Column:
    """Gauge position: 0 to 2 becomes 0 to 100, rounded half up."""
    return F.least(F.lit(100), F.floor(_col(efficiency) * 50 + 0.5)).cast("long")


def efficiency_band(efficiency) -> Column:
    """Gauge colour: low is healthy."""
    return F.when(_col(efficiency) >= 1.0, "low").when(_col(efficiency) >= 0.6, "med").otherwise("high")
