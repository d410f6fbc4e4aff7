"""Orderings, last rows and trimming of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows in order, oldest first; all rows for ``n`` of zero or less.

    Each task keeps its own ``n`` newest rows, so ``n`` is to be the size of a page or a memory tail.
    """
    if n > 0:
        df = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return df.orderBy(*order)


def filter_session(snapshots: DataFrame, session_id, limit: int, order: list[str]) -> DataFrame:
    """The last snapshots of one session, or of all with an empty id."""
    chosen = snapshots.filter(F.col("session_id") == session_id) if session_id not in (None, "") else snapshots
    return recent(chosen, limit, order)


def trim_store(df: DataFrame, max_rows: int, order: list[str]) -> DataFrame:
    """A store that has outgrown ``max_rows`` keeps its last half of that; a smaller one stays whole."""
    return recent(df, max_rows // 2, order) if df.count() > max_rows else df


def ordered_listing(df: DataFrame, by: list[str]) -> DataFrame:
    return df.orderBy(*by)


def newest_first_view(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])
