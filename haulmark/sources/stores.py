"""Append-only JSON line stores: reading, tails, appending, exporting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.operators.tails import recent, trim_store
from haulmark.schemas import STORE_TAIL

# The columns of an exported event file.
# JSON times keep their microseconds.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EXPORT_COLUMNS = ("timestamp", "level", "type", "agent", "message")


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON line store. Blank and malformed lines are skipped, a missing path has no rows."""
    fields = _struct(schema)
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)
    with_corrupt = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    entry = F.from_json(
        F.trim("value"), with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"},
    )
    objects = F.trim("value").startswith("{") & F.trim("value").endswith("}")
    return (
        lines.filter(objects).select(entry.alias("e")).filter(F.col("e._corrupt").isNull())
        .select(*[F.col(f"e.{name}").alias(name) for name in fields.names])
    )


def read_store_tail(spark: SparkSession, path: str, schema: T.StructType | str, kind: str, order: list[str]) -> DataFrame:
    """The newest rows of a store, as many as are held in memory for its kind."""
    return recent(read_jsonl_tolerant(spark, path, schema), STORE_TAIL[kind], order)


def append_store(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append rows to a store; rows without a time get the current one."""
    rows.withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp())).write.mode("append").json(
        path, timestampFormat=JSON_TIME
    )


def compact_store(
    spark: SparkSession, path: str, target: str, schema: T.StructType | str, max_rows: int, order: list[str]
) -> None:
    """Write a trimmed copy of a store to another path; the store itself is never overwritten while it is read."""
    append_store(trim_store(read_jsonl_tolerant(spark, path, schema), max_rows, order), target)


def export_events(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Write events as JSON lines, or as CSV of five columns with every value quoted and quotes doubled."""
    if fmt == "csv":
        events.select(*EXPORT_COLUMNS).write.csv(
            path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue=""
        )
    else:
        events.write.json(path, timestampFormat=JSON_TIME)
