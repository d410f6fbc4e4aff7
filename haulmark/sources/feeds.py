"""Incremental feeds from folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _limited(reader, max_files: int | None):
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def read_chunk_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """Chunk rows (or any parquet rows) as they are added to a folder."""
    return _limited(spark.readStream.schema(schema), max_files).parquet(path)


def read_telemetry_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None
) -> DataFrame:
    """Telemetry records as JSON lines as they are added to a folder."""
    return _limited(spark.readStream.schema(schema), max_files).json(path)
