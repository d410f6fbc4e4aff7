"""Running a stream over what is available now, and writing its results to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.timeline import latest_per_key


def write_append(stream: DataFrame, path: str) -> None:
    """Process what is available and append the results to a parquet table."""
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{path}.checkpoint").option("path", path)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_updates(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Process what is available and keep the changes of each micro-batch in a partition of its own.

    Repeating a batch after a failure overwrites its partition, so no change counts twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows an append stream has written."""
    return spark.read.schema(like.schema).parquet(path)


def read_latest(spark: SparkSession, path: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """Current state of an update stream: the newest change of each key."""
    changes = spark.read.schema(like.schema.add("batch", "long")).parquet(path)
    return latest_per_key(changes, keys, ["batch"]).drop("batch")


def run_append(stream: DataFrame, path: str) -> DataFrame:
    write_append(stream, path)
    return read_results(stream.sparkSession, path, stream)


def run_updates(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    write_updates(stream, path)
    return read_latest(stream.sparkSession, path, stream, keys)


def session_end_fanout(ended: DataFrame, history_path: str, events_path: str) -> None:
    """Write each ended session both to the history and to the event store.

    Both tables are partitioned by batch, so a repeated batch replaces its rows in either.
    """

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        events = batch.select(
            F.col("finished_at").alias("timestamp"),
            F.when(F.col("result") == "ok", "info").otherwise("error").alias("level"),
            F.lit("session_end").alias("type"), F.col("agent").cast("string").alias("agent"),
            F.concat(F.lit("session "), F.col("session_id").cast("string"), F.lit(": "), F.col("result")).alias("message"),
        )
        events.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        batch.unpersist()

    query = (
        ended.writeStream.foreachBatch(fan_out).option("checkpointLocation", f"{history_path}.checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
