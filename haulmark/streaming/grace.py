"""Control losses of a stream, each settled by its first recovery within a grace.

A loss can only be settled in event order, and one key may have most of the events. So the stream keeps no state per key: each
micro-batch joins what is still open, a table in the shared folder, and settles what has become certain by the same ordered
pass over (key, slice) as the batch operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.timeline import grace_recovery


def control_loss_grace(events: DataFrame, path: str, key: str, grace_s: int, delay_s: int) -> DataFrame:
    """Run the stream over what is available: each loss with its nearest recovery within the grace, or ``control_lost``.

    ``events`` has the key, event_id, ts and lost (true for a loss); rows without key or time are ignored. Time is cut into slices of one
    grace. A loss is settled once the watermark, the newest time less ``delay_s``, has passed the slice after its own; what comes
    later for a settled slice is ignored, and its rows leave the table of open events. That table has two places, written
    in turn, so a batch that is repeated reads what it read before and replaces what it wrote.

    Results: the key, event_id, recovered_us and outcome.
    """
    spark, span_us = events.sparkSession, grace_s * 1_000_000
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        key, "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("lost", F.lit(False)).alias("lost"))
    schema = rows.schema

    def settled(watermark_us: int) -> Column:
        return (F.floor(F.unix_micros("ts") / F.lit(span_us)) + 2) * span_us <= watermark_us

    def watermark(held: DataFrame) -> int:
        newest = held.agg(F.max(F.unix_millis("ts"))).first()[0]
        return -(2**62) if newest is None else (newest - delay_s * 1000) * 1000

    def settle(batch: DataFrame, batch_id: int) -> None:
        arrived = batch
        if batch_id:
            before = spark.read.schema(schema).parquet(f"{path}/open/{(batch_id - 1) % 2}")
            arrived = before.unionByName(batch).filter(~settled(watermark(before)))
        place = f"{path}/open/{batch_id % 2}"
        arrived.write.mode("overwrite").parquet(place)
        held = spark.read.schema(schema).parquet(place)
        certain = settled(watermark(held))
        found = grace_recovery(
            held.filter(F.col("lost") & certain), held.filter(~F.col("lost")), [key], "ts",
            F.floor(F.unix_micros("ts") / F.lit(span_us)).cast("long"), "event_id", grace_s)
        found.select(key, "event_id", F.unix_micros("recovered_at").alias("recovered_us"), "outcome").write.mode("overwrite").parquet(
            f"{path}/settled/batch={batch_id}")

    query = rows.writeStream.foreachBatch(settle).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    types = dict(rows.dtypes)
    return spark.read.schema(f"{key} {types[key]}, event_id {types['event_id']}, recovered_us long, outcome string").parquet(f"{path}/settled").drop("batch")
