"""Event-time windows, and a stream as a writer of a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Database


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Rows and sums of ``value`` by tumbling window and keys; rows later than ``late`` are let go. Batch or stream."""
    timed = events.withColumn("__t", F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    made = timed.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def append_stream(stream: DataFrame, db: Database, table: str, checkpoint: str):
    """Write each micro-batch to a table as one commit; a batch that was committed before a failure is not repeated.

    The table needs an INT column ``batch``, which tells the batches that it has.
    """

    def put(batch: DataFrame, number: int) -> None:
        done = db.spark_sql(f"SELECT 1 FROM {table} WHERE batch = {number} LIMIT 1").count()
        if not done:
            db.bulk_insert(table, batch.withColumn("batch", F.lit(number).cast("long")))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
