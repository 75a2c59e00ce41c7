"""Structured Streaming: documents as files arrive, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.chunk import ChunkConfig, chunk_documents


def chunk_stream(spark: SparkSession, documents: str, schema: str, out: str, checkpoint: str, config: ChunkConfig) -> StreamingQuery:
    """Chunks the Parquet files of ``documents`` that are new since the last call, appends them to ``out`` and ends.

    A batch writes to a folder of its own number, so one that is run again after a failure replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        chunk_documents(df, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(documents)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and event type; rows later than ``late`` behind the newest are dropped by a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
