"""Incremental indexing and conversation logs with Structured Streaming (an extension: batch imports replace the whole index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import text as t
from tidemark.operators import chunking


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a landing folder as a stream of documents."""
    return spark.readStream.schema(schema).parquet(path)


def index_stream(docs: DataFrame, chunks_path: str, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Chunk the arriving documents (with arrived_at) and append the chunks; a document whose content has come within the watermark is left out."""
    keyed = docs.withWatermark("arrived_at", watermark).withColumn("content_id", t.stable_id("content", F.col("source_key"), F.col("doc_pos"), F.col("page_content")))
    fresh = keyed.dropDuplicatesWithinWatermark(["content_id"])

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunked(batch.drop("arrived_at", "content_id")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """window_start, event_type, n, total: event counts in windows of event time, for appending output."""
    w = F.window("ts", width)
    return events.withWatermark("ts", watermark).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
