"""Message streams: a broker topic, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.schemas import MESSAGE, topic_for


def topic_stream(
    spark: SparkSession,
    event_type: str,
    servers: str,
    topic: str | None = None,
    starting_offsets: str = "earliest",
    max_offsets_per_batch: int | None = None,
) -> DataFrame:
    """Unbounded topic. Needs the Kafka connector on the class path at submit time.

    ``max_offsets_per_batch`` cuts a backlog into batches of that size; nothing is dropped.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic_for(event_type, topic))
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_batch)
    return reader.load()


def file_stream(
    spark: SparkSession,
    path: str,
    event_type: str,
    topic: str | None = None,
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet message files (key, value, topic, ...) as a stream, one topic of them."""
    reader = spark.readStream.schema(MESSAGE).format("parquet")
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.load(path).filter(F.col("topic") == topic_for(event_type, topic))
