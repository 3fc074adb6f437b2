"""Message parsing, the same for batch and streaming frames: projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adkpi.schemas import CORRUPT_FIELD, event_schema, zone_schema


def parse_messages(
    messages: DataFrame, event_type: str, ingest_ts: Column | None = None
) -> DataFrame:
    """Messages (partition, offset, timestamp, value) to raw-zone rows.

    Nothing is dropped: text that does not parse keeps its row, with the text beside it.
    """
    fields = event_schema(event_type)
    # Spark fills this extra field with the text whenever a message or a field is bad.
    checked = T.StructType([*fields, T.StructField(CORRUPT_FIELD, T.StringType())])
    parsed = F.from_json(
        F.col("value").cast("string"), checked, {"columnNameOfCorruptRecord": CORRUPT_FIELD}
    )
    return (
        messages.select(
            F.col("partition").alias("kafka_partition"),
            F.col("offset").alias("kafka_offset"),
            F.col("timestamp").alias("kafka_timestamp"),
            parsed.alias("data"),
            F.col("value").isNull().alias("_no_value"),
        )
        .select("kafka_partition", "kafka_offset", "kafka_timestamp", "data.*", "_no_value")
        .withColumns(
            {
                "raw_value": F.col(CORRUPT_FIELD),
                "is_malformed": F.col("_no_value") | F.col(CORRUPT_FIELD).isNotNull(),
                "event_timestamp": F.timestamp_seconds("timestamp"),
                "ingest_ts": F.current_timestamp() if ingest_ts is None else ingest_ts,
            }
        )
        .withColumns({"raw_date": F.to_date("ingest_ts"), "raw_hour": F.hour("ingest_ts")})
        .select(*zone_schema(event_type).fieldNames())
    )
