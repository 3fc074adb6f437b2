"""Fixed schemas of the messages, zones and tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Event types and their default topics.
TOPICS = {
    "impression": "ad-impressions",
    "click": "ad-clicks",
    "conversion": "ad-conversions",
}

CORRUPT_FIELD = "_corrupt_record"


def topic_for(event_type: str, override: str | None = None) -> str:
    _require_event_type(event_type)
    return override or TOPICS[event_type]


def _require_event_type(event_type: str) -> None:
    if event_type not in TOPICS:
        raise ValueError(f"unknown event type {event_type!r}, expected one of {sorted(TOPICS)}")


def event_schema(event_type: str) -> T.StructType:
    """Payload of one message; the three types differ on purpose."""
    _require_event_type(event_type)
    schema = (
        T.StructType()
        .add("event_id", T.StringType())
        .add("event_type", T.StringType())
        .add("timestamp", T.LongType())
        .add("event_time", T.StringType())
    )
    if event_type != "impression":
        schema = schema.add("impression_timestamp", T.LongType())
    schema = schema.add("uid", T.StringType()).add("campaign", T.IntegerType())
    if event_type == "impression":
        schema = schema.add("cost", T.DoubleType())
    if event_type == "conversion":
        schema = schema.add("conversion_delay_sec", T.LongType())
    return schema


MESSAGE = (
    T.StructType()
    .add("key", T.StringType())
    .add("value", T.StringType())
    .add("topic", T.StringType())
    .add("partition", T.IntegerType())
    .add("offset", T.LongType())
    .add("timestamp", T.TimestampType())
)


def zone_schema(event_type: str) -> T.StructType:
    """One raw-zone row: message position, payload, both clocks, bad text, partitions."""
    schema = (
        T.StructType()
        .add("kafka_partition", T.IntegerType())
        .add("kafka_offset", T.LongType())
        .add("kafka_timestamp", T.TimestampType())
    )
    for field in event_schema(event_type):
        schema = schema.add(field)
    return (
        schema.add("raw_value", T.StringType())
        .add("is_malformed", T.BooleanType())
        .add("event_timestamp", T.TimestampType())
        .add("ingest_ts", T.TimestampType())
        .add("raw_date", T.DateType())
        .add("raw_hour", T.IntegerType())
    )


SILVER = (
    T.StructType()
    .add("event_id", T.StringType())
    .add("event_date", T.DateType())
    .add("uid", T.StringType())
    .add("campaign", T.IntegerType())
    .add("click", T.IntegerType())
    .add("conversion", T.IntegerType())
    .add("conversion_delay_sec", T.LongType())
    .add("cost", T.DoubleType())
    .add("updated_at", T.TimestampType())
)

_POSITION = (
    T.StructType()
    .add("ingest_ts", T.TimestampType())
    .add("kafka_partition", T.IntegerType())
    .add("kafka_offset", T.LongType())
)

# Fields of a copy in the order they are compared by.
STATE = (
    T.StructType()
    .add("event_id", T.StringType())
    .add("event_date", T.DateType())
    .add(
        "impression",
        T.StructType(
            [
                *_POSITION,
                T.StructField("event_timestamp", T.TimestampType()),
                T.StructField("cost", T.DoubleType()),
                T.StructField("campaign", T.IntegerType()),
                T.StructField("uid", T.StringType()),
            ]
        ),
    )
    .add("click", T.IntegerType())
    .add(
        "conversion",
        T.StructType([*_POSITION, T.StructField("conversion_delay_sec", T.LongType())]),
    )
)

GOLD = (
    T.StructType()
    .add("summary_date", T.DateType())
    .add("campaign", T.IntegerType())
    .add("impressions", T.LongType())
    .add("clicks", T.LongType())
    .add("conversions", T.LongType())
    .add("total_cost", T.DoubleType())
    .add("ctr", T.DoubleType())
    .add("cvr", T.DoubleType())
    .add("cpa", T.DoubleType())
    .add("late_conversion_count", T.LongType())
    .add("late_conversion_ratio", T.DoubleType())
    .add("avg_conversion_delay_sec", T.DoubleType())
    .add("p50_conversion_delay_sec", T.DoubleType())
    .add("p95_conversion_delay_sec", T.DoubleType())
    .add("updated_at", T.TimestampType())
)

KPI_STATE = (
    T.StructType()
    .add("summary_date", T.DateType())
    .add("campaign", T.IntegerType())
    .add("impressions", T.LongType())
    .add("clicks", T.LongType())
    .add("conversions", T.LongType())
    .add("total_cost", T.DoubleType())
    .add("late_conversion_count", T.LongType())
    .add("delay_sum", T.DoubleType())
    .add("delays", T.BinaryType())
)

CATEGORY_COLUMNS = [f"cat{i}" for i in range(1, 10)]


def normalised_schema(keep_cats: bool = False) -> T.StructType:
    """Normalised record. Campaign and cost stay text until events are built from them."""
    schema = (
        T.StructType()
        .add("timestamp", T.LongType())
        .add("uid", T.StringType())
        .add("campaign", T.StringType())
        .add("click", T.LongType())
        .add("conversion", T.LongType())
        .add("conversion_timestamp", T.LongType())
        .add("cost", T.StringType())
    )
    for name in CATEGORY_COLUMNS if keep_cats else []:
        schema = schema.add(name, T.StringType())
    return schema
