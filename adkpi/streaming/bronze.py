"""Message stream to the append-only raw zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from adkpi.operators.parse import parse_messages
from adkpi.paths import Layout
from adkpi.session import in_utc
from adkpi.sources.zones import FORMATS


@in_utc
def start(
    messages: DataFrame,
    event_type: str,
    layout: Layout,
    fmt: str = "parquet",
    trigger: str | None = None,
) -> StreamingQuery:
    """Append every message of one event type to its zone, partitioned by ingest hour.

    Late events land in new partitions, never in old ones. The checkpoint is per event
    type, so a restarted query goes on where it stopped. ``trigger`` is a processing time
    such as ``"1 minute"``; ``"available"`` reads what is there and ends; None starts a
    batch as soon as the one before is done.
    """
    if fmt not in FORMATS:
        raise ValueError(f"zone format must be one of {FORMATS}, not {fmt!r}")
    writer = (
        parse_messages(messages, event_type)
        .writeStream.format(fmt)
        .outputMode("append")
        .queryName(f"bronze-{event_type}")
        .option("checkpointLocation", layout.zone_checkpoint(event_type))
        .option("path", layout.zone(event_type))
        .partitionBy("raw_date", "raw_hour")
    )
    if trigger == "available":
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()
