"""Normalised CSV to keyed JSON messages, one topic per event type."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adkpi.operators.explode import event_payloads, split_unusable, with_event_ids
from adkpi.operators.position import first_by_time
from adkpi.schemas import TOPICS
from adkpi.session import in_utc
from adkpi.sources.delimited import ROW_ID, read_normalised_csv


def messages(
    records: DataFrame, limit: int | None = None, source_label: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """All message rows of the records, and the records no event can be built from."""
    numbered = records.withColumn(ROW_ID, F.monotonically_increasing_id())
    # Content before row id: only exact copies are told apart by where they were read.
    ties = [*[c for c in records.columns if c != "timestamp"], ROW_ID]
    chosen = numbered if limit is None else first_by_time(numbered, limit, *ties)
    usable, unusable = split_unusable(with_event_ids(chosen, ["timestamp", *ties], source_label))
    return event_payloads(usable), unusable.select(*records.columns)


@in_utc
def run(
    spark: SparkSession,
    source: str,
    out: str,
    limit: int | None = None,
    source_label: str | None = None,
    servers: str | None = None,
) -> dict[str, Any]:
    """Write messages to a broker if one is given, else append Parquet message files.

    Unusable records go to ``out/rejects``. Ids carry ``source_label``, by default a short
    digest of the source's path; an empty label numbers every source from ``evt_00000000``.
    """
    if source_label is None:
        source_label = hashlib.md5(source.rstrip("/").encode()).hexdigest()[:8]
    rows, unusable = messages(read_normalised_csv(spark, source), limit, source_label)
    # Counted by the writes themselves; what is written is not read again.
    sent, left = Observation("messages"), Observation("rejects")
    by_topic = [F.count_if(F.col("topic") == name).alias(name) for name in TOPICS.values()]
    rows = rows.observe(sent, *by_topic)
    unusable = unusable.observe(left, F.count(F.lit(1)).alias("rows"))
    if servers:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        rows.write.mode("append").parquet(f"{out}/messages")
    unusable.write.mode("append").parquet(f"{out}/rejects")
    return {
        "messages": {topic: n for topic, n in sent.get.items() if n},
        "rejects": left.get["rows"],
    }
