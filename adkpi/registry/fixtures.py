"""Zones, messages and combined records derived from the given test tables.

The mapping is described in FIXTURES.md and repeated in SQL in ``oracle.py``. Every frame
reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.functions.scalars import clamped_delay
from adkpi.schemas import event_schema
from adkpi.session import checkpoint_dir
from adkpi.sources.tables import DayTable

CAMPAIGNS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, and pending orders a second time: a day later, at twice the cost."""
    orders = table(spark, sf_dir, "orders")
    moment = F.col("o_orderdate").cast("timestamp")
    again = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(1)))
    copies = orders.withColumn("_copy", F.explode(F.coalesce(again, F.array(F.lit(0)))))
    return copies.select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        moment.alias("event_timestamp"),
        F.timestamp_seconds(F.unix_timestamp(moment) + F.col("_copy") * 86400).alias("ingest_ts"),
        F.col("o_custkey").cast("string").alias("uid"),
        (F.col("o_custkey") % CAMPAIGNS).cast("int").alias("campaign"),
        (F.col("o_totalprice") * (F.col("_copy") + 1)).alias("cost"),
    )


def clicks(spark: SparkSession, sf_dir: str, view_through: bool = False) -> DataFrame:
    """Shipped lines as clicks; the view-through variant leaves converted lines out."""
    flags = ["N"] if view_through else ["N", "R"]
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(flags))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("ingest_ts"),
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines; the delay runs from the order, and is 0 where it would be negative."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped, ordered = (
        F.unix_timestamp(F.col(c).cast("timestamp")) for c in ("l_shipdate", "o_orderdate")
    )
    return joined.select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("ingest_ts"),
        clamped_delay(shipped, ordered).alias("conversion_delay_sec"),
    )


def zones(spark: SparkSession, sf_dir: str, view_through: bool = False) -> dict[str, DataFrame]:
    """The three zones, with the ingest day a streaming sink would partition them by."""
    frames = {
        "impression": impressions(spark, sf_dir),
        "click": clicks(spark, sf_dir, view_through),
        "conversion": conversions(spark, sf_dir),
    }
    return {k: f.withColumn("raw_date", F.to_date("ingest_ts")) for k, f in frames.items()}


def combined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text records, one per order, with the blanks and bad cells raw files have."""
    lines = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    shipped = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    per_order = lines.groupBy("l_orderkey").agg(
        F.max(F.when(flag.isin("N", "R"), 1)).alias("clicked"),
        F.max(F.when(flag == "R", shipped)).alias("converted_at"),
    )
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ordered = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return joined.select(
        F.col("o_orderkey").alias("row_key"),
        F.when(priority == "4-NOT SPECIFIED", "unknown").otherwise(ordered).alias("timestamp"),
        F.col("o_custkey").cast("string").alias("uid"),
        (F.col("o_custkey") % CAMPAIGNS).cast("string").alias("campaign"),
        F.when(F.col("clicked") == 1, "1")
        .when(status == "F", "")
        .otherwise("0")
        .alias("click"),
        F.when(F.col("converted_at").isNotNull(), "1").otherwise("0").alias("conversion"),
        F.when(status == "O", F.coalesce(F.col("converted_at").cast("string"), F.lit("-1")))
        .otherwise(F.coalesce(F.col("converted_at").cast("string"), F.lit("")))
        .alias("conversion_timestamp"),
        F.when(priority == "5-LOW", "")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("cost"),
    )


def messages(spark: SparkSession, sf_dir: str, kind: str = "impression") -> DataFrame:
    """Every row of ``events`` as a message of one kind, positions as a broker gives them.

    Clicks and conversions tell of an impression as many seconds ago as their user's number.
    """
    rows = table(spark, sf_dir, "events")
    moment = F.col("ts").cast("timestamp")
    fields = {
        "event_id": F.col("event_id").cast("string"),
        "event_type": F.lit(kind),
        "timestamp": F.unix_timestamp(moment),
        "impression_timestamp": F.unix_timestamp(moment) - F.col("user_id"),
        "uid": F.col("user_id").cast("string"),
        "campaign": F.get_json_object("props", "$.k").cast("bigint") % CAMPAIGNS,
        "cost": F.col("value"),
        "conversion_delay_sec": F.col("user_id").cast("bigint"),
    }
    named = [fields[f].alias(f) for f in event_schema(kind).fieldNames() if f in fields]
    # Error events stand for text that is no JSON.
    broken = F.concat(F.lit("broken "), F.col("event_id").cast("string"))
    text = F.when(F.col("event_type") == "error", broken).otherwise(F.to_json(F.struct(*named)))
    return rows.select(
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        moment.alias("timestamp"),
        text.cast("binary").alias("value"),
    )


_made: dict[tuple[str, str, str], DayTable] = {}


def stored(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    like: DayTable,
    rows: Callable[[], DataFrame],
    read_only: bool = False,
) -> DayTable:
    """A table that earlier runs would have left: a copy for one query to write to, or itself.

    The table is written once in an application, below the checkpoint folder; a copy shares
    its data folders and begins at its only version.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    root = f"{checkpoint_dir(spark)}/adkpi-{name}"
    if key not in _made:
        table = DayTable(f"{root}-{uuid.uuid4().hex}", like.schema, like.day, like.keys, like.null_safe)
        table.overwrite_days(rows())
        _made[key] = table
    if read_only:
        return _made[key]
    return _made[key].clone(spark, f"{root}-{uuid.uuid4().hex}")
