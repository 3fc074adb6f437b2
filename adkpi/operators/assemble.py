"""Three raw zones to one silver row per impression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.functions.scalars import as_of_day
from adkpi.operators.latest import latest_per_key, split_rejects

_POSITION = ("kafka_partition", "kafka_offset")


def latest_impressions(impressions: DataFrame) -> DataFrame:
    keyed, _ = split_rejects(impressions)
    ties = (*_POSITION, "event_timestamp", "cost", "campaign", "uid")
    return latest_per_key(keyed, ties=ties)


def latest_conversions(conversions: DataFrame) -> DataFrame:
    keyed, _ = split_rejects(conversions)
    return latest_per_key(keyed, ties=(*_POSITION, "conversion_delay_sec"))


def assemble_silver(
    impressions: DataFrame,
    clicks: DataFrame,
    conversions: DataFrame,
    updated_at: Column | None = None,
    fixed_dates_since: Column | None = None,
) -> DataFrame:
    """Impression left-joined to its click and its conversion.

    Every side is unique by ``event_id`` before the joins and carries only the columns it
    adds, so no key is hot and each zone is shuffled once. Of a click only its presence
    matters: a distinct, combined before the shuffle, replaces the ranking.

    ``fixed_dates_since`` filters impressions by date before the ranking, so the filter
    reaches the scan. Use it only where all copies of an id carry one event time.
    """
    if fixed_dates_since is not None:
        impressions = impressions.filter(
            F.col("event_timestamp") >= fixed_dates_since.cast("timestamp")
        )
    base = latest_impressions(impressions).select(
        "event_id",
        F.to_date("event_timestamp").alias("event_date"),
        "uid",
        F.col("campaign").try_cast("int").alias("campaign"),
        F.col("cost").try_cast("double").alias("cost"),
    )
    clicked = split_rejects(clicks)[0].select("event_id").distinct()
    converted = latest_conversions(conversions).select(
        "event_id",
        F.lit(1).alias("conversion"),
        F.col("conversion_delay_sec").try_cast("bigint").alias("conversion_delay_sec"),
    )
    joined = base.join(clicked.withColumn("click", F.lit(1)), "event_id", "left").join(
        converted, "event_id", "left"
    )
    return joined.select(
        "event_id",
        "event_date",
        "uid",
        "campaign",
        F.coalesce("click", F.lit(0)).alias("click"),
        F.coalesce("conversion", F.lit(0)).alias("conversion"),
        "conversion_delay_sec",
        "cost",
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )


def recent_days(
    df: DataFrame, days: int, as_of: dt.date | None = None, day: str = "event_date"
) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on, without an upper bound."""
    return df.filter(F.col(day) >= first_recent_day(days, as_of))


def first_recent_day(days: int, as_of: dt.date | None = None) -> Column:
    return F.date_sub(as_of_day(as_of), days)


def orphan_events(events: DataFrame, impressions: DataFrame) -> DataFrame:
    """Click or conversion ids that have no impression (yet)."""
    ids = split_rejects(events)[0].select("event_id").distinct()
    known = split_rejects(impressions)[0].select("event_id").distinct()
    return ids.join(known, "event_id", "left_anti")


def touched_ids(zones: dict[str, DataFrame], since: dt.date) -> DataFrame:
    """Ids with any copy ingested on or after ``since``; reads only those partitions."""
    ids = [
        split_rejects(zone.filter(F.col("raw_date") >= F.lit(since)))[0].select("event_id")
        for zone in zones.values()
    ]
    merged = ids[0]
    for other in ids[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def assemble_touched(
    zones: dict[str, DataFrame],
    ids: DataFrame,
    updated_at: Column | None = None,
) -> DataFrame:
    """Silver rows of the given distinct ids only, equal to those of a full rebuild.

    The zones are thinned out before anything is ranked, by one plan at every size. Staged
    ``ids`` carry their size, so Spark itself broadcasts them as long as they are small; beyond
    that the join and the ranking share their partitioning by id.
    """
    narrowed = {kind: z.join(ids, "event_id", "left_semi") for kind, z in zones.items()}
    return _assemble_zones(narrowed, updated_at)


def _assemble_zones(zones: dict[str, DataFrame], updated_at: Column | None) -> DataFrame:
    return assemble_silver(zones["impression"], zones["click"], zones["conversion"], updated_at)
