"""Registered queries over the given tables. Each has its SQL twin in ``oracle.py``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adkpi.functions.scalars import clamped_delay
from adkpi.operators.assemble import (
    assemble_silver,
    latest_impressions,
    orphan_events,
    recent_days,
)
from adkpi.operators.explode import (
    click_events,
    conversion_events,
    event_payloads,
    impression_events,
    split_unusable,
    with_event_ids,
)
from adkpi.operators.kpi_state import kpi_state, kpis_of, merged
from adkpi.operators.kpis import campaign_base, campaign_kpis
from adkpi.operators.latest import split_rejects
from adkpi.operators.normalise import normalise, rebase_offset, timestamp_range
from adkpi.operators.parse import parse_messages
from adkpi.operators.position import first_by_time, sorted_by_time, with_position, with_splits
from adkpi.operators.profile import dataset_profile
from adkpi.operators.quality import rules, violation_counts
from adkpi.operators.sample import fixed_size_sample
from adkpi.operators.state import event_rows, event_state, merged_state, silver_rows
from adkpi.operators.upsert import changed_rows, overwrite_days_frames, upsert_table
from adkpi.paths import Layout
from adkpi.plans.silver import stored_state
from adkpi.registry import fixtures
from adkpi.session import staged
from adkpi.sources.tables import DayTable

# Parameters the oracle repeats.
CUT_DAY = dt.date(1998, 1, 1)
AS_OF = dt.date(2001, 8, 1)
WINDOW_DAYS = 365
MERGE_AS_OF = dt.date(2000, 1, 1)
MERGE_WINDOW_DAYS = 1095
TOUCHED_SINCE = dt.date(2001, 6, 1)
SAMPLE_SIZE = 1000
FIRST_ROWS = 1000
INITIAL, BATCHES, QUICK = 8000, (200, 300, 400, 500, 600), 1000

SILVER_COLUMNS = (
    "event_id",
    "event_date",
    "uid",
    "campaign",
    "click",
    "conversion",
    "conversion_delay_sec",
    "cost",
)
RECORD_COLUMNS = (
    "timestamp",
    "uid",
    "campaign",
    "click",
    "conversion",
    "conversion_timestamp",
    "cost",
)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(
        *[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def _before(zone: DataFrame, day: dt.date) -> DataFrame:
    return zone.filter(F.col("raw_date") < F.lit(day))


def _silver(spark: SparkSession, sf_dir: str, view_through: bool = False) -> DataFrame:
    z = fixtures.zones(spark, sf_dir, view_through)
    silver = assemble_silver(z["impression"], z["click"], z["conversion"])
    return silver.select(*SILVER_COLUMNS)


def _early_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as it stood when only what was ingested before the cut day had come in."""
    z = {k: _before(f, CUT_DAY) for k, f in fixtures.zones(spark, sf_dir).items()}
    silver = assemble_silver(z["impression"], z["click"], z["conversion"])
    return silver.select(*SILVER_COLUMNS)


def _merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_days(_silver(spark, sf_dir), MERGE_WINDOW_DAYS, MERGE_AS_OF)


def _stored(
    spark: SparkSession, sf_dir: str, name: str, like: DayTable, rows, read_only: bool = False
) -> DayTable:
    """A table that earlier runs would have left, laid out by month of its day.

    The test tables spread few rows over 2,400 days; as day folders they would be nothing but
    file overhead. Whatever the length of a partition, it is the same code that runs.
    """
    monthly = DayTable("", T.StructType([*like.schema, _MONTH]), "month", like.keys, like.null_safe)
    made = lambda: _placed(rows(), like.day)
    return fixtures.stored(spark, sf_dir, name, monthly, made, read_only)


_MONTH = T.StructField("month", T.DateType())

_ZONES = {
    kind: [
        T.StructField("event_id", T.StringType()),
        *fields,
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("raw_date", T.DateType()),
    ]
    for kind, fields in {
        "impression": [
            T.StructField("event_timestamp", T.TimestampType()),
            T.StructField("uid", T.StringType()),
            T.StructField("campaign", T.IntegerType()),
            T.StructField("cost", T.DoubleType()),
        ],
        "click": [],
        "conversion": [T.StructField("conversion_delay_sec", T.LongType())],
    }.items()
}


def _placed(df: DataFrame, day: str) -> DataFrame:
    """With the month a stored table is laid out by, and the clock where it has one."""
    if "impression" not in df.columns:
        df = df.withColumn("updated_at", F.current_timestamp())
    return df.withColumn("month", F.trunc(day, "month"))


def _early_table(spark: SparkSession, sf_dir: str) -> DayTable:
    """The silver table as it stood at the cut day."""
    like = DayTable.silver(Layout("", ""))
    return _stored(spark, sf_dir, "silver", like, lambda: _early_silver(spark, sf_dir))


def _early_summary(spark: SparkSession, sf_dir: str) -> DayTable:
    like = DayTable.gold(Layout("", ""))
    return _stored(spark, sf_dir, "gold", like, lambda: campaign_kpis(_early_silver(spark, sf_dir)))


def _early_state(spark: SparkSession, sf_dir: str) -> DayTable:
    """Stored state of everything ingested before the day the increment begins."""


    def rows() -> DataFrame:
        zones = {k: _before(f, TOUCHED_SINCE) for k, f in fixtures.zones(spark, sf_dir).items()}
        return event_state(event_rows(zones))

    return _stored(spark, sf_dir, "state", DayTable.state(""), rows, read_only=True)


def _new_zone_days(spark: SparkSession, sf_dir: str, since: dt.date) -> dict[str, DataFrame]:
    """Zone rows ingested from ``since`` on, from stored zones, whose other months are not read."""
    fresh = {}
    for kind, zone in _ZONES.items():
        like = DayTable("", T.StructType([*zone, _MONTH]), "month", ("month",))
        rows = lambda kind=kind: fixtures.zones(spark, sf_dir)[kind].withColumn(
            "month", F.trunc("raw_date", "month")
        )
        table = fixtures.stored(spark, sf_dir, f"zone-{kind}", like, rows, read_only=True)
        months = [dt.date.fromisoformat(d) for d in table.snapshot(spark).days if d[0].isdigit()]
        recent = table.read(spark, [m for m in months if m >= since.replace(day=1)])
        fresh[kind] = recent.filter(F.col("raw_date") >= F.lit(since))
    return fresh


def zone_scan(spark, sf_dir):
    parts = []
    for kind, zone in fixtures.zones(spark, sf_dir).items():
        parts.append(zone.select(F.lit(kind).alias("zone"), "event_id", "raw_date"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latest_per_event(spark, sf_dir):
    return latest_impressions(fixtures.impressions(spark, sf_dir)).select(
        "event_id", F.to_date("ingest_ts").alias("ingest_date"), "uid", "campaign", "cost"
    )


def silver_events(spark, sf_dir):
    return _silver(spark, sf_dir)


def silver_events_view_through(spark, sf_dir):
    return _silver(spark, sf_dir, view_through=True)


def orphans(spark, sf_dir):
    """Events that came in before the cut day although their impression had not."""
    z = {k: _before(f, CUT_DAY) for k, f in fixtures.zones(spark, sf_dir).items()}
    kinds = [
        orphan_events(z[kind], z["impression"]).select(F.lit(kind).alias("zone"), "event_id")
        for kind in ("click", "conversion")
    ]
    return kinds[0].unionByName(kinds[1])


def incremental_silver(spark, sf_dir):
    """New zone days against the stored state; no older zone row is read or ranked."""
    fresh = _new_zone_days(spark, sf_dir, TOUCHED_SINCE)
    new = staged(event_state(event_rows(fresh)))
    merged = merged_state(new, stored_state(_early_state(spark, sf_dir), new))
    return silver_rows(merged).select(*SILVER_COLUMNS)


def recent_window(spark, sf_dir):
    return recent_days(_silver(spark, sf_dir), WINDOW_DAYS, AS_OF)


def campaign_daily_base(spark, sf_dir):
    base = campaign_base(_silver(spark, sf_dir))
    return _rounded(
        base.select(
            "summary_date", "campaign", "impressions", "clicks", "conversions", "total_cost"
        )
    )


def campaign_daily_kpis(spark, sf_dir):
    return _rounded(campaign_kpis(_silver(spark, sf_dir)))


def campaign_daily_kpis_view_through(spark, sf_dir):
    return _rounded(campaign_kpis(_silver(spark, sf_dir, view_through=True)))


def late_conversions(spark, sf_dir):
    kpis = campaign_kpis(_silver(spark, sf_dir))
    return _rounded(
        kpis.select(
            "summary_date",
            "campaign",
            "conversions",
            "late_conversion_count",
            "late_conversion_ratio",
        )
    )


def delay_distribution(spark, sf_dir):
    kpis = campaign_kpis(_silver(spark, sf_dir), exact_percentiles=True)
    return _rounded(
        kpis.select(
            "summary_date",
            "campaign",
            "avg_conversion_delay_sec",
            "p50_conversion_delay_sec",
            "p95_conversion_delay_sec",
        )
    )


def campaign_totals(spark, sf_dir):
    """KPIs per campaign over all days, merged from the state of each day."""
    days = kpi_state(_silver(spark, sf_dir))
    totals = kpis_of(merged(days, ["campaign"]))
    # Cents: a sum over so many rows differs in later digits with their order.
    return _rounded(totals.withColumn("total_cost", F.round("total_cost", 2)), 4)


def quality_violations(spark, sf_dir):
    """Violations per rule, for silver with and without view-through conversions."""
    counts = [
        violation_counts(campaign_kpis(_silver(spark, sf_dir, through))).select(
            F.lit(name).alias("variant"), *rules(), "violating_rows"
        )
        for name, through in (("clean", False), ("view_through", True))
    ]
    return counts[0].unionByName(counts[1])


def silver_upsert(spark, sf_dir):
    table = _early_table(spark, sf_dir)
    source = _placed(_merge_source(spark, sf_dir), "event_date")
    upsert_table(table, source, check_unique=False)
    return table.read(spark).select(*SILVER_COLUMNS)


def silver_changed_rows(spark, sf_dir):
    return changed_rows(
        _early_silver(spark, sf_dir), _merge_source(spark, sf_dir), ["event_id"]
    )


def gold_upsert(spark, sf_dir):
    table = _early_summary(spark, sf_dir)
    source = _placed(campaign_kpis(_merge_source(spark, sf_dir)), "summary_date")
    upsert_table(table, source, check_unique=False, rows_keep_day=True)
    return _rounded(table.read(spark).drop("updated_at", "month"))


def partition_overwrite(spark, sf_dir):
    """Converted events replace whole days, so other rows of those days go."""
    source = staged(_merge_source(spark, sf_dir).filter(F.col("conversion") == 1))
    return overwrite_days_frames(_early_silver(spark, sf_dir), source, "event_date")


def late_correction(spark, sf_dir):
    """Summary before and after late data was merged in, where a KPI of a day changed."""
    silver, before = _early_table(spark, sf_dir), _early_summary(spark, sf_dir)
    source = _placed(_merge_source(spark, sf_dir), "event_date")
    touched = upsert_table(silver, source, only_changed=True, check_unique=False)
    # Partitions without a changed row cannot differ, so they are not aggregated or compared.
    after = campaign_kpis(silver.read(spark, touched))
    shown = ("impressions", "clicks", "conversions", "late_conversion_count", "cvr", "cpa")
    # Rounded first: sums of doubles differ in the last digit with the order of the rows.
    b, a = _rounded(before.read(spark, touched)).alias("b"), _rounded(after).alias("a")
    same_key = F.col("a.summary_date").eqNullSafe(F.col("b.summary_date")) & F.col(
        "a.campaign"
    ).eqNullSafe(F.col("b.campaign"))
    differs = F.lit(False)
    for name in shown:
        differs = differs | ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    joined = a.join(b, same_key, "left").filter(differs)
    return joined.select(
        F.col("a.summary_date").alias("summary_date"),
        F.col("a.campaign").alias("campaign"),
        *[F.col(f"b.{n}").alias(f"{n}_before") for n in shown],
        *[F.col(f"a.{n}").alias(f"{n}_after") for n in shown],
    )


def bronze_parse(spark, sf_dir):
    parsed = parse_messages(
        fixtures.messages(spark, sf_dir), "impression", F.col("kafka_timestamp")
    )
    return parsed.select(
        "kafka_offset",
        "event_id",
        "event_type",
        "timestamp",
        "event_time",
        "uid",
        "campaign",
        F.round("cost", 6).alias("cost"),
        "raw_value",
        "is_malformed",
        F.to_date("event_timestamp").alias("event_date"),
        "raw_date",
        "raw_hour",
    )


def _parsed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    messages = fixtures.messages(spark, sf_dir, kind)
    parsed = parse_messages(messages, kind, F.col("kafka_timestamp"))
    dated = parsed.withColumn("event_date", F.to_date("event_timestamp"))
    return dated.drop("kafka_partition", "kafka_timestamp", "event_timestamp", "ingest_ts")


def bronze_parse_clicks(spark, sf_dir):
    return _parsed(spark, sf_dir, "click")


def bronze_parse_conversions(spark, sf_dir):
    return _parsed(spark, sf_dir, "conversion")


def rejected_messages(spark, sf_dir):
    """Messages without an event id: stored in the raw zone, never joined."""
    parsed = parse_messages(
        fixtures.messages(spark, sf_dir), "impression", F.col("kafka_timestamp")
    )
    return split_rejects(parsed)[1].select("kafka_offset", "raw_date", "raw_value")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.combined_records(spark, sf_dir)
    return normalise(raw, rebase_offset(raw), carry=("row_key",))


def _typed_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round(F.col("cost").try_cast("double"), 6))


def normalise_events(spark, sf_dir):
    return _typed_cost(_normalised(spark, sf_dir))


def rebase_timestamps(spark, sf_dir):
    """Orders lie below the limit and are moved; events lie above it and are not."""
    parts = []
    sources = (("orders", "o_orderkey", "o_orderdate"), ("events", "event_id", "ts"))
    for name, key, moment in sources:
        rows = fixtures.table(spark, sf_dir, name)
        raw = rows.select(
            F.lit(name).alias("source"),
            F.col(key).alias("row_key"),
            F.unix_timestamp(F.col(moment).cast("timestamp")).cast("string").alias("timestamp"),
        )
        moved = normalise(raw, rebase_offset(raw), carry=("source", "row_key"))
        parts.append(moved.select("source", "row_key", "timestamp"))
    return parts[0].unionByName(parts[1])


def time_range(spark, sf_dir):
    return timestamp_range(fixtures.combined_records(spark, sf_dir))


def profile(spark, sf_dir):
    # Cents are what a sum of doubles over the whole data set can promise in any row order.
    totals = dataset_profile(_normalised(spark, sf_dir))
    return _rounded(totals.withColumn("total_cost", F.round("total_cost", 2)), 4)


def sorted_events(spark, sf_dir):
    return sorted_by_time(_typed_cost(_normalised(spark, sf_dir)), "row_key").select(
        "timestamp", "row_key", "uid", "campaign", "click", "conversion"
    )


def first_events(spark, sf_dir):
    return first_by_time(_typed_cost(_normalised(spark, sf_dir)), FIRST_ROWS, "row_key")


def sample(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    return fixed_size_sample(
        orders.select("o_orderkey", "o_custkey", "o_totalprice"), SAMPLE_SIZE, "o_orderkey"
    )


def batch_split(spark, sf_dir):
    records = _normalised(spark, sf_dir).select("row_key", "timestamp")
    positioned = with_position(records, ["timestamp", "row_key"])
    return with_splits(positioned, INITIAL, BATCHES, QUICK)


def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = with_event_ids(_normalised(spark, sf_dir), ["timestamp", "row_key"])
    return split_unusable(numbered)[0]


def explode_impressions(spark, sf_dir):
    return impression_events(_event_records(spark, sf_dir))


def explode_clicks(spark, sf_dir):
    return click_events(_event_records(spark, sf_dir))


def explode_conversions(spark, sf_dir):
    return conversion_events(_event_records(spark, sf_dir))


def conversion_delay(spark, sf_dir):
    records = _normalised(spark, sf_dir)
    return records.filter(F.col("conversion_timestamp").isNotNull()).select(
        "row_key",
        clamped_delay(F.col("conversion_timestamp"), F.col("timestamp")).alias(
            "conversion_delay_sec"
        ),
    )


def payloads(spark, sf_dir):
    return event_payloads(_event_records(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "zone_scan": zone_scan,
    "latest_per_event": latest_per_event,
    "silver_events": silver_events,
    "silver_events_view_through": silver_events_view_through,
    "orphan_events": orphans,
    "incremental_silver": incremental_silver,
    "recent_window": recent_window,
    "campaign_daily_base": campaign_daily_base,
    "campaign_kpis": campaign_daily_kpis,
    "campaign_kpis_view_through": campaign_daily_kpis_view_through,
    "late_conversions": late_conversions,
    "delay_distribution": delay_distribution,
    "campaign_totals": campaign_totals,
    "quality_violations": quality_violations,
    "silver_upsert": silver_upsert,
    "silver_changed_rows": silver_changed_rows,
    "gold_upsert": gold_upsert,
    "partition_overwrite": partition_overwrite,
    "late_correction": late_correction,
    "bronze_parse": bronze_parse,
    "bronze_parse_clicks": bronze_parse_clicks,
    "bronze_parse_conversions": bronze_parse_conversions,
    "rejected_messages": rejected_messages,
    "normalise_events": normalise_events,
    "rebase_timestamps": rebase_timestamps,
    "timestamp_range": time_range,
    "dataset_profile": profile,
    "sorted_events": sorted_events,
    "first_events": first_events,
    "fixed_size_sample": sample,
    "batch_split": batch_split,
    "explode_impressions": explode_impressions,
    "explode_clicks": explode_clicks,
    "explode_conversions": explode_conversions,
    "conversion_delay": conversion_delay,
    "event_payloads": payloads,
}
