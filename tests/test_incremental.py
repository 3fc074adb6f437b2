"""Random arrivals: daily incremental runs end where one full run ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adkpi.paths import Layout
from adkpi.plans import gold, silver
from adkpi.schemas import zone_schema
from adkpi.sources.tables import DayTable

FIRST = dt.date(2026, 5, 1)


def arrivals(rng, days):
    """Per day and zone: (event_id, hour of day, event day, value)."""
    ids = [f"e{i}" for i in range(12)]
    plan = {}
    for day in range(days):
        for kind in ("impression", "click", "conversion"):
            plan[day, kind] = [
                (rng.choice(ids), rng.randint(0, 23), rng.randint(0, day), rng.randint(0, 9000))
                for _ in range(rng.randint(1, 6))
            ]
    return plan


def append(spark, layout, day, kind, rows):
    frame = spark.createDataFrame(rows, "event_id string, hour int, event_day int, value long")
    start = F.lit(FIRST).cast("timestamp")
    seconds = lambda days, hours: F.timestamp_seconds(F.unix_timestamp(start) + days * 86400 + hours * 3600)
    columns = {
        "ingest_ts": seconds(F.lit(day), F.col("hour")),
        "event_timestamp": seconds(F.col("event_day"), F.lit(1)),
        "kafka_offset": F.monotonically_increasing_id() + day * 1000,
        "uid": F.lit("u"),
        "campaign": (F.col("value") % 3).cast("int"),
        "cost": F.col("value").cast("double"),
        "conversion_delay_sec": F.col("value"),
        "raw_date": F.date_add(F.lit(FIRST), day),
        "raw_hour": F.col("hour"),
    }
    frame = frame.withColumns(columns)
    for field in zone_schema(kind):
        value = F.col(field.name) if field.name in frame.columns else F.lit(None)
        frame = frame.withColumn(field.name, value.cast(field.dataType))
    frame.select(*zone_schema(kind).fieldNames()).coalesce(1).write.mode("append").partitionBy(
        "raw_date", "raw_hour"
    ).parquet(layout.zone(kind))


def tables(spark, layout):
    frames = DayTable.silver(layout).read(spark), DayTable.gold(layout).read(spark)
    return [sorted(map(str, f.drop("updated_at").collect())) for f in frames]


@pytest.mark.parametrize("seed", [1, 2])
def test_daily_increments_equal_one_full_run(spark, tmp_path, seed):
    steps, full = (Layout.for_warehouse(str(tmp_path / n)) for n in ("steps", "full"))
    days = 3
    for (day, kind), rows in arrivals(random.Random(seed), days).items():
        append(spark, full, day, kind, rows)
        append(spark, steps, day, kind, rows)
        if kind == "conversion":
            since = FIRST + dt.timedelta(days=day)
            report = silver.run(spark, steps, window_days=None, since=since, only_changed=day == 2)
            gold.run(
                spark, steps, days=report["touched_days"], check=False, delete_missing=True
            )
    silver.run(spark, full, window_days=None)
    gold.run(spark, full, window_days=None, check=False)
    assert tables(spark, steps) == tables(spark, full)
