"""Dedup, assembly, KPI and quality rules on small and on skewed inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adkpi.operators.assemble import assemble_silver, assemble_touched
from adkpi.operators.kpis import campaign_kpis
from adkpi.operators.latest import latest_per_key, split_rejects
from adkpi.operators.quality import assert_quality, violating_rows, violation_counts

DAY = dt.date(2026, 5, 15)


def moment(hour):
    return dt.datetime(2026, 5, 15, hour)


def silver(spark, rows):
    return spark.createDataFrame(
        rows,
        "event_id string, event_date date, campaign int, click int, conversion int, "
        "conversion_delay_sec long, cost double",
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_prefers_clock_then_offset_and_nulls_lose(spark):
    rows = [
        ("a", moment(1), 0, 9, "old"),
        ("a", moment(2), 0, 1, "low"),
        ("a", moment(2), 0, 3, "win"),
        ("a", None, 0, 99, "null"),
        ("b", None, 0, 1, "only"),
    ]
    frame = spark.createDataFrame(
        rows, "event_id string, ingest_ts timestamp, kafka_partition int, kafka_offset long, tag string"
    )
    assert {r.event_id: r.tag for r in latest_per_key(frame).collect()} == {"a": "win", "b": "only"}


def test_copies_are_cut_before_the_shuffle(spark):
    frame = spark.range(100).select(
        (F.col("id") % 2).cast("string").alias("event_id"),
        F.timestamp_seconds("id").alias("ingest_ts"),
        "id",
    )
    plan = plan_of(latest_per_key(frame))
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below


def test_rows_without_key_are_rejected(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "event_id string, v int")
    keyed, rejected = split_rejects(frame)
    assert (keyed.count(), rejected.count()) == (1, 2)


def zones(spark, ids, hot_copies):
    """Zones in which one id holds most of the rows."""
    copies = spark.range(hot_copies).select(
        F.lit("hot").alias("event_id"), F.timestamp_seconds(F.col("id") + 86400 * 3).alias("ingest_ts")
    )
    plain = spark.range(ids).select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.timestamp_seconds("id").alias("ingest_ts")
    )
    base = copies.unionByName(plain).withColumn("raw_date", F.to_date("ingest_ts"))
    n = F.unix_timestamp("ingest_ts")
    return {
        "impression": base.select(
            "*",
            F.lit(moment(0)).cast("timestamp").alias("event_timestamp"),
            F.lit("u").alias("uid"),
            F.lit(1).alias("campaign"),
            n.cast("double").alias("cost"),
        ),
        "click": base.filter(n % 2 == 0),
        "conversion": base.filter(n % 3 == 0).withColumn("conversion_delay_sec", n),
    }


def test_hot_id_gives_one_row_with_its_latest_values(spark):
    z = zones(spark, ids=50, hot_copies=2000)
    rows = assemble_silver(z["impression"], z["click"], z["conversion"]).collect()
    assert len(rows) == 51
    [hot] = [r for r in rows if r.event_id == "hot"]
    last = 86400 * 3 + 1999
    assert (hot.cost, hot.click, hot.conversion) == (float(last), 1, 1)
    assert hot.conversion_delay_sec == last - last % 3


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_touched_ids_give_full_rebuild_rows_either_way(spark, limit):
    z = zones(spark, ids=40, hot_copies=300)
    ids = spark.createDataFrame([("hot",), ("e3",), ("gone",)], "event_id string")
    drop = lambda df: sorted(map(str, df.drop("updated_at").collect()))
    full = assemble_silver(z["impression"], z["click"], z["conversion"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        part = drop(assemble_touched(z, ids))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert part == drop(full.filter(F.col("event_id").isin("hot", "e3")))


def test_join_plan_shuffles_each_zone_once(spark):
    z = zones(spark, ids=50, hot_copies=50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(assemble_silver(z["impression"], z["click"], z["conversion"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("exact", [False, True])
def test_kpi_guards_and_lateness(spark, exact):
    rows = [
        ("a", DAY, 1, 1, 1, 3600, 2.0),
        ("b", DAY, 1, 1, 1, 3601, 4.0),
        ("c", DAY, 1, 0, 1, None, None),
        ("d", DAY, 2, 0, 1, 10, 1.0),
        ("e", DAY, 3, 0, 0, None, None),
        ("f", DAY, None, 1, 0, None, 1.0),
    ]
    got = {r.campaign: r for r in campaign_kpis(silver(spark, rows), exact_percentiles=exact).collect()}
    one = got[1]
    assert (one.impressions, one.clicks, one.conversions, one.total_cost) == (3, 2, 3, 6.0)
    assert (one.cvr, one.cpa, one.late_conversion_count) == (150.0, 2.0, 1)
    assert one.ctr == pytest.approx(200 / 3) and one.late_conversion_ratio == pytest.approx(100 / 3)
    assert (one.avg_conversion_delay_sec, one.p50_conversion_delay_sec) == (3600.5, 3600.0)
    assert one.p95_conversion_delay_sec == 3601.0
    assert (got[2].ctr, got[2].cvr, got[2].cpa) == (0.0, 0.0, 1.0)
    assert (got[3].total_cost, got[3].cpa, got[3].p50_conversion_delay_sec) == (None, None, None)
    assert (got[3].late_conversion_count, got[3].late_conversion_ratio) == (0, 0.0)
    assert got[None].ctr == 100.0


def test_percentiles_of_a_dominant_campaign(spark):
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.lit(DAY).alias("event_date"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0).cast("int").alias("campaign"),
        F.lit(1).alias("click"),
        F.lit(1).alias("conversion"),
        ((F.col("id") * 7919) % 20_011).alias("conversion_delay_sec"),
        F.lit(1.0).alias("cost"),
    )
    exact = {r.campaign: r for r in campaign_kpis(rows, exact_percentiles=True).collect()}
    values = {}
    for r in rows.select("campaign", "conversion_delay_sec").collect():
        values.setdefault(r[0], []).append(r[1])
    for campaign, found in values.items():
        found.sort()
        for percent, got in (
            (50, exact[campaign].p50_conversion_delay_sec),
            (95, exact[campaign].p95_conversion_delay_sec),
        ):
            assert got == found[-(-len(found) * percent // 100) - 1]
    sketch = {r.campaign: r for r in campaign_kpis(rows).collect()}
    for campaign, row in sketch.items():
        found = values[campaign]
        rank = sum(1 for v in found if v <= row.p95_conversion_delay_sec)
        assert abs(rank - 0.95 * len(found)) <= max(2, len(found) / 5000)


def test_quality_rules(spark):
    rows = [(0, 0.0, 0.0), (1, 101.0, 0.0), (1, 0.0, -1.0), (1, 100.0, 100.0), (1, None, None)]
    frame = spark.createDataFrame(rows, "impressions long, ctr double, cvr double")
    assert violation_counts(frame).first().asDict() == {
        "impressions_not_positive": 1,
        "ctr_out_of_range": 1,
        "cvr_out_of_range": 1,
        "violating_rows": 3,
    }
    assert violating_rows(frame).count() == 3
    with pytest.raises(ValueError, match="'violating_rows': 3"):
        assert_quality(frame)
    assert_quality(frame.filter("impressions > 0 and (ctr is null or ctr <= 100) and (cvr is null or cvr >= 0)"))
