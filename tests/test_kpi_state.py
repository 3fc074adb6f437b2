"""Stored KPI state: merged equals recomputed, and sketches keep their promise."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_golden import AFTER_B, AS_OF, D15, D16, batch_a, batch_b, summary

from adkpi.operators.kpi_state import SKETCH_SIZE, base_of, kpi_state, kpis_of, merged
from adkpi.operators.kpis import campaign_base
from adkpi.paths import Layout
from adkpi.plans import gold, silver
from adkpi.sources.tables import DayTable

DAY = dt.date(2026, 5, 1)


def conversions(spark, rows, days=10):
    """Delays spread over a wide range, in one campaign and ``days`` days."""
    return spark.range(rows).select(
        F.date_add(F.lit(DAY), F.pmod(F.col("id"), F.lit(days)).cast("int")).alias("event_date"),
        F.lit(1).alias("campaign"),
        F.lit(1).alias("click"),
        F.lit(1).alias("conversion"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("conversion_delay_sec"),
        F.lit(0.5).alias("cost"),
    )


def test_small_groups_are_exact(spark):
    events = conversions(spark, 3000)
    want = campaign_base(events).orderBy("summary_date").collect()
    assert base_of(kpi_state(events)).orderBy("summary_date").collect() == want


def test_rank_error_of_large_merged_groups(spark):
    """60,000 conversions over ten days: at most 1 % off in rank, merged or computed at once."""
    events = conversions(spark, 60_000)
    whole = events.withColumn("event_date", F.lit(DAY))
    by_day = merged(kpi_state(events), ["campaign"])
    at_once = merged(kpi_state(whole), ["campaign"])
    for state in (by_day, at_once):
        row = base_of(state).first()
        assert (row.impressions, row.conversions) == (60_000, 60_000)
        for share, name in ((0.5, "p50"), (0.95, "p95")):
            value = row[f"{name}_conversion_delay_sec"]
            rank = events.filter(F.col("conversion_delay_sec") <= value).count() / 60_000
            assert abs(rank - share) <= 0.01
    assert 60_000 > SKETCH_SIZE


def test_groups_without_conversions(spark):
    events = conversions(spark, 10, 1).withColumns(
        {"conversion": F.lit(0), "conversion_delay_sec": F.lit(None).cast("long")}
    )
    row = base_of(merged(kpi_state(events), ["campaign"])).first()
    assert (row.impressions, row.conversions, row.p50_conversion_delay_sec) == (10, 0, None)
    assert row.avg_conversion_delay_sec is None
    assert merged(kpi_state(events.limit(0)), ["campaign"]).count() == 0


def test_gold_from_stored_state_and_rollup(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    for batch in (batch_a, batch_b):
        batch(spark, layout)
        touched = silver.run(spark, layout, mode="incremental")["touched_days"]
        gold.run(spark, layout, days=touched, keep_state=True)
    assert summary(spark, layout) == AFTER_B
    stored = DayTable.silver(layout).read(spark)
    for days in (None, [D15], [D16]):
        some = stored if days is None else stored.filter(F.col("event_date").isin(days))
        want = kpis_of(merged(kpi_state(some), ["campaign"])).orderBy("campaign").collect()
        got = gold.rollup(spark, layout, days).orderBy("campaign").collect()
        assert got == want and got
    total = gold.rollup(spark, layout).filter("campaign = 1").first()
    assert (total.impressions, total.clicks, total.conversions, total.total_cost) == (4, 3, 2, 10.5)
    with pytest.raises(ValueError):
        gold.run(spark, layout, as_of=AS_OF, keep_state=True, exact_percentiles=True)
