"""Two-batch golden fixture: late conversions correct the KPIs of past days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adkpi.operators.assemble import orphan_events
from adkpi.paths import Layout
from adkpi.plans import gold, silver
from adkpi.schemas import zone_schema
from adkpi.sources.tables import DayTable
from adkpi.sources.zones import read_zones

B = 1778803200
D15, D16 = dt.date(2026, 5, 15), dt.date(2026, 5, 16)
AS_OF = dt.date(2026, 5, 17)


def write_zone(spark, layout, kind, rows, names, day):
    frame = spark.createDataFrame(rows, names)
    ingest = F.lit(dt.datetime(2026, 5, day, 12)).cast("timestamp")
    columns = {"ingest_ts": ingest, "raw_date": F.to_date(ingest), "raw_hour": F.lit(12)}
    if "timestamp" in frame.columns:
        columns["event_timestamp"] = F.timestamp_seconds("timestamp")
    frame = frame.withColumns(columns)
    for field in zone_schema(kind):
        value = F.col(field.name) if field.name in frame.columns else F.lit(None)
        frame = frame.withColumn(field.name, value.cast(field.dataType))
    frame.select(*zone_schema(kind).fieldNames()).write.mode("append").partitionBy(
        "raw_date", "raw_hour"
    ).parquet(layout.zone(kind))


IMPRESSION = "event_id string, timestamp long, uid string, campaign int, cost double"
CLICK = "event_id string"
CONVERSION = "event_id string, conversion_delay_sec long"


def batch_a(spark, layout):
    rows = [
        ("e1", B, "u1", 1, 1.0),
        ("e2", B + 60, "u1", 1, 2.0),
        ("e3", B + 120, "u2", 1, 3.0),
        ("e4", B + 86400, "u2", 1, 4.0),
        ("e5", B + 180, "u3", 2, 5.0),
        ("e6", B + 240, "u3", 2, None),
    ]
    write_zone(spark, layout, "impression", rows, IMPRESSION, 16)
    write_zone(spark, layout, "click", [("e1",), ("e2",), ("e2",), ("e4",)], CLICK, 16)
    write_zone(spark, layout, "conversion", [("e1", 600)], CONVERSION, 16)


def batch_b(spark, layout):
    rows = [("e3", B + 120, "u2", 1, 3.5), ("e7", B + 86460, "u4", 2, 7.0)]
    write_zone(spark, layout, "impression", rows, IMPRESSION, 17)
    rows = [("e2", 7200), ("e5", 0), ("e9", 50)]
    write_zone(spark, layout, "conversion", rows, CONVERSION, 17)


def summary(spark, layout):
    rows = DayTable.gold(layout).read(spark).drop("updated_at").orderBy("summary_date", "campaign")
    return [
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows.collect()
    ]


def silver_rows(spark, layout):
    rows = DayTable.silver(layout).read(spark).collect()
    return {r.event_id: (r.click, r.conversion, r.conversion_delay_sec, r.cost) for r in rows}


AFTER_A = [
    (D15, 1, 3, 2, 1, 6.0, 66.666667, 50.0, 6.0, 0, 0.0, 600.0, 600.0, 600.0),
    (D15, 2, 2, 0, 0, 5.0, 0.0, 0.0, None, 0, 0.0, None, None, None),
    (D16, 1, 1, 1, 0, 4.0, 100.0, 0.0, None, 0, 0.0, None, None, None),
]
AFTER_B = [
    (D15, 1, 3, 2, 2, 6.5, 66.666667, 100.0, 3.25, 1, 50.0, 3900.0, 600.0, 7200.0),
    (D15, 2, 2, 0, 1, 5.0, 0.0, 0.0, 5.0, 0, 0.0, 0.0, 0.0, 0.0),
    (D16, 1, 1, 1, 0, 4.0, 100.0, 0.0, None, 0, 0.0, None, None, None),
    (D16, 2, 1, 0, 0, 7.0, 0.0, 0.0, None, 0, 0.0, None, None, None),
]
SILVER_AFTER_B = {
    "e1": (1, 1, 600, 1.0),
    "e2": (1, 1, 7200, 2.0),
    "e3": (0, 0, None, 3.5),
    "e4": (1, 0, None, 4.0),
    "e5": (0, 1, 0, 5.0),
    "e6": (0, 0, None, None),
    "e7": (0, 0, None, 7.0),
}


@pytest.mark.parametrize("exact", [False, True])
def test_late_batch_corrects_past_days(spark, tmp_path, exact):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    gold.run(spark, layout, as_of=AS_OF, exact_percentiles=exact)
    assert summary(spark, layout) == AFTER_A

    batch_b(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    gold.run(spark, layout, as_of=AS_OF, exact_percentiles=exact)
    assert silver_rows(spark, layout) == SILVER_AFTER_B
    assert summary(spark, layout) == AFTER_B

    # A further run without new data changes nothing but the clock.
    silver.run(spark, layout, as_of=AS_OF)
    gold.run(spark, layout, as_of=AS_OF)
    assert silver_rows(spark, layout) == SILVER_AFTER_B
    assert summary(spark, layout) == AFTER_B


@pytest.mark.parametrize("only_changed", [False, True])
def test_incremental_run_equals_full_run(spark, tmp_path, only_changed):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    gold.run(spark, layout, as_of=AS_OF)
    batch_b(spark, layout)
    report = silver.run(
        spark, layout, as_of=AS_OF, since=dt.date(2026, 5, 17), only_changed=only_changed
    )
    assert report["touched_days"] == [D15, D16]
    gold.run(spark, layout, days=report["touched_days"])
    assert silver_rows(spark, layout) == SILVER_AFTER_B
    assert summary(spark, layout) == AFTER_B


def test_only_changed_leaves_clocks_and_days_alone(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    before = {r.event_id: r.updated_at for r in DayTable.silver(layout).read(spark).collect()}
    report = silver.run(spark, layout, as_of=AS_OF, only_changed=True)
    assert report["touched_days"] == []
    batch_b(spark, layout)
    silver.run(spark, layout, as_of=AS_OF, only_changed=True)
    after = {r.event_id: r.updated_at for r in DayTable.silver(layout).read(spark).collect()}
    moved = {e for e in after if after[e] != before.get(e)}
    assert moved == {"e2", "e3", "e5", "e7"}
    assert silver_rows(spark, layout) == SILVER_AFTER_B


def test_merge_window_ignores_older_days(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=dt.date(2026, 5, 17), window_days=1)
    assert set(silver_rows(spark, layout)) == {"e4"}


def test_full_refresh_keeps_other_days_and_replace_all_does_not(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    table = DayTable.silver(layout)
    old = spark.createDataFrame(
        [("x", dt.date(2020, 1, 1), "u", 1, 0, 0, None, 1.0, None)], table.schema
    )
    table.overwrite_days(old)
    batch_a(spark, layout)
    silver.run(spark, layout, mode="full-refresh")
    assert set(silver_rows(spark, layout)) == {"x", "e1", "e2", "e3", "e4", "e5", "e6"}
    silver.run(spark, layout, mode="replace-all")
    assert set(silver_rows(spark, layout)) == {"e1", "e2", "e3", "e4", "e5", "e6"}


def test_orphans_are_reported(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    batch_b(spark, layout)
    zones = read_zones(spark, layout)
    found = orphan_events(zones["conversion"], zones["impression"]).collect()
    assert [row.event_id for row in found] == ["e9"]


def test_failed_check_leaves_gold_as_it_was(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    gold.run(spark, layout, as_of=AS_OF)
    # Two more conversions without clicks push the CVR of campaign 1 above 100.
    write_zone(spark, layout, "conversion", [("e3", 5), ("e2", 5)], CONVERSION, 17)
    silver.run(spark, layout, as_of=AS_OF)
    with pytest.raises(ValueError, match="cvr_out_of_range"):
        gold.run(spark, layout, as_of=AS_OF)
    assert summary(spark, layout) == AFTER_A
    gold.run(spark, layout, as_of=AS_OF, check=False)
    assert summary(spark, layout)[0][7] == 150.0


def test_missing_zones_are_empty(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    write_zone(spark, layout, "impression", [("e1", B, "u1", 1, 1.0)], IMPRESSION, 16)
    silver.run(spark, layout, as_of=AS_OF)
    assert silver_rows(spark, layout) == {"e1": (0, 0, None, 1.0)}


def test_trusted_dates_give_the_same_table_from_fewer_partitions(spark, tmp_path):
    results = []
    for trust in (False, True):
        layout = Layout.for_warehouse(str(tmp_path / str(trust)))
        batch_a(spark, layout)
        old = [("old", B - 86400 * 9, "u9", 1, 9.0)]
        write_zone(spark, layout, "impression", old, IMPRESSION, 6)
        silver.run(spark, layout, as_of=AS_OF, window_days=None)
        batch_b(spark, layout)
        report = silver.run(spark, layout, as_of=AS_OF, trust_dates=trust)
        assert (report["rows"], report["clicks"], report["conversions"]) == (7, 3, 3)
        results.append(silver_rows(spark, layout))
    assert results[0] == results[1] == {**SILVER_AFTER_B, "old": (0, 0, None, 9.0)}


def test_day_filters_reach_the_scans(spark, tmp_path):
    from adkpi.operators.assemble import recent_days, touched_ids

    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, as_of=AS_OF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    recent = plan(recent_days(DayTable.silver(layout).read(spark), 7))
    assert "PartitionFilters: [isnotnull(event_date" in recent
    touched = plan(touched_ids(read_zones(spark, layout), D16))
    assert touched.count("PartitionFilters: [isnotnull(raw_date") == 3
    assert touched.count("ReadSchema: struct<event_id:string>") == 3


def test_early_date_filter_gives_the_same_recent_rows(spark, tmp_path):
    from adkpi.operators.assemble import assemble_silver, recent_days

    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    batch_b(spark, layout)
    z = [read_zones(spark, layout)[k] for k in ("impression", "click", "conversion")]
    late = recent_days(assemble_silver(*z, updated_at=F.lit(None)), 1, AS_OF)
    early = assemble_silver(*z, updated_at=F.lit(None), fixed_dates_since=F.lit(D16))
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
