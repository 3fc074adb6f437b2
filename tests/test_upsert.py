"""Upserts on frames and on day-partitioned Parquet tables."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adkpi.operators.upsert import (
    DuplicateKeyError,
    merge_into,
    overwrite_days_frames,
    upsert_frames,
    upsert_table,
)
from adkpi.paths import Layout
from adkpi.sources.tables import CatalogTable, DayTable

DAYS = [dt.date(2026, 5, d) for d in range(1, 6)]


def silver_frame(spark, rows):
    """Rows of (event_id, day, cost)."""
    full = [(e, d, "u", 1, 0, 0, None, c, None) for e, d, c in rows]
    return spark.createDataFrame(full, DayTable.silver(Layout("/x", "/x")).schema)


def gold_frame(spark, rows):
    """Rows of (day, campaign, impressions)."""
    full = [(d, c, i, 0, 0, 0.0, 0.0, 0.0, None, 0, 0.0, None, None, None, None) for d, c, i in rows]
    return spark.createDataFrame(full, DayTable.gold(Layout("/x", "/x")).schema)


@pytest.fixture
def table(tmp_path):
    return DayTable.silver(Layout.for_warehouse(str(tmp_path)))


@pytest.fixture
def gold(tmp_path):
    return DayTable.gold(Layout.for_warehouse(str(tmp_path)))


def content(spark, table):
    rows = table.read(spark).collect()
    if "event_id" in table.keys:
        return sorted((r.event_id, r.event_date, r.cost) for r in rows)
    return sorted(((r.summary_date, r.campaign, r.impressions) for r in rows), key=str)


def test_insert_update_and_idempotence(spark, table):
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0), ("b", DAYS[1], 2.0)]))
    source = silver_frame(spark, [("b", DAYS[1], 3.0), ("c", DAYS[2], 4.0)])
    for _ in range(2):
        assert upsert_table(table, source) == [DAYS[1], DAYS[2]]
        assert content(spark, table) == [
            ("a", DAYS[0], 1.0),
            ("b", DAYS[1], 3.0),
            ("c", DAYS[2], 4.0),
        ]


def test_row_that_moves_day_leaves_the_old_day(spark, table):
    upsert_table(
        table,
        silver_frame(spark, [("a", DAYS[0], 1.0), ("b", DAYS[0], 2.0), ("c", DAYS[1], 3.0)]),
    )
    assert upsert_table(table, silver_frame(spark, [("b", DAYS[2], 5.0)])) == [DAYS[0], DAYS[2]]
    assert content(spark, table) == [
        ("a", DAYS[0], 1.0),
        ("b", DAYS[2], 5.0),
        ("c", DAYS[1], 3.0),
    ]


def test_row_that_empties_its_day(spark, table):
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0), ("c", DAYS[1], 3.0)]))
    source = silver_frame(spark, [("a", DAYS[1], 2.0)])
    for _ in range(2):
        upsert_table(table, source)
        assert content(spark, table) == [("a", DAYS[1], 2.0), ("c", DAYS[1], 3.0)]


def test_rows_without_a_day_are_kept_and_may_get_one(spark, table):
    upsert_table(table, silver_frame(spark, [("a", None, 1.0), ("b", None, 2.0)]))
    assert upsert_table(table, silver_frame(spark, [("a", None, 3.0), ("c", DAYS[0], 4.0)])) == [
        None,
        DAYS[0],
    ]
    stored = lambda: {r.event_id: (r.event_date, r.cost) for r in table.read(spark).collect()}
    assert stored() == {"a": (None, 3.0), "b": (None, 2.0), "c": (DAYS[0], 4.0)}
    upsert_table(table, silver_frame(spark, [("a", DAYS[1], 5.0), ("b", DAYS[1], 6.0)]))
    assert stored() == {"a": (DAYS[1], 5.0), "b": (DAYS[1], 6.0), "c": (DAYS[0], 4.0)}
    assert table.read(spark).count() == 3


def test_untouched_days_are_not_rewritten(spark, table, tmp_path):
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0), ("b", DAYS[1], 2.0)]))
    files = lambda day: sorted(p.name for p in tmp_path.rglob(f"event_date={day}/*.parquet"))
    kept, rewritten = files(DAYS[0]), files(DAYS[1])
    upsert_table(table, silver_frame(spark, [("b", DAYS[1], 9.0)]))
    assert files(DAYS[0]) == kept
    assert files(DAYS[1]) != rewritten


def test_duplicate_source_key_is_an_error(spark, table):
    source = silver_frame(spark, [("a", DAYS[0], 1.0), ("a", DAYS[1], 2.0)])
    with pytest.raises(DuplicateKeyError):
        upsert_table(table, source)
    assert content(spark, table) == []


def test_wrong_schema_is_an_error(spark, table):
    with pytest.raises(ValueError, match="cost"):
        upsert_table(table, silver_frame(spark, []).withColumn("cost", F.lit("x")))


def test_null_campaign_stays_one_row(spark, gold):
    source = gold_frame(spark, [(DAYS[0], None, 1), (DAYS[0], 1, 2)])
    for _ in range(3):
        upsert_table(gold, source)
        assert content(spark, gold) == [(DAYS[0], 1, 2), (DAYS[0], None, 1)]


def test_vanished_group_stays_unless_asked(spark, gold):
    first = gold_frame(spark, [(DAYS[0], 1, 1), (DAYS[1], 1, 2), (DAYS[1], 2, 3), (DAYS[2], 2, 4)])
    upsert_table(gold, first)
    second = gold_frame(spark, [(DAYS[1], 1, 5)])
    upsert_table(gold, second)
    assert (DAYS[1], 2, 3) in content(spark, gold)
    for only_changed in (False, True):
        upsert_table(
            gold, second, only_changed, replace_where=F.col("summary_date") >= F.lit(DAYS[1])
        )
        assert content(spark, gold) == [(DAYS[0], 1, 1), (DAYS[1], 1, 5)]


def test_random_batches_match_a_dictionary(spark, table):
    rng = random.Random(7)
    expected = {}
    for step in range(6):
        keys = rng.sample("abcdefghij", rng.randint(1, 6))
        rows = [(k, rng.choice(DAYS), float(rng.randint(0, 2))) for k in keys]
        upsert_table(table, silver_frame(spark, rows), only_changed=step % 2 == 1)
        expected.update({k: (d, c) for k, d, c in rows})
        assert content(spark, table) == sorted((k, d, c) for k, (d, c) in expected.items())


def test_frame_upsert_and_day_overwrite(spark):
    target = silver_frame(spark, [("a", DAYS[0], 1.0), ("b", DAYS[0], 2.0), ("c", DAYS[1], 3.0)])
    source = silver_frame(spark, [("b", DAYS[0], 9.0), ("d", DAYS[2], 4.0)])
    pick = lambda df: sorted((r.event_id, r.cost) for r in df.collect())
    merged = upsert_frames(target, source, ["event_id"])
    assert pick(merged) == [("a", 1.0), ("b", 9.0), ("c", 3.0), ("d", 4.0)]
    assert pick(upsert_frames(merged, source, ["event_id"])) == pick(merged)
    replaced = overwrite_days_frames(target, source, "event_date")
    assert pick(replaced) == [("b", 9.0), ("c", 3.0), ("d", 4.0)]


def test_catalog_table_is_created_once_and_sees_writes(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    table = DayTable.silver(layout, database="ads")
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0)]))
    assert [r.event_id for r in spark.table("ads.processed_events").collect()] == ["a"]
    upsert_table(table, silver_frame(spark, [("a", DAYS[1], 1.0), ("b", DAYS[1], 2.0)]))
    seen = CatalogTable.silver("spark_catalog.ads.processed_events").read(spark).collect()
    assert sorted((r.event_id, r.event_date) for r in seen) == [("a", DAYS[1]), ("b", DAYS[1])]


def test_row_level_merge_needs_a_catalog_that_supports_it(spark):
    table = CatalogTable.silver("ads.merge_target", provider="parquet")
    table.ensure(spark)
    table.ensure(spark)
    assert table.read(spark).schema.fieldNames()[-1] == "event_date"
    assert [c.name for c in spark.catalog.listColumns(table.name) if c.isPartition] == ["event_date"]
    source = silver_frame(spark, [("a", DAYS[0], 1.0)])
    for write in (
        lambda: merge_into(table, source),
        lambda: merge_into(table, source, only_changed=True),
        lambda: merge_into(table, source, replace_where=F.col("event_date") >= F.lit(DAYS[0])),
    ):
        with pytest.raises(PySparkException, match="does not support MERGE"):
            write()
    for write in (table.overwrite_days, table.replace_all):
        with pytest.raises(PySparkException):
            write(source)


def test_gold_reads_silver_by_catalog_name(spark, tmp_path):
    from adkpi.plans import gold as gold_job

    layout = Layout.for_warehouse(str(tmp_path))
    stored = DayTable.silver(layout, "by_name", "ads")
    upsert_table(stored, silver_frame(spark, [("a", DAYS[0], 1.0), ("b", DAYS[0], 2.0)]))
    gold_job.run(spark, layout, window_days=None, silver=CatalogTable.silver("ads.by_name"))
    assert content(spark, DayTable.gold(layout)) == [(DAYS[0], 1, 2)]
