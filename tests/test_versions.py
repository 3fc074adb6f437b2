"""Versioned day tables: one switch per change, a key index, copies and expiry."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_upsert import DAYS, content, gold_frame, silver_frame

from adkpi.operators import upsert
from adkpi.operators.upsert import upsert_table
from adkpi.paths import Layout
from adkpi.sources import snapshots
from adkpi.sources.tables import KEY_RUNS, DayTable


@pytest.fixture
def table(tmp_path):
    return DayTable.silver(Layout.for_warehouse(str(tmp_path)))


def days_read(monkeypatch):
    """Days asked of each table read from now on; None: all of them."""
    asked = []
    plain = DayTable.read
    monkeypatch.setattr(
        DayTable,
        "read",
        lambda self, spark, days=None, version=None: (
            asked.append(None if days is None else set(days)) or plain(self, spark, days, version)
        ),
    )
    return asked


def test_a_run_that_dies_between_folders_and_version_changes_nothing(spark, table, monkeypatch):
    first = [("a", DAYS[0], 1.0), ("b", DAYS[1], 2.0), ("c", DAYS[2], 3.0)]
    upsert_table(table, silver_frame(spark, first))

    def dies(*_):
        raise OSError("lost")

    source = silver_frame(spark, [("a", DAYS[1], 9.0), ("b", DAYS[2], 9.0), ("d", DAYS[0], 9.0)])
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "commit", dies)
        with pytest.raises(OSError):
            upsert_table(table, source)
    assert content(spark, table) == first
    upsert_table(table, source)
    assert content(spark, table) == [
        ("a", DAYS[1], 9.0),
        ("b", DAYS[2], 9.0),
        ("c", DAYS[2], 3.0),
        ("d", DAYS[0], 9.0),
    ]
    # What the broken run left behind belongs to no version.
    assert table.expire(spark)
    assert len(content(spark, table)) == 4


def test_readers_keep_their_version(spark, table):
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0)]))
    before = table.read(spark)
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 2.0), ("b", DAYS[1], 3.0)]))
    assert [r.cost for r in before.collect()] == [1.0]
    first, second = snapshots.versions(spark, table.path)
    assert [r.cost for r in table.read(spark, version=first).collect()] == [1.0]
    table.restore(spark, first)
    assert content(spark, table) == [("a", DAYS[0], 1.0)]
    with pytest.raises(ValueError, match="no version"):
        table.read(spark, version=second + 5)


def test_a_second_writer_is_refused(spark, table, monkeypatch):
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0)]))
    stale = table.snapshot(spark)
    upsert_table(table, silver_frame(spark, [("b", DAYS[0], 1.0)]))
    with pytest.raises(snapshots.ConcurrentWriteError):
        snapshots.commit(spark, table.path, snapshots.Snapshot(stale.version + 1))
    assert len(content(spark, table)) == 2


def test_upsert_reads_only_days_its_keys_were_in(spark, table, monkeypatch):
    """200 rows over 20 days; two known keys and one new one touch three days."""
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=k) for k in range(20)]
    rows = [(f"e{k}", days[k % 20], float(k)) for k in range(200)]
    upsert_table(table, silver_frame(spark, rows))
    asked = days_read(monkeypatch)
    source = silver_frame(spark, [("e3", days[3], 1.5), ("e25", days[7], 2.5), ("new", days[9], 3.5)])
    assert upsert_table(table, source) == [days[3], days[5], days[7], days[9]]
    assert None not in asked
    looked_up, rewritten = asked
    assert looked_up == {days[3], days[5]}
    assert rewritten == {days[3], days[5], days[7], days[9]}
    files = table.read(spark, [days[3]]).inputFiles()
    assert files and all(f"event_date={days[3]}" in name for name in files)


def test_a_key_with_its_day_in_it_needs_no_index(spark, tmp_path, monkeypatch):
    gold = DayTable.gold(Layout.for_warehouse(str(tmp_path)))
    upsert_table(gold, gold_frame(spark, [(d, c, 1) for d in DAYS for c in (1, 2)]))
    assert gold.snapshot(spark).keys == []
    asked = days_read(monkeypatch)
    upsert_table(gold, gold_frame(spark, [(DAYS[1], 1, 7)]))
    assert asked == [{DAYS[1]}, {DAYS[1]}]
    assert (DAYS[1], 1, 7) in content(spark, gold)


@pytest.mark.parametrize("seed", [3, 4])
def test_random_moves_match_a_dictionary(spark, table, seed):
    """Moves between days and to no day, overwrites, clears and many index runs."""
    rng = random.Random(seed)
    expected = {}
    days = [*DAYS, None]
    for step in range(KEY_RUNS + 3):
        keys = rng.sample([f"k{i}" for i in range(30)], rng.randint(1, 9))
        rows = [(k, rng.choice(days), float(rng.randint(0, 2))) for k in keys]
        if step % 5 == 3:
            # A direct overwrite: other rows of these days go.
            kept = {d for _, d, _ in rows}
            rows = [r for r in rows if r[0] not in expected or expected[r[0]][0] in kept]
            kept = {d for _, d, _ in rows}
            table.overwrite_days(silver_frame(spark, rows))
            expected = {k: v for k, v in expected.items() if v[0] not in kept}
        else:
            upsert_table(table, silver_frame(spark, rows), only_changed=rng.random() < 0.5)
        expected.update({k: (d, c) for k, d, c in rows})
        got = {r.event_id: (r.event_date, r.cost) for r in table.read(spark).collect()}
        assert got == expected
        assert table.read(spark).count() == len(expected)
        if step % 4 == 2:
            table.expire(spark)
    # The index holds every row's day.
    ids = silver_frame(spark, [(k, d, c) for k, (d, c) in expected.items()])
    assert table.unknown_keys(ids, table.known_days(spark, ids)).count() == 0
    assert len(table.snapshot(spark).keys) <= KEY_RUNS


def test_folders_without_versions_are_adopted(spark, table):
    old = silver_frame(spark, [("a", DAYS[0], 1.0), ("b", None, 2.0), ("c", DAYS[1], 3.0)])
    old.write.partitionBy("event_date").parquet(table.path)
    assert table.known_days(spark, old) is None
    assert table.read(spark).count() == 3
    upsert_table(table, silver_frame(spark, [("a", DAYS[2], 5.0), ("b", DAYS[0], 6.0)]))
    assert content(spark, table) == [("a", DAYS[2], 5.0), ("b", DAYS[0], 6.0), ("c", DAYS[1], 3.0)]
    assert table.known_days(spark, old).count() == 3
    table.expire(spark)
    assert content(spark, table) == [("a", DAYS[2], 5.0), ("b", DAYS[0], 6.0), ("c", DAYS[1], 3.0)]


def test_clone_shares_data_and_then_goes_its_own_way(spark, table, tmp_path):
    rows = [("a", DAYS[0], 1.0), ("b", DAYS[1], 2.0)]
    upsert_table(table, silver_frame(spark, rows))
    copy = table.clone(spark, str(tmp_path / "copy"))
    assert not list((tmp_path / "copy").rglob("*.parquet"))
    upsert_table(copy, silver_frame(spark, [("a", DAYS[2], 9.0)]))
    assert content(spark, copy) == [("a", DAYS[2], 9.0), ("b", DAYS[1], 2.0)]
    assert content(spark, table) == rows
    copy.expire(spark)
    assert content(spark, table) == rows


def test_expire_keeps_what_versions_need(spark, table):
    for cost in (1.0, 2.0, 3.0):
        upsert_table(table, silver_frame(spark, [("a", DAYS[0], cost), ("b", DAYS[1], 1.0)]))
    known = snapshots.versions(spark, table.path)
    table.expire(spark, keep=2)
    assert snapshots.versions(spark, table.path) == known[-2:]
    assert [r.cost for r in table.read(spark, version=known[-2]).filter("event_id = 'a'").collect()] == [2.0]
    with pytest.raises(ValueError):
        table.expire(spark, keep=0)


def test_catalog_entry_follows_versions(spark, tmp_path):
    table = DayTable.silver(Layout.for_warehouse(str(tmp_path)), "followed", "ads")
    upsert_table(table, silver_frame(spark, [("a", DAYS[0], 1.0), ("n", None, 2.0)]))
    upsert_table(table, silver_frame(spark, [("a", DAYS[1], 3.0), ("b", DAYS[1], 4.0)]))
    rows = spark.table("ads.followed").select("event_id", "event_date", "cost").collect()
    assert sorted(map(tuple, rows)) == [("a", DAYS[1], 3.0), ("b", DAYS[1], 4.0), ("n", None, 2.0)]


def test_upsert_by_replace_where_is_one_version(spark, tmp_path):
    gold = DayTable.gold(Layout.for_warehouse(str(tmp_path)))
    upsert_table(gold, gold_frame(spark, [(DAYS[0], 1, 1), (DAYS[1], 1, 2), (DAYS[2], 1, 3)]))
    before = snapshots.versions(spark, gold.path)
    where = F.col("summary_date") >= F.lit(DAYS[1])
    upsert.upsert_table(gold, gold_frame(spark, [(DAYS[1], 2, 5)]), replace_where=where)
    assert content(spark, gold) == [(DAYS[0], 1, 1), (DAYS[1], 2, 5)]
    assert len(snapshots.versions(spark, gold.path)) == len(before) + 1
