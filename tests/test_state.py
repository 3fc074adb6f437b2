"""Stored state, orphans, the zone map, and the account of a run's rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_golden import (
    AS_OF,
    B,
    CLICK,
    CONVERSION,
    IMPRESSION,
    SILVER_AFTER_B,
    batch_a,
    batch_b,
    silver_rows,
    write_zone,
)
from test_incremental import FIRST, append, arrivals, tables

from adkpi import cli
from adkpi.operators.assemble import assemble_silver
from adkpi.operators.state import event_rows, event_state
from adkpi.operators.state import silver_rows as rows_of_state
from adkpi.paths import Layout
from adkpi.plans import gold, silver
from adkpi.sources import zone_map
from adkpi.sources.tables import DayTable
from adkpi.sources.zones import read_zones


def adds_up(report):
    for kind, parts in report["account"].items():
        assert parts["rows"] == sum(v for k, v in parts.items() if k != "rows"), (kind, parts)


@pytest.mark.parametrize("seed", [5, 6])
def test_state_gives_the_rows_of_the_joins(spark, tmp_path, seed):
    layout = Layout.for_warehouse(str(tmp_path))
    for (day, kind), rows in arrivals(random.Random(seed), 4).items():
        append(spark, layout, day, kind, rows)
    z = read_zones(spark, layout)
    joined = assemble_silver(z["impression"], z["click"], z["conversion"], F.lit(None))
    merged = rows_of_state(event_state(event_rows(z)), F.lit(None))
    assert merged.columns == joined.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, joined.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_against_stored_state_equal_one_full_run(spark, tmp_path, seed):
    steps, full = (Layout.for_warehouse(str(tmp_path / n)) for n in ("steps", "full"))
    for (day, kind), rows in arrivals(random.Random(seed), 3).items():
        append(spark, full, day, kind, rows)
        append(spark, steps, day, kind, rows)
        if kind == "conversion":
            report = silver.run(spark, steps, mode="incremental")
            adds_up(report)
            gold.run(spark, steps, days=report["touched_days"], check=False, delete_missing=True)
    silver.run(spark, full, window_days=None)
    gold.run(spark, full, window_days=None, check=False)
    assert tables(spark, steps) == tables(spark, full)
    through = DayTable.state(steps.silver()).snapshot(spark).properties["through"]
    assert through == str(FIRST + dt.timedelta(days=2))
    # Nothing new: nothing is written.
    again = silver.run(spark, steps, mode="incremental")
    assert (again["touched_days"], again["rows"]) == ([], 0)


def test_an_increment_reads_no_old_zone_day(spark, tmp_path, monkeypatch):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, mode="incremental")
    batch_b(spark, layout)
    ranked = []
    plain = silver.event_state
    monkeypatch.setattr(silver, "event_state", lambda rows: ranked.append(rows) or plain(rows))
    silver.run(spark, layout, mode="incremental")
    assert silver_rows(spark, layout) == SILVER_AFTER_B
    [rows] = ranked
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [((raw_date") == 3
    days = rows.select("raw_date").distinct().collect()
    assert {r[0] for r in days} == {dt.date(2026, 5, 16), dt.date(2026, 5, 17)}


def test_orphans_wait_for_their_impression(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    write_zone(spark, layout, "click", [("e1",), ("e2",), ("e2",)], CLICK, 15)
    write_zone(spark, layout, "conversion", [("e1", 60), (None, 5)], CONVERSION, 15)
    report = silver.run(spark, layout, mode="incremental")
    adds_up(report)
    assert report["account"]["click"] == {
        "rows": 3, "rejected": 0, "superseded": 1, "merged": 0, "outside": 0, "unmatched": 2,
    }
    assert report["rejected"] == {"impression": 0, "click": 0, "conversion": 1}
    assert silver_rows(spark, layout) == {}
    waiting = DayTable.state(layout.silver()).read(spark).filter("impression is null")
    assert {r.event_id for r in waiting.collect()} == {"e1", "e2"}
    rows = [("e1", B, "u", 1, 1.0), ("e3", B, "u", 1, 3.0)]
    write_zone(spark, layout, "impression", rows, IMPRESSION, 17)
    silver.run(spark, layout, mode="incremental")
    assert silver_rows(spark, layout) == {"e1": (1, 1, 60, 1.0), "e3": (0, 0, None, 3.0)}
    # An older copy that is filled in later changes nothing; it needs a start that reaches it.
    write_zone(spark, layout, "impression", [("e3", B, "u", 1, 9.0)], IMPRESSION, 14)
    write_zone(spark, layout, "impression", [("e2", B, "u", 1, 2.0)], IMPRESSION, 14)
    silver.run(spark, layout, mode="incremental", since=dt.date(2026, 5, 14))
    assert silver_rows(spark, layout) == {
        "e1": (1, 1, 60, 1.0),
        "e2": (1, 0, None, 2.0),
        "e3": (0, 0, None, 3.0),
    }


def test_a_run_that_dies_before_the_state_is_repeated(spark, tmp_path, monkeypatch):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    silver.run(spark, layout, mode="incremental")
    batch_b(spark, layout)
    plain = silver.upsert_table

    def dies(table, *args, **kwargs):
        if table.path.endswith("_state"):
            raise OSError("lost")
        return plain(table, *args, **kwargs)

    with monkeypatch.context() as broken:
        broken.setattr(silver, "upsert_table", dies)
        with pytest.raises(OSError):
            silver.run(spark, layout, mode="incremental")
    silver.run(spark, layout, mode="incremental")
    assert silver_rows(spark, layout) == SILVER_AFTER_B


def test_every_row_of_a_merge_is_accounted_for(spark, tmp_path):
    layout = Layout.for_warehouse(str(tmp_path))
    batch_a(spark, layout)
    batch_b(spark, layout)
    write_zone(spark, layout, "impression", [(None, B, "u", 1, 1.0)], IMPRESSION, 17)
    report = silver.run(spark, layout, as_of=dt.date(2026, 5, 17), window_days=1)
    adds_up(report)
    assert report["account"]["impression"] == {
        "rows": 9, "rejected": 1, "superseded": 1, "merged": 2, "outside": 5, "unmatched": 0,
    }
    assert report["account"]["conversion"]["unmatched"] == 1
    assert report["outside_window"] == 5


def late_copies(spark, layout, seed):
    """Impressions over 12 ingest days whose copies disagree about the event day."""
    rng = random.Random(seed)
    for day in range(3, 15):
        rows = []
        for _ in range(6):
            event_day = rng.choice([day - 1, day - 1, rng.randint(0, day), 0])
            rows.append((f"e{rng.randint(0, 25)}", B - 86400 * (15 - event_day), "u", 1, float(day)))
        write_zone(spark, layout, "impression", rows, IMPRESSION, day)
    write_zone(spark, layout, "click", [(f"e{k}",) for k in range(0, 26, 3)], CLICK, 14)


@pytest.mark.parametrize("seed", [1, 2])
def test_zone_map_leaves_out_days_and_no_row(spark, tmp_path, seed):
    """Copies that disagree about the event day: pruned and full runs agree row by row."""
    layout = Layout.for_warehouse(str(tmp_path))
    late_copies(spark, layout, seed)
    z = read_zones(spark, layout)
    full = assemble_silver(z["impression"], z["click"], z["conversion"], F.lit(None))
    stats = zone_map.refresh(spark, layout)
    assert len(stats) == 12
    pruned_any = False
    for window in (1, 3, 8):
        cut = AS_OF - dt.timedelta(days=window + 3)
        first = zone_map.first_needed(stats, cut)
        pruned_any |= zone_map.rows_before(stats, first) > 0
        fewer = z["impression"].filter(zone_map.needed(first))
        some = assemble_silver(fewer, z["click"], z["conversion"], F.lit(None))
        recent = F.col("event_date") >= F.lit(cut)
        assert sorted(map(str, some.filter(recent).collect())) == sorted(
            map(str, full.filter(recent).collect())
        )
        plan = fewer._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [((raw_date" in plan
    assert pruned_any


def test_zone_map_reads_only_days_with_new_files(spark, tmp_path, monkeypatch):
    layout = Layout.for_warehouse(str(tmp_path))
    assert zone_map.refresh(spark, layout) == {}
    assert zone_map.first_needed({}, AS_OF) is None
    batch_a(spark, layout)
    measured = []
    plain = zone_map._measured
    monkeypatch.setattr(zone_map, "_measured", lambda z, days: measured.append(days) or plain(z, days))
    first = zone_map.refresh(spark, layout)
    assert first[dt.date(2026, 5, 16)].last == "2026-05-16"
    batch_b(spark, layout)
    zone_map.refresh(spark, layout)
    zone_map.refresh(spark, layout)
    assert measured == [["2026-05-16"], ["2026-05-17"]]
    # A file that comes late into a day already mapped is noticed.
    write_zone(spark, layout, "impression", [("z", B + 10 * 86400, "u", 1, 1.0)], IMPRESSION, 16)
    assert zone_map.refresh(spark, layout)[dt.date(2026, 5, 16)].last == "2026-05-25"


def test_modes_are_reached_from_the_command_line(spark):
    args = cli.build_parser().parse_args(["silver", "--warehouse", "/w", "--mode", "incremental"])
    assert args.mode == "incremental"
    for bad in ({"window_days": 3}, {"trust_dates": True}):
        with pytest.raises(ValueError):
            silver.run(spark, Layout("/x", "/x"), mode="incremental", **bad)
