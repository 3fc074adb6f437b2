"""Raw zones to the silver table."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adkpi.operators.assemble import first_recent_day
from adkpi.operators.state import (
    KINDS,
    account,
    count_ids,
    count_rows,
    event_rows,
    event_state,
    merged_state,
    silver_rows,
)
from adkpi.operators.upsert import merge_into, upsert_table
from adkpi.paths import Layout
from adkpi.schemas import STATE
from adkpi.session import in_utc, staged
from adkpi.sources import zone_map
from adkpi.sources.tables import CatalogTable, DayTable
from adkpi.sources.zones import read_zones

MODES = ("merge", "full-refresh", "replace-all", "incremental")

# Fixed value: default number of days a merge looks back.
MERGE_WINDOW_DAYS = 7


@in_utc
def run(
    spark: SparkSession,
    layout: Layout,
    mode: str = "merge",
    window_days: int | None | str = "default",
    as_of: dt.date | None = None,
    raw_format: str = "parquet",
    since: dt.date | None = None,
    only_changed: bool = False,
    trust_dates: bool = False,
    table: DayTable | CatalogTable | None = None,
) -> dict[str, Any]:
    """Rebuild silver rows from the zones and bring them into the table.

    ``merge`` upserts the days of the window (None: all days); ``full-refresh`` replaces
    the days that occur; ``replace-all`` replaces the table. ``since`` restricts a merge to
    ids ingested from that day on, which gives the same rows from less work. The window is
    ``MERGE_WINDOW_DAYS`` unless given, and all days with ``since``, whose late rows may be of
    any age.

    ``incremental`` keeps, beside silver, what each row was made from (see
    ``operators.state``), reads only zone days from the last one it has seen on, and changes
    only rows that differ. Its first run reads everything; ``since`` goes back further, for
    days that were filled in later. Clicks and conversions that come before their impression
    wait in the same table and are taken up by the run that brings it.

    A merge with a window leaves out the beginning of the impression zone by its zone map,
    which needs no promise about dates. ``trust_dates`` says that all copies of an id carry one
    event time and that nothing is ingested before the day of its impression. Then no zone
    partition before the window, and no table day outside of it, is read.
    A ``CatalogTable`` is written by row-level merge instead of partition overwrites.

    The report says for every zone where its rows went (``account``): ``rejected`` without an
    id, ``superseded`` by a newer copy, ``outside`` the window, ``unmatched`` (no impression
    among those read), or ``merged``. ``outside_window`` also counts impression rows that the
    zone map left out. All of it is counted by the scan and the write themselves.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if since is not None and mode not in ("merge", "incremental"):
        raise ValueError("since needs mode merge, as other modes would lose untouched rows")
    if trust_dates and mode != "merge":
        raise ValueError("trust_dates needs mode merge with a window of recent days")
    if mode == "incremental":
        if window_days not in (None, "default"):
            raise ValueError("mode incremental merges all it reads, so it takes no window")
        return _increment(spark, layout, raw_format, since, table or DayTable.silver(layout))
    if window_days == "default":
        window_days = None if since is not None else MERGE_WINDOW_DAYS
    if trust_dates and window_days is None:
        raise ValueError("trust_dates needs mode merge with a window of recent days")
    table = table or DayTable.silver(layout)
    table.ensure(spark)
    zones = read_zones(spark, layout, raw_format)
    windowed = mode == "merge" and window_days is not None
    cut = _first_day(spark, window_days, as_of) if windowed else None
    pruned = 0
    if trust_dates:
        zones = {kind: z.filter(F.col("raw_date") >= F.lit(cut)) for kind, z in zones.items()}
        moment = F.lit(cut).cast("timestamp")
        zones["impression"] = zones["impression"].filter(F.col("event_timestamp") >= moment)
    elif cut is not None and since is None and raw_format == "parquet":
        zones["impression"], pruned = _pruned(spark, layout, zones["impression"], cut)

    rows_seen, ids_seen, seen = Observation("zones"), Observation("ids"), Observation("silver")
    if since is not None:
        # Rows are counted where they are new, and then thinned out before they are ranked.
        new = {k: z.filter(F.col("raw_date") >= F.lit(since)) for k, z in zones.items()}
        fresh = count_rows(event_rows(new), rows_seen).filter(F.col("event_id").isNotNull())
        ids = staged(fresh.select("event_id").distinct())
        zones = {kind: z.join(ids, "event_id", "left_semi") for kind, z in zones.items()}
        state = event_state(event_rows(zones))
    else:
        state = event_state(count_rows(event_rows(zones), rows_seen))
    inside = F.lit(True) if cut is None else F.col("event_date") >= F.lit(cut)
    state = count_ids(state, ids_seen, inside).filter(F.coalesce(inside, F.lit(False)))
    rows = _counted(silver_rows(state), seen)

    days: list[dt.date | None] | None = None
    if mode == "merge":
        if isinstance(table, CatalogTable):
            merge_into(table, rows, only_changed)
        else:
            # One row per id by construction, so the uniqueness check is not repeated.
            days = upsert_table(
                table,
                rows,
                only_changed=only_changed,
                check_unique=False,
                rows_keep_day=trust_dates,
            )
    else:
        (table.overwrite_days if mode == "full-refresh" else table.replace_all)(rows)
    ids = ids_seen.get
    report = _report(table, mode, days, rows_seen.get, ids, seen.get)
    report["outside_window"] = ids["impression_outside"] + pruned
    if since is not None:
        # Old copies of touched ids were ranked as well, so the parts need not add up.
        report.pop("account")
    return report


def _increment(
    spark: SparkSession,
    layout: Layout,
    raw_format: str,
    since: dt.date | None,
    table: DayTable | CatalogTable,
) -> dict[str, Any]:
    """New zone days against the stored state; silver first, then the state it came from.

    A run that dies in between leaves the state behind silver, and the next one repeats the
    same rows.
    """
    table.ensure(spark)
    by_path = isinstance(table, DayTable)
    store = DayTable.state(table.path if by_path else layout.silver(table.name.rpartition(".")[2]))
    through = store.snapshot(spark).properties.get("through")
    zones = read_zones(spark, layout, raw_format)
    if through is not None:
        # The last day seen may have gone on since.
        start = min(dt.date.fromisoformat(through), since or dt.date.max)
        zones = {kind: z.filter(zone_map.needed(start)) for kind, z in zones.items()}
    rows_seen, ids_seen, seen = Observation("zones"), Observation("ids"), Observation("silver")
    new = staged(event_state(count_rows(event_rows(zones), rows_seen)))
    merged = staged(
        count_ids(merged_state(new, stored_state(store, new)), ids_seen, F.lit(True), "given")
    )
    changed = merged.filter(_differs())
    rows = _counted(silver_rows(changed), seen)
    days: list[dt.date | None] | None = None
    if isinstance(table, CatalogTable):
        merge_into(table, rows)
    else:
        days = upsert_table(table, rows, check_unique=False)
    newest = max(filter(None, [through, _text(rows_seen.get["through"])]), default=None)
    upsert_table(store, changed.select(*STATE.fieldNames()), check_unique=False)
    if newest is not None:
        store.note(spark, through=newest)
    return _report(table, "incremental", days, rows_seen.get, ids_seen.get, seen.get)


def stored_state(store: DayTable, new: DataFrame) -> DataFrame:
    """The stored rows of the ids in ``new``, from the days that the key index names."""
    spark = new.sparkSession
    known = store.known_days(spark, new)
    days = None if known is None else {row[0] for row in known.select("day").distinct().collect()}
    return store.read(spark, days).join(new.select("event_id"), "event_id", "left_semi")


def _differs() -> Column:
    same = F.col("was").isNotNull()
    for kind in KINDS:
        same = same & F.col(kind).eqNullSafe(F.col(f"was.{kind}"))
    return ~same


def _text(day: dt.date | None) -> str | None:
    return None if day is None else day.isoformat()


def _first_day(spark: SparkSession, window_days: int, as_of: dt.date | None) -> dt.date:
    return spark.range(1).select(first_recent_day(window_days, as_of)).first()[0]


def _pruned(
    spark: SparkSession, layout: Layout, zone: DataFrame, cut: dt.date
) -> tuple[DataFrame, int]:
    stats = zone_map.refresh(spark, layout)
    first = zone_map.first_needed(stats, cut)
    if first is None:
        return zone, 0
    return zone.filter(zone_map.needed(first)), zone_map.rows_before(stats, first)


def _report(table, mode: str, days, rows: dict, ids: dict, silver: dict) -> dict[str, Any]:
    return {
        "table": table.name or table.path,
        "mode": mode,
        "touched_days": days,
        "rejected": {kind: rows[f"{kind}_rejected"] for kind in KINDS},
        "account": account(rows, ids),
        "outside_window": ids["impression_outside"],
        **silver,
    }


def _counted(rows: DataFrame, seen: Observation) -> DataFrame:
    """Counts that come for free with the write."""
    return rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("click"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("conversion"), F.lit(0)).alias("conversions"),
    )
