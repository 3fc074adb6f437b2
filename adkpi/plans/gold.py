"""Silver table to the campaign x day summary."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.operators.assemble import first_recent_day, recent_days
from adkpi.operators.kpi_state import kpi_state, kpis_of, merged
from adkpi.operators.kpis import LATE_THRESHOLD_SEC, PERCENTILE_ACCURACY, campaign_kpis
from adkpi.operators.quality import assert_quality
from adkpi.operators.upsert import in_days, merge_into, upsert_table
from adkpi.paths import Layout
from adkpi.session import in_utc, staged
from adkpi.sources.tables import CatalogTable, DayTable

# Fixed value: default number of days a run re-aggregates.
MERGE_WINDOW_DAYS = 7


@in_utc
def run(
    spark: SparkSession,
    layout: Layout,
    window_days: int | None = MERGE_WINDOW_DAYS,
    late_threshold_sec: int = LATE_THRESHOLD_SEC,
    as_of: dt.date | None = None,
    check: bool = True,
    check_stored: bool = False,
    days: Sequence[dt.date | None] | None = None,
    accuracy: int = PERCENTILE_ACCURACY,
    exact_percentiles: bool = False,
    only_changed: bool = False,
    delete_missing: bool = False,
    keep_state: bool = False,
    silver: DayTable | CatalogTable | None = None,
    table: DayTable | CatalogTable | None = None,
) -> dict[str, Any]:
    """Re-aggregate recent days (or exactly ``days``), check them, upsert them.

    The check sees the computed rows before anything is written, so a failed run leaves
    the table as it was. ``days`` is the list a silver merge returns: a late conversion
    then costs the days it changed and no others. ``check_stored`` also checks the whole
    stored summary after the write, so bad rows of earlier runs are reported. ``delete_missing`` also removes groups
    of the selected days that silver no longer has.

    ``keep_state`` also stores mergeable state per campaign and day beside the summary, and
    takes the summary from it; ``rollup`` then answers for any stretch of days from that state.
    """
    if keep_state and exact_percentiles:
        raise ValueError("stored state holds sketches, so it cannot give exact percentiles")
    silver = silver or DayTable.silver(layout)
    table = table or DayTable.gold(layout)
    table.ensure(spark)
    events = silver.read(spark)
    if days is not None:
        events = events.filter(in_days("event_date", days))
        selected = in_days("summary_date", days)
    elif window_days is not None:
        events = recent_days(events, window_days, as_of)
        selected = F.col("summary_date") >= first_recent_day(window_days, as_of)
    else:
        selected = F.lit(True)
    if keep_state:
        state = staged(kpi_state(events, late_threshold_sec))
        summary = kpis_of(state)
    else:
        summary = campaign_kpis(events, late_threshold_sec, accuracy, exact_percentiles)
    kpis = staged(summary.withColumn("updated_at", F.current_timestamp()))
    if check:
        assert_quality(kpis)

    replace_where = selected if delete_missing else None
    touched: list[dt.date | None] | None = None
    if isinstance(table, CatalogTable):
        merge_into(table, kpis, only_changed, replace_where)
    else:
        touched = upsert_table(
            table, kpis, only_changed, replace_where=replace_where, check_unique=False
        )
    if keep_state:
        store = DayTable.kpi_state(_path(layout, table))
        upsert_table(store, state, replace_where=replace_where, check_unique=False)
    if check_stored:
        assert_quality(table.read(spark))
    return {"table": table.name or table.path, "rows": kpis.count(), "touched_days": touched}


def rollup(
    spark: SparkSession,
    layout: Layout,
    days: Sequence[dt.date | None] | None = None,
    table: DayTable | CatalogTable | None = None,
) -> DataFrame:
    """KPIs per campaign over ``days`` (None: all) from stored state; silver is not read."""
    store = DayTable.kpi_state(_path(layout, table or DayTable.gold(layout)))
    return kpis_of(merged(store.read(spark, days), ["campaign"]))


def _path(layout: Layout, table: DayTable | CatalogTable) -> str:
    return table.path if isinstance(table, DayTable) else layout.gold(table.name.rpartition(".")[2])
