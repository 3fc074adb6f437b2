"""Zone map: first and last event day of every ingest day of the impression zone.

A zone is append-only and laid out by ingest time, so which of its days can hold events of a
recent window is not visible from its folders. The map keeps that, one entry per ingest day
(calendar-sized), and is brought up to date from the days whose number of files has changed.

Pruning needs no promise about dates. Only a *beginning* of the zone is left out: ingest days
before the first one with an event day inside the window. Every copy that is left out was
ingested before every copy that is read, so it can neither win over one that is read nor be
inside the window itself.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.paths import Layout
from adkpi.sources import snapshots
from adkpi.sources.snapshots import Snapshot
from adkpi.sources.zones import read_zone

_INGEST_DAY = re.compile(r"/raw_date=(\d{4}-\d{2}-\d{2})/")


@dataclass(frozen=True)
class DayStats:
    files: int
    rows: int
    first: str | None
    last: str | None


def refresh(spark: SparkSession, layout: Layout, kind: str = "impression") -> dict[dt.date, DayStats]:
    """The map of a Parquet zone, after reading the event times of new or changed days."""
    zone = read_zone(spark, layout.zone(kind), kind)
    found = (_INGEST_DAY.search(path) for path in zone.inputFiles())
    files = Counter(match.group(1) for match in found if match)
    path = layout.zone_map(kind)
    stored = snapshots.load(spark, path) or Snapshot()
    known = {day: DayStats(*json.loads(text)) for day, text in stored.properties.items()}
    stale = [day for day, n in files.items() if day not in known or known[day].files != n]
    if stale or known.keys() - files.keys():
        known = {day: stats for day, stats in known.items() if day in files}
        for row in _measured(zone, stale).collect():
            day = row["raw_date"].isoformat()
            known[day] = DayStats(files[day], row["rows"], row["first"], row["last"])
        texts = {d: json.dumps([s.files, s.rows, s.first, s.last]) for d, s in known.items()}
        after = replace(stored, version=stored.version + 1, properties=texts)
        snapshots.commit(spark, path, after)
        snapshots.drop_versions(spark, path, snapshots.versions(spark, path)[:-2])
    return {dt.date.fromisoformat(day): stats for day, stats in known.items()}


def _measured(zone: DataFrame, days: list[str]) -> DataFrame:
    """One row per ingest day; reads one column of those days' files."""
    chosen = zone.filter(F.col("raw_date").isin([dt.date.fromisoformat(day) for day in days]))
    event_day = F.to_date("event_timestamp")
    return chosen.groupBy("raw_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(event_day).cast("string").alias("first"),
        F.max(event_day).cast("string").alias("last"),
    )


def first_needed(stats: dict[dt.date, DayStats], cut: dt.date) -> dt.date | None:
    """First ingest day to read for event days from ``cut`` on; None if nothing can be left out."""
    for day in sorted(stats):
        last = stats[day].last
        if last is not None and dt.date.fromisoformat(last) >= cut:
            return day
    return max(stats) + dt.timedelta(days=1) if stats else None


def needed(first: dt.date) -> Column:
    """Rows without an ingest day rank behind all others and may stand alone, so they stay."""
    return (F.col("raw_date") >= F.lit(first)) | F.col("raw_date").isNull()


def rows_before(stats: dict[dt.date, DayStats], first: dt.date) -> int:
    return sum(s.rows for day, s in stats.items() if day < first)
