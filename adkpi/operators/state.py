"""Mergeable state per event id: the newest copy of each kind, with the clock it came by.

One row per id holds the newest impression, whether there was a click, and the newest
conversion, each with ingest time and position. States of different rows merge by taking the
greater copy, so a run over new zone partitions needs the stored state and no old partition.
A click or conversion without an impression keeps its row: the orphan store, which is asked
again whenever something new comes in for that id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adkpi.schemas import STATE

KINDS = ("impression", "click", "conversion")


def _copy(zone: DataFrame, kind: str) -> Column:
    """The zone row as a struct that compares by clock, position, then values; NULL is least."""
    wanted = STATE[kind].dataType
    if not isinstance(wanted, T.StructType):
        return F.lit(1).alias(kind)
    held = [
        (F.col(f.name) if f.name in zone.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in wanted
    ]
    return F.struct(*held).cast(wanted).alias(kind)


def event_rows(zones: dict[str, DataFrame]) -> DataFrame:
    """All zone rows under one schema: id, ingest day, and the copy in the column of its kind."""
    parts = []
    for kind, zone in zones.items():
        others = [F.lit(None).cast(STATE[k].dataType).alias(k) for k in KINDS if k != kind]
        day = F.col("raw_date") if "raw_date" in zone.columns else F.lit(None).cast("date")
        part = zone.select("event_id", day.alias("raw_date"), _copy(zone, kind), *others)
        parts.append(part.select("event_id", "raw_date", *KINDS))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows


def event_state(rows: DataFrame) -> DataFrame:
    """One row per id: the greatest copy of each kind. Rows without an id are left out.

    One shuffle for all three zones, combined before it, so an id with very many copies
    sends one row per task.
    """
    newest = (
        rows.filter(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(*[F.max(kind).alias(kind) for kind in KINDS])
    )
    return _dated(newest)


def merged_state(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` (unique by id) with what ``old`` holds of its ids; ``was`` is the old row or NULL."""
    before = old.select("event_id", F.struct(*KINDS).alias("was"))
    joined = new.join(before, "event_id", "left")
    newest = [F.greatest(kind, f"was.{kind}").alias(kind) for kind in KINDS]
    given = F.struct(*[F.col(kind).isNotNull().alias(kind) for kind in KINDS]).alias("given")
    return _dated(joined.select("event_id", *newest, given, "was"), "given", "was")


def _dated(state: DataFrame, *more: str) -> DataFrame:
    day = F.to_date("impression.event_timestamp").alias("event_date")
    return state.select("event_id", day, *KINDS, *more)


def silver_rows(state: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Silver rows of the ids that have an impression."""
    return state.filter(F.col("impression").isNotNull()).select(
        "event_id",
        "event_date",
        "impression.uid",
        "impression.campaign",
        F.coalesce("click", F.lit(0)).alias("click"),
        F.when(F.col("conversion").isNotNull(), 1).otherwise(0).alias("conversion"),
        "conversion.conversion_delay_sec",
        "impression.cost",
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )


def count_rows(rows: DataFrame, seen: Observation) -> DataFrame:
    """Rows and rows without an id per kind, and the newest ingest day; free with the scan."""
    counts = []
    for kind in KINDS:
        of_kind = F.col(kind).isNotNull()
        counts.append(F.count_if(of_kind).alias(f"{kind}_rows"))
        counts.append(F.count_if(of_kind & F.col("event_id").isNull()).alias(f"{kind}_rejected"))
    return rows.observe(seen, *counts, F.max("raw_date").alias("through"))


def count_ids(state: DataFrame, seen: Observation, inside: Column, given: str = "") -> DataFrame:
    """Per kind: ids kept, outside the window, and without an impression; free with the write.

    ``given`` names a struct of flags where only some kinds of a row are new.
    """
    counts = []
    matched = F.col("impression").isNotNull()
    inside = F.coalesce(inside, F.lit(False))
    for kind in KINDS:
        new = F.col(f"{given}.{kind}") if given else F.col(kind).isNotNull()
        counts.append(F.count_if(new).alias(f"{kind}_ids"))
        counts.append(F.count_if(new & matched & inside).alias(f"{kind}_merged"))
        counts.append(F.count_if(new & matched & ~inside).alias(f"{kind}_outside"))
        counts.append(F.count_if(new & ~matched).alias(f"{kind}_unmatched"))
    return state.observe(seen, *counts)


def account(rows: dict, ids: dict) -> dict[str, dict[str, int]]:
    """Where every row of a run went; the parts of a kind add up to its ``rows``."""
    report = {}
    for kind in KINDS:
        total, rejected = rows[f"{kind}_rows"], rows[f"{kind}_rejected"]
        report[kind] = {
            "rows": total,
            "rejected": rejected,
            "superseded": total - rejected - ids[f"{kind}_ids"],
            "merged": ids[f"{kind}_merged"],
            "outside": ids[f"{kind}_outside"],
            "unmatched": ids[f"{kind}_unmatched"],
        }
    return report
