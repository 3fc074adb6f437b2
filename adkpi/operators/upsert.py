"""Upserts: as plain frames, on day-partitioned Parquet tables, and by row-level merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.session import staged
from adkpi.sources.tables import CatalogTable, DayTable, conform

CLOCK_COLUMN = "updated_at"


class DuplicateKeyError(ValueError):
    """The source of an upsert holds a key more than once."""


def upsert_frames(
    target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Source rows, plus target rows whose key the source does not hold.

    Matched rows take all source values, unmatched source rows are inserted. Keys are
    unique on both sides, so the join has no hot key.
    """
    return _without(target, source, keys, null_safe).unionByName(source)


def overwrite_days_frames(target: DataFrame, source: DataFrame, day: str) -> DataFrame:
    """Source rows, plus target rows of days the source does not touch."""
    # Whatever the table size, a set of calendar days is bounded by the range of DATE, and
    # is a few thousand values in practice.
    days = source.select(day).distinct()
    kept = target.join(F.broadcast(days), target[day].eqNullSafe(days[day]), "left_anti")
    return kept.unionByName(source)


def changed_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Source rows that are new or differ from the target in any column but the clock's.

    Joined by key alone, so frames that are partitioned by it stay as they are.
    """
    compared = [c for c in source.columns if c != CLOCK_COLUMN and c not in keys]
    held = target.select(*keys, *compared, F.lit(True).alias("_held")).alias("r")
    joined = source.alias("l").join(held, _match("l", "r", keys, null_safe), "left")
    same = reduce(
        Column.__and__,
        [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in compared],
        F.col("r._held").isNotNull(),
    )
    return joined.filter(~same).select("l.*")


def require_unique(source: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key occurs twice. Counts are combined before the shuffle."""
    repeated = source.groupBy(*keys).count().filter(F.col("count") > 1)
    sample = repeated.limit(3).collect()
    if sample:
        raise DuplicateKeyError(f"duplicate keys in upsert source, for example {sample}")


def upsert_table(
    table: DayTable,
    source: DataFrame,
    only_changed: bool = False,
    replace_where: Column | None = None,
    check_unique: bool = True,
    rows_keep_day: bool = False,
) -> list[dt.date | None]:
    """Upsert ``source`` into ``table`` and return the days whose rows may have changed.

    The source is staged, then only the days are rewritten that hold a source row or a
    row replaced by one. A row may move to another day; a day that loses its last row that
    way is cleared. All days change in one step, or none (see ``DayTable``).

    Rows to replace are looked for in the days the key index names for the source's keys,
    and other days are not read. ``only_changed`` skips source rows equal to what the table
    holds. ``replace_where`` is a condition on the day: rows it selects go unless the source
    still has their key. ``rows_keep_day`` looks only in the days of the source; use it where
    a key can never change its day.
    """
    spark = source.sparkSession
    table.ensure(spark)
    keys = list(table.keys)
    source = staged(conform(source, table.schema))
    if check_unique:
        require_unique(source, keys)

    known = None
    if rows_keep_day or not table.indexed:
        lookup = table.read(spark, _days(source.select(table.day)))
    else:
        known = table.known_days(spark, source)
        if known is None:
            lookup = table.read(spark)
        else:
            known = staged(known)
            lookup = table.read(spark, _days(known.select("day")))
    full_source = source
    if only_changed:
        # Only rows whose key the source holds can tell whether it changed anything.
        lookup = staged(_join(lookup, source, keys, table.null_safe, "left_semi"))
        source = staged(changed_rows(lookup, source, keys, table.null_safe))

    replaced = _join(lookup, source, keys, table.null_safe, "left_semi")
    leaving_rows = replaced.select(table.day)
    if replace_where is not None:
        stored = table.read(spark).filter(replace_where)
        gone = _without(stored, full_source, keys, table.null_safe)
        leaving_rows = leaving_rows.unionByName(gone.select(table.day))
    arriving = source.select(table.day, F.lit(True).alias("arrives"))
    by_role = arriving.unionByName(leaving_rows.withColumn("arrives", F.lit(False))).distinct()
    source_days, leaving = set(), set()
    for day, arrives in by_role.collect():
        (source_days if arrives else leaving).add(day)
    touched = source_days | leaving
    if not touched:
        return []

    affected = table.read(spark, touched)
    remaining = _without(affected, source, keys, table.null_safe)
    if replace_where is not None:
        # Rows the source still has, but unchanged, stay in place.
        held = _join(
            remaining.filter(replace_where), full_source, keys, table.null_safe, "left_semi"
        )
        remaining = remaining.filter(~replace_where).unionByName(held)

    # A day that is not written again has lost all its rows.
    new_keys = None if known is None else table.unknown_keys(source, known)
    table.change_days(remaining.unionByName(source), leaving, new_keys)
    return sorted(touched, key=lambda day: (day is not None, day))


def in_days(column: str, days: Iterable[dt.date | None]) -> Column:
    """True for rows of the given days; None stands for rows without a day."""
    days = set(days)
    selected = F.col(column).isin(sorted(day for day in days if day is not None))
    return selected | F.col(column).isNull() if None in days else selected


def merge_into(
    table: CatalogTable,
    source: DataFrame,
    only_changed: bool = False,
    replace_where: Column | None = None,
) -> None:
    """The same upsert as a row-level merge, for catalog tables that support one."""
    source = staged(conform(source, table.schema))
    keys = list(table.keys)
    merged = source
    # Rows to delete are those the full source lacks, so it must then be merged as a whole.
    if only_changed and replace_where is None:
        held = _join(table.read(source.sparkSession), source, keys, table.null_safe, "left_semi")
        merged = staged(changed_rows(held, source, keys, table.null_safe))
    writer = (
        merged.alias("source")
        .mergeInto(table.name, _match(table.name, "source", keys, table.null_safe))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
    )
    if replace_where is not None:
        writer = writer.whenNotMatchedBySource(replace_where).delete()
    writer.merge()


def _match(left: str, right: str, keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"{left}.{key}"), F.col(f"{right}.{key}")) for key in keys]
    return reduce(Column.__and__, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool, how: str
) -> DataFrame:
    condition = _match("l", "r", keys, null_safe)
    return left.alias("l").join(right.select(*keys).alias("r"), condition, how)


def _without(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    return _join(left, right, keys, null_safe, "left_anti")


def _days(days: DataFrame) -> set[dt.date | None]:
    """Distinct days on the driver: bounded by the calendar, not by the data."""
    return {row[0] for row in days.distinct().collect()}
