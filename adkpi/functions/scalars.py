"""Scalar column expressions shared by the jobs. All are built-ins, none is a UDF."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this a timestamp counts as relative; default base for rebasing.
RELATIVE_TIMESTAMP_LIMIT = 1_000_000_000
DEFAULT_BASE_DATETIME = "2026-05-15T00:00:00"


def long_or(value: Column | str, default: int | None = 0) -> Column:
    """Whole number from text; blank or unparsable text gives the default."""
    parsed = _col(value).try_cast("bigint")
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("bigint"))


def text_or_blank(value: Column | str) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def cost_text(value: Column | str) -> Column:
    """Cost as text, blank read as 0.0; a non-numeric text stays visible."""
    text = text_or_blank(value)
    return F.when(text == "", F.lit("0.0")).otherwise(text)


def positive_or_null(value: Column) -> Column:
    return F.when(value > 0, value)


def clamped_delay(later: Column, earlier: Column) -> Column:
    """Seconds between two epochs, never negative."""
    return F.greatest(later - earlier, F.lit(0).cast("bigint"))


def iso_time(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss")


def percent_or_zero(part: Column, whole: Column) -> Column:
    """Percentage; 0 where there is nothing to divide by."""
    return F.when(whole > 0, part * F.lit(100.0).cast("double") / whole).otherwise(F.lit(0.0))


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def epoch_of(base_datetime: str) -> int:
    """Epoch seconds of an ISO text, read as UTC."""
    moment = dt.datetime.fromisoformat(base_datetime)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return int(moment.timestamp())


def as_of_day(as_of: dt.date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def seeded_digest(key: Column, seed: int) -> Column:
    """32 hex digits that depend on the seed and the key only.

    Equal-length hex texts order like numbers, so a cut-off can be compared as text.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def seeded_delay(key: Column, seed: int, longest: int) -> Column:
    """Repeatable pseudo-random whole number in [1, longest]."""
    number = F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("bigint")
    return number % F.lit(longest) + F.lit(1)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
