"""Raw combined records to the normalised record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.functions.scalars import (
    DEFAULT_BASE_DATETIME,
    RELATIVE_TIMESTAMP_LIMIT,
    cost_text,
    epoch_of,
    long_or,
    positive_or_null,
    text_or_blank,
)
from adkpi.schemas import CATEGORY_COLUMNS


def timestamp_range(raw: DataFrame, column: str = "timestamp") -> DataFrame:
    """Row count and smallest / largest timestamp; unparsable ones count as rows only."""
    parsed = long_or(column, default=None)
    return raw.agg(
        F.min(parsed).alias("min_ts"),
        F.max(parsed).alias("max_ts"),
        F.count("*").alias("row_count"),
    )


def rebase_offset(
    raw: DataFrame,
    column: str = "timestamp",
    base_datetime: str = DEFAULT_BASE_DATETIME,
    preserve_relative: bool = False,
) -> Column:
    """Seconds to add to every timestamp of ``raw``: the base if they are relative, else 0.

    A scalar subquery over the whole input: one row, worked out once, no join.
    """
    if preserve_relative:
        return F.lit(0).cast("bigint")
    largest = F.max(long_or(column, default=None))
    offset = F.when(largest < RELATIVE_TIMESTAMP_LIMIT, F.lit(epoch_of(base_datetime)))
    return raw.agg(F.coalesce(offset, F.lit(0)).cast("bigint").alias("offset")).scalar()


def normalise(
    raw: DataFrame,
    offset: Column | int = 0,
    keep_cats: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Seven columns with defaults for blanks; columns the input lacks count as blank."""

    def cell(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    shift = F.lit(offset).cast("bigint") if isinstance(offset, int) else offset
    return raw.select(
        *carry,
        (long_or(cell("timestamp")) + shift).alias("timestamp"),
        text_or_blank(cell("uid")).alias("uid"),
        text_or_blank(cell("campaign")).alias("campaign"),
        long_or(cell("click")).alias("click"),
        long_or(cell("conversion")).alias("conversion"),
        (positive_or_null(long_or(cell("conversion_timestamp"))) + shift).alias(
            "conversion_timestamp"
        ),
        cost_text(cell("cost")).alias("cost"),
        *[text_or_blank(cell(c)).alias(c) for c in (CATEGORY_COLUMNS if keep_cats else [])],
    )
