"""Latest copy per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    key: str = "event_id",
    clock: str = "ingest_ts",
    ties: Sequence[str] = ("kafka_partition", "kafka_offset"),
) -> DataFrame:
    """One row per key: the newest by ``clock``, then by ``ties``, nulls last.

    Comparing the row number with 1 lets Spark keep one row per key in every input
    partition before the shuffle, so a key with very many copies does not reach one task
    in full. Tie columns the frame lacks are left out.
    """
    order = [F.col(c).desc_nulls_last() for c in (clock, *ties) if c in df.columns]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def split_rejects(df: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and rows without one (they could never be matched again)."""
    return df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
