"""Quality rules on the summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _outside_percent(name: str) -> Column:
    return (F.col(name) < 0) | (F.col(name) > 100)


def rules() -> dict[str, Column]:
    """A row violates a rule where its expression is true; NULL never violates."""
    return {
        "impressions_not_positive": F.col("impressions") <= 0,
        "ctr_out_of_range": _outside_percent("ctr"),
        "cvr_out_of_range": _outside_percent("cvr"),
    }


def violating_rows(summary: DataFrame) -> DataFrame:
    return summary.filter(reduce(Column.__or__, rules().values()))


def violation_counts(summary: DataFrame) -> DataFrame:
    """One row: violations per rule, and rows that violate any rule."""
    checks = rules()
    anything = reduce(Column.__or__, checks.values())
    return summary.agg(
        *[F.count_if(broken).alias(name) for name, broken in checks.items()],
        F.count_if(anything).alias("violating_rows"),
    )


def assert_quality(summary: DataFrame) -> None:
    counts = violation_counts(summary).first().asDict()
    if counts["violating_rows"]:
        raise ValueError(f"summary violates quality rules: {counts}")
