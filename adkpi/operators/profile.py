"""Profile of a normalised data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adkpi.functions.scalars import percent_or_zero, ratio_or_null


def dataset_profile(records: DataFrame) -> DataFrame:
    """One row of totals and ratios. Only positive delays enter the mean delay."""
    positive = (F.col("conversion") != 0) & (F.col("conversion_timestamp") > F.col("timestamp"))
    delay = F.when(positive, F.col("conversion_timestamp") - F.col("timestamp"))
    totals = records.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("click"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("conversion"), F.lit(0)).alias("conversions"),
        F.coalesce(F.sum(F.col("cost").try_cast("double")), F.lit(0.0)).alias("total_cost"),
        F.count_distinct("campaign").alias("campaigns"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.coalesce(F.avg(delay) / 3600, F.lit(0.0)).alias("avg_delay_hours"),
    )
    start, end = (
        F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm") for c in ("min_ts", "max_ts")
    )
    clicks, conversions = F.col("clicks"), F.col("conversions")
    return totals.withColumns(
        {
            "ctr": F.when(F.col("total") > 0, percent_or_zero(clicks, F.col("total"))),
            "cvr": F.when(clicks > 0, percent_or_zero(conversions, clicks)),
            "cpa": ratio_or_null(F.col("total_cost"), conversions),
            "period": F.coalesce(F.concat(start, F.lit(" ~ "), end), F.lit("N/A")),
        }
    )
