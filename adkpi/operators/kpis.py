"""Campaign x day KPIs with late-conversion statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adkpi.functions.scalars import percent_or_zero, ratio_or_null

# Default lateness limit in seconds and accuracy of the percentile sketch.
LATE_THRESHOLD_SEC = 3600
PERCENTILE_ACCURACY = 10_000

KEYS = ("summary_date", "campaign")


def _keyed(silver: DataFrame) -> DataFrame:
    return silver.withColumnRenamed("event_date", "summary_date")


def _converted_delay() -> Column:
    return F.when(F.col("conversion") == 1, F.col("conversion_delay_sec"))


def _late(threshold_sec: int) -> Column:
    late = (F.col("conversion") == 1) & (F.col("conversion_delay_sec") > threshold_sec)
    return F.when(late, 1).otherwise(0)


def campaign_base(
    silver: DataFrame,
    late_threshold_sec: int = LATE_THRESHOLD_SEC,
    accuracy: int = PERCENTILE_ACCURACY,
) -> DataFrame:
    """One pass, one shuffle of partial aggregates; both percentiles share one sketch."""
    delay = _converted_delay()
    base = (
        _keyed(silver)
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("impressions"),
            F.sum("click").alias("clicks"),
            F.sum("conversion").alias("conversions"),
            F.sum("cost").alias("total_cost"),
            F.sum(_late(late_threshold_sec)).alias("late_conversion_count"),
            F.avg(delay.cast("double")).alias("avg_conversion_delay_sec"),
            F.percentile_approx(delay, [0.5, 0.95], accuracy).alias("_quantiles"),
        )
    )
    return base.select(
        *[c for c in base.columns if c != "_quantiles"],
        F.col("_quantiles")[0].cast("double").alias("p50_conversion_delay_sec"),
        F.col("_quantiles")[1].cast("double").alias("p95_conversion_delay_sec"),
    )


def campaign_base_exact(
    silver: DataFrame, late_threshold_sec: int = LATE_THRESHOLD_SEC
) -> DataFrame:
    """As ``campaign_base``, with percentiles that are exact at any group size.

    Rows are first counted per delay value, which spreads a dominant campaign over the
    shuffle; what is left per group is one row per distinct delay.
    """
    per_delay = (
        _keyed(silver)
        .withColumns({"_delay": _converted_delay(), "_late": _late(late_threshold_sec)})
        .groupBy(*KEYS, "_delay")
        .agg(
            F.count("*").alias("_rows"),
            F.sum("click").alias("_clicks"),
            F.sum("conversion").alias("_conversions"),
            F.sum("cost").alias("_cost"),
            F.sum("_late").alias("_late"),
        )
    )
    weight = F.when(F.col("_delay").isNotNull(), F.col("_rows"))
    group = Window.partitionBy(*KEYS)
    up_to = group.orderBy(F.col("_delay").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = per_delay.withColumns(
        {"_seen": F.sum(weight).over(up_to), "_of": F.sum(weight).over(group)}
    )
    return ranked.groupBy(*KEYS).agg(
        F.sum("_rows").alias("impressions"),
        F.sum("_clicks").alias("clicks"),
        F.sum("_conversions").alias("conversions"),
        F.sum("_cost").alias("total_cost"),
        F.sum("_late").alias("late_conversion_count"),
        (F.sum(F.col("_delay").cast("double") * weight) / F.sum(weight)).alias(
            "avg_conversion_delay_sec"
        ),
        _smallest_reaching(50).alias("p50_conversion_delay_sec"),
        _smallest_reaching(95).alias("p95_conversion_delay_sec"),
    )


def _smallest_reaching(percent: int) -> Column:
    """Smallest delay with at least ``percent`` of the conversions at or below it."""
    reached = F.col("_seen") * 100 >= F.col("_of") * percent
    return F.min(F.when(reached, F.col("_delay"))).cast("double")


def with_ratios(base: DataFrame) -> DataFrame:
    """Add CTR, CVR, CPA and the late share; only CPA is NULL without a denominator."""
    return base.select(
        *[key for key in KEYS if key in base.columns],
        "impressions",
        "clicks",
        "conversions",
        "total_cost",
        percent_or_zero(F.col("clicks"), F.col("impressions")).alias("ctr"),
        percent_or_zero(F.col("conversions"), F.col("clicks")).alias("cvr"),
        ratio_or_null(F.col("total_cost"), F.col("conversions")).alias("cpa"),
        "late_conversion_count",
        percent_or_zero(F.col("late_conversion_count"), F.col("conversions")).alias(
            "late_conversion_ratio"
        ),
        "avg_conversion_delay_sec",
        "p50_conversion_delay_sec",
        "p95_conversion_delay_sec",
    )


def campaign_kpis(
    silver: DataFrame,
    late_threshold_sec: int = LATE_THRESHOLD_SEC,
    accuracy: int = PERCENTILE_ACCURACY,
    exact_percentiles: bool = False,
) -> DataFrame:
    if exact_percentiles:
        return with_ratios(campaign_base_exact(silver, late_threshold_sec))
    return with_ratios(campaign_base(silver, late_threshold_sec, accuracy))
