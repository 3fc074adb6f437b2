"""Mergeable KPI state per campaign and day: counts, sums, and a KLL sketch of the delays.

Percentiles of two days cannot be had from the percentiles of each; from the sketches they can.
So the state of touched days is computed anew from silver, and any coarser grain (campaign
totals, weeks, a rolling month) is merged from stored state without reading silver.

A sketch of size ``k`` holds every delay of up to ``k`` conversions exactly; beyond that the
rank of an answer is off by about ``2.3 / k`` of the group at most (99 %), merged or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adkpi.operators.kpis import KEYS, LATE_THRESHOLD_SEC, with_ratios
from adkpi.schemas import KPI_STATE

SKETCH_SIZE = 4096

_SUMS = ("impressions", "clicks", "conversions", "total_cost", "late_conversion_count", "delay_sum")


def kpi_state(
    silver: DataFrame, late_threshold_sec: int = LATE_THRESHOLD_SEC, size: int = SKETCH_SIZE
) -> DataFrame:
    """State per day and campaign, in one pass; partial sketches are merged like partial sums."""
    converted = F.col("conversion") == 1
    delay = F.when(converted, F.col("conversion_delay_sec"))
    late = F.when(converted & (F.col("conversion_delay_sec") > late_threshold_sec), 1).otherwise(0)
    state = (
        silver.withColumnRenamed("event_date", "summary_date")
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("impressions"),
            F.sum("click").alias("clicks"),
            F.sum("conversion").alias("conversions"),
            F.sum("cost").alias("total_cost"),
            F.sum(late).alias("late_conversion_count"),
            F.sum(delay.cast("double")).alias("delay_sum"),
            F.kll_sketch_agg_bigint(delay, F.lit(size)).alias("delays"),
        )
    )
    return state.select(*KPI_STATE.fieldNames())


def merged(state: DataFrame, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """State of coarser groups."""
    return state.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in _SUMS],
        F.kll_merge_agg_bigint("delays", F.lit(size)).alias("delays"),
    )


def base_of(state: DataFrame) -> DataFrame:
    """What ``kpis.campaign_base`` computes from silver, from state instead."""
    seen = F.kll_sketch_get_n_bigint("delays")
    quantile = lambda at: F.when(
        seen > 0, F.kll_sketch_get_quantile_bigint("delays", F.lit(at))
    ).cast("double")
    groups = [name for name in state.columns if name not in (*_SUMS, "delays")]
    return state.select(
        *groups,
        *[name for name in _SUMS if name != "delay_sum"],
        F.when(seen > 0, F.col("delay_sum") / seen).alias("avg_conversion_delay_sec"),
        quantile(0.5).alias("p50_conversion_delay_sec"),
        quantile(0.95).alias("p95_conversion_delay_sec"),
    )


def kpis_of(state: DataFrame) -> DataFrame:
    """The summary of a state per day and campaign."""
    return with_ratios(base_of(state))
