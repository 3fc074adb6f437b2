"""Raw-zone scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adkpi.paths import Layout
from adkpi.schemas import TOPICS, zone_schema
from adkpi.sources.files import read_or_empty

FORMATS = ("parquet", "json")


def read_zone(spark: SparkSession, path: str, event_type: str, fmt: str = "parquet") -> DataFrame:
    """One zone with its fixed schema; a zone nobody has written yet is empty."""
    if fmt not in FORMATS:
        raise ValueError(f"zone format must be one of {FORMATS}, not {fmt!r}")
    return read_or_empty(spark, path, zone_schema(event_type), fmt)


def read_zones(spark: SparkSession, layout: Layout, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {kind: read_zone(spark, layout.zone(kind), kind, fmt) for kind in TOPICS}
