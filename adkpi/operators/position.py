"""Global row positions in sort order, and what is built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adkpi.session import staged

# Marks at which the order of timestamps is sketched, and how exact the sketch is.
_GRID, _ACCURACY = 200, 2000

# monotonically_increasing_id: partition number above, row within the partition below.
_ROW_BITS = 33

# Rows of the initial load, of the five increments, and of the quick sample.
INITIAL_ROWS = 800_000
BATCH_ROWS = (20_000, 30_000, 40_000, 50_000, 60_000)
SAMPLE_ROWS = 1000


def sorted_by_time(df: DataFrame, *ties: str | Column) -> DataFrame:
    return df.orderBy("timestamp", *ties)


def first_by_time(df: DataFrame, count: int | None, *ties: str | Column) -> DataFrame:
    """The first ``count`` rows; None means all, 0 means none.

    A first pass over the timestamps alone finds one that at least ``count`` rows do not
    exceed; only rows up to it are sorted and numbered. Cut by position at every count, so no
    task holds more than its range of the order, also where many rows share the last timestamp.
    """
    if count is None:
        return sorted_by_time(df, *ties)
    if count <= 0:
        return df.limit(0)
    early = df
    total, last = _reached(df, count)
    if last is not None and count < total:
        # Rows without a timestamp come first in the order.
        early = df.filter(F.col("timestamp").isNull() | (F.col("timestamp") <= F.lit(last)))
        # The sort looks at its input twice, which need not be the whole table.
        early = staged(early)
    positioned = with_position(early, ["timestamp", *ties])
    return positioned.filter(F.col("position") < count).orderBy("position").drop("position")


def _reached(df: DataFrame, count: int) -> tuple[int, int | None]:
    """Number of rows, and a timestamp that at least ``count`` of them do not exceed."""
    grid = [k / _GRID for k in range(_GRID + 1)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("timestamp").alias("timed"),
        F.percentile_approx("timestamp", grid, _ACCURACY).alias("marks"),
    ).first()
    if not row["timed"]:
        return row["rows"], None
    # A mark's true rank is off by one part in ``_ACCURACY`` at most; a step more is spare.
    share = max(0, count - (row["rows"] - row["timed"])) / row["timed"]
    step = math.ceil((share + 1 / _ACCURACY) * _GRID) + 1
    return row["rows"], row["marks"][step] if step <= _GRID else None


def with_position(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add ``position``: 0 for the first row in ``order``, 1 for the next, and so on.

    ``order`` should be total; it then also splits a timestamp that many rows share.
    One range shuffle sorts the rows; they are staged with their partition and their
    place in it, so both passes over them see the same numbers. Partition sizes become
    start positions, one row per partition, and are joined back by partition number.
    """
    slot = F.monotonically_increasing_id()
    placed = staged(df.orderBy(*order).withColumn("_slot", slot))
    part = F.shiftright("_slot", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # As many rows as the sort had partitions, so one task and a broadcast are enough.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    starts = sizes.select("_part", start.alias("_start"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_slot") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return numbered.select(*df.columns, (F.col("_start") + place).alias("position"))


def with_splits(
    positioned: DataFrame,
    initial: int = INITIAL_ROWS,
    batches: Sequence[int] = BATCH_ROWS,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per output a position belongs to: ``initial``, a batch or ``rest``, and ``sample``.

    The sample repeats the first rows of the initial load. Positions past the last batch are
    the ``rest``, so every row comes back.
    """
    position = F.col("position")
    start = initial
    by_range = F.when(position < initial, "initial")
    for number, rows in enumerate(batches, 1):
        by_range = by_range.when(
            (position >= start) & (position < start + rows), f"batch_{number:02d}"
        )
        start += rows
    by_range = by_range.otherwise("rest")
    outputs = F.array_compact(F.array(by_range, F.when(position < sample, F.lit("sample"))))
    return positioned.withColumn("split", F.explode(outputs))
