"""Connected components of an edge table, by alternating star contractions.

Each round hangs neighbours onto the smallest node they can see; rounds are staged, so a lost
executor repeats one round at most. No node's neighbours are ever gathered: minima are combined
before their shuffle and joined back, so a hub with very many neighbours is only a skewed join.
A few edges (``_FEW``) are contracted in one task, where rounds would cost more than their work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from adkpi.llm.shipping import ship
from adkpi.session import staged

# Edges, of 16 bytes each, that one task takes at most; of more, none does.
_FEW = 1 << 17


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The staged edges, with their number and a checksum that come with the write."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total")
    out = staged(edges.observe(seen, F.count(F.lit(1)).alias("rows"), total))
    return out, (seen.get["rows"], seen.get["total"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), "m")
    return moved.unionAll(least).select("a", F.col("m").alias("b")).distinct()


def least_reached(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest of ``count`` nodes that each reaches over the edges."""
    least = np.arange(count)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            return least


def _in_one_task(edges: DataFrame) -> DataFrame:
    ship(edges.sparkSession)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[np.asarray(x.column(c)) for c in "ab"] for x in batches]
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends))
            ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            least = ids[least_reached(at[: len(a)], at[len(a) :], len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(reach, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``a, b`` pairs; component is its smallest node.

    Loops, repeated pairs and either direction are fine. No edges give no rows.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, state = _round(ends.filter("a <> b").distinct())
    if 0 < state[0] <= _FEW:
        return _in_one_task(current)
    while state[0]:
        current, reached = _round(_small_star(_large_star(current)))
        if reached == state:
            break
        state = reached
    hung = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return hung.unionAll(roots)
