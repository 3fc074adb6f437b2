"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its distances to ``pivots`` vectors of the table. It is
posted in the inverted files of its ``posted`` nearest pivots; a query looks into the files of
its ``probed`` nearest pivots, ranks what it meets there by footrule distance between the two
orders (the sum of the differences of every pivot's place) and compares the best of them,
``share`` of each file and ``at_least`` in number, by exact cosine on the original vectors.

Footrules say little where they crowd together: within a cluster that is tighter than the gaps
between pivots all orders are nearly one. So the cut is no number of vectors but a footrule: that
of the last vector within the share, and an eighth more, or ``crowd`` of the largest possible
footrule if that is more. Every vector up to it is compared exactly, which costs about as much
as its footrule; a cluster within ``crowd`` of a query is thus searched as a whole.

Pivots are a bounded sample (the vectors with the smallest hash of their id, equal vectors
once); every vector is indexed. A file with many vectors (a frequent vector fills whole files)
is dealt into blocks by id, and so are its queries, so no task holds more than ``block_rows``
vectors and ``block_queries`` queries; a pair that shares several files is compared in one of
them only. A block gives back ``k`` neighbours per query at most.

Defined results: vectors that are NULL, empty, zero, hold NULL or non-finite components, or
have another length than most pivots, take no part; so do NULL ids. Rows that share an id count
once, by their best score, and are never neighbours of a query with that id. Ties go to the
smaller id. With fewer than ``k`` candidates all are returned. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adkpi.llm.shipping import ship
from adkpi.session import staged

PIVOTS = 128  # below 256: places are bytes
POSTED = 3
PROBED = 40
SHARE = 0.08
AT_LEAST = 64
CROWD = 0.125
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048


def _matrix(column: pa.Array | pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """Vectors without absent parts, in double precision, and their row numbers."""
    vectors, rows = [], []
    for row, item in enumerate(column):
        if item.is_valid and len(item):
            values = item.values
            if values.null_count == 0:
                vectors.append(values.to_numpy(zero_copy_only=False).astype(np.float64))
                rows.append(row)
    return vectors, np.asarray(rows, np.int64)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 and whether each row is finite and not zero."""
    largest = np.abs(vectors).max(1) if vectors.size else np.zeros(len(vectors))
    usable = np.isfinite(largest) & (largest > 0)
    scaled = vectors[usable] / largest[usable, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None], usable


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` different unit vectors, from a bounded sample of four times as many."""
    sample = (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .limit(4 * count)
        .select("embedding")
        .toArrow()
    )
    found, _ = _matrix(sample.column("embedding"))
    if not found:
        return np.zeros((0, 0))
    lengths = [len(v) for v in found]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    units, _ = _unit(np.array([v for v in found if len(v) == usual]))
    _, first = np.unique(units, axis=0, return_index=True)
    return units[np.sort(first)][:count]


def post(vectors: DataFrame, pivots: np.ndarray, files: int) -> DataFrame:
    """``pivot, vec_id, places, vector``: each vector in the files of its nearest pivots."""
    ship(vectors.sparkSession)
    files = min(files, len(pivots))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = _matrix(batch.column("embedding"))
            right = [i for i, v in enumerate(found) if len(v) == pivots.shape[1]]
            if not right or not len(pivots):
                continue
            rows, matrix = rows[right], np.array([found[i] for i in right])
            units, usable = _unit(matrix)
            rows = rows[usable]
            if not len(rows):
                continue
            order = np.argsort(-(units @ pivots.T), axis=1, kind="stable")
            places = np.empty(order.shape, np.uint8)
            np.put_along_axis(places, order, np.arange(len(pivots), dtype=np.uint8)[None], 1)
            again = pa.array(np.repeat(np.arange(len(rows)), files))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(order[:, :files].ravel().astype(np.int32)),
                    batch.column("vec_id").take(pa.array(rows)).cast(pa.int64()).take(again),
                    pa.array([p.tobytes() for p in places], pa.binary()).take(again),
                    pa.array([u.tobytes() for u in units], pa.binary()).take(again),
                ],
                names=["pivot", "vec_id", "places", "vector"],
            )

    usable = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    return usable.mapInArrow(entries, "pivot int, vec_id long, places binary, vector binary")


def _rows(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    pivots: int = PIVOTS,
    posted: int = POSTED,
    probed: int = PROBED,
    share: float = SHARE,
    at_least: int = AT_LEAST,
    crowd: float = CROWD,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``; both frames have ``vec_id`` and ``embedding``."""
    chosen = choose_pivots(vectors, pivots)
    probed = min(probed, len(chosen))
    posted = min(posted, len(chosen))
    least_cut = int(crowd * (len(chosen) ** 2 // 2))
    index = staged(post(vectors, chosen, posted))
    asked = post(queries, chosen, probed)
    # One row per pivot: how many blocks its file and its queries are dealt into.
    blocks = index.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_d"))
    turns = asked.groupBy("pivot").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("_q"))
    dealt = F.broadcast(blocks.join(turns, "pivot"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = index.join(dealt, "pivot").withColumn("_d", own("_d")).withColumn("_q", every("_q"))
    right = asked.join(dealt, "pivot").withColumn("_q", own("_q")).withColumn("_d", every("_d"))
    keys = ["pivot", "_d", "_q"]

    def compare(key, data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        pivot = key[0]
        out = []
        if len(data) and len(asking):
            data = data.sort_values("vec_id", kind="stable")
            ids = data["vec_id"].to_numpy()
            places = _rows(data["places"], np.uint8).astype(np.int16)
            units = _rows(data["vector"], np.float64)
            near = np.argsort(places, axis=1, kind="stable")[:, :posted]
            asked_places = _rows(asking["places"], np.uint8).astype(np.int16)
            asked_units = _rows(asking["vector"], np.float64)
            row = np.arange(len(ids))
            best = max(at_least, -int(-share * len(ids) // 1))
            for query, mine, unit in zip(asking["vec_id"], asked_places, asked_units):
                # Only the first file that both share, in the data's order, compares the pair.
                both = mine[near] < probed
                here = (near[row, both.argmax(1)] == pivot) & (ids != query)
                at = np.flatnonzero(here)
                if len(at) > best:
                    footrule = np.abs(places[at] - mine).sum(1, dtype=np.int64)
                    cut = int(np.partition(footrule, best - 1)[best - 1])
                    at = at[footrule <= max(cut + cut // 8, least_cut)]
                score = (units[at] * unit).sum(1)
                top = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(top), query), ids[at][top], score[top]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_pivot_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
