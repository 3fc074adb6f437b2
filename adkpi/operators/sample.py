"""Uniform sample of a fixed size, without replacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.functions.scalars import seeded_digest
from adkpi.session import staged

_SPACE = 1 << 128
_COPIES_PER_BLOCK = 10_000
# Digests of repeated rows that are sent to every task: 16 bytes each.
BROADCAST_DIGESTS = 500_000


def fixed_size_sample(
    df: DataFrame, size: int | None, key: str, seed: int = 42, total: int | None = None
) -> DataFrame:
    """The ``size`` rows with the smallest seeded digest of ``key``; all if fewer, or for None.

    ``key`` must identify a row. The choice depends on seed and key only, not on how the
    rows are partitioned. Digests are uniform, so a cut-off a little above the expected
    one lets through just over ``size`` rows. These are staged, and the surplus is taken
    off by ranking only a narrow band at the upper end, about the square root of ``size``
    wide. The input is read twice (once if ``total`` is given) and never shuffled.
    """
    if size is None:
        return df
    if size < 0:
        raise ValueError("sample size must not be negative")
    if total is None:
        total = df.count()
    if size >= total:
        return df
    digest = F.col("_digest")
    ranked = df.withColumn("_digest", seeded_digest(F.col(key), seed))
    margin = 8 * math.sqrt(size) + 64
    while True:
        high = _cut(size + margin, total)
        pool = staged(ranked if high is None else ranked.filter(digest < high))
        # Without a cut the pool holds everything, also where ``total`` was told too high.
        if high is None or pool.count() >= size:
            break
        margin *= 8
    while True:
        low = _cut(size - margin, total)
        sure = pool.limit(0) if low is None else pool.filter(digest < low)
        known = sure.count()
        if known <= size:
            break
        margin *= 8
    band = pool if low is None else pool.filter(digest >= low)
    chosen = band.orderBy(digest, key).limit(size - known)
    return sure.unionByName(chosen).drop("_digest")


def with_row_key(df: DataFrame, name: str, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """Add a text key from a row's content and its number among equal rows.

    The same rows get the same keys however they are split or read. A first pass shuffles
    128-bit digests alone, counted before the shuffle, and stages those that occur twice or
    more. Rows with any other digest are the only ones of their kind: they take number 1 where
    they are read. Only repeated rows are gathered and numbered. With more than ``broadcast``
    repeated digests all rows are numbered by a shuffle instead, with the same keys.
    """
    content = _content(df)
    digest = F.unhex(F.md5(content))
    counted = df.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = staged(counted.filter("_copies > 1").select("_digest"))
    found = repeated.count()
    if found > broadcast:
        return _numbered(df, name)
    single = df.withColumn("_digest", digest)
    if found:
        known = F.broadcast(repeated)
        single = single.join(known, "_digest", "left_anti")
    single = single.select(*df.columns, _row_key(content, F.lit(1)).alias(name))
    if not found:
        return single
    again = df.withColumn("_digest", digest).join(known, "_digest", "left_semi")
    return single.unionAll(_numbered(again.select(*df.columns), name))


def _content(df: DataFrame) -> Column:
    # to_json keeps cells apart and leaves absent ones out.
    return F.to_json(F.struct(*df.columns))


def _row_key(content: Column, copy: Column) -> Column:
    return F.md5(F.concat_ws("|", content, copy.cast("string")))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Keys by one shuffle of whole rows.

    Equal rows are counted first, combined before the shuffle, and dealt out again in blocks,
    so a line that is repeated very often is neither gathered in one task nor unfolded there.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    last = F.floor((F.col("_copies") - 1) / _COPIES_PER_BLOCK)
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # Only rows with more than one block are dealt anew; the others stay where they are.
    many = blocks.filter(F.col("_copies") > _COPIES_PER_BLOCK).repartition(*df.columns, "_block")
    one = blocks.filter(F.col("_copies") <= _COPIES_PER_BLOCK)
    first = F.col("_block") * _COPIES_PER_BLOCK + 1
    upto = F.least("_copies", first + (_COPIES_PER_BLOCK - 1))
    numbered = one.unionAll(many).withColumn("_copy", F.explode(F.sequence(first, upto)))
    return numbered.select(*df.columns, _row_key(_content(df), F.col("_copy")).alias(name))


def _cut(expected_rows: float, total: int) -> str | None:
    """Digest below which the given number of rows is expected; None past either end."""
    if expected_rows <= 0 or expected_rows >= total:
        return None
    return f"{int(expected_rows / total * _SPACE):032x}"
