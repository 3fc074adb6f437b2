"""Mixing sources to target weights: repetition rates per source, copies per document.

Built-in functions only. The size of every document is counted once and kept in a narrow
table; sums per source are combined before their shuffle, so a source with a third of all rows
sends one partial sum per task. Targets are solved on the table of sources by rounds: share
what is left by weight, hold back sources above ``cap`` times their size, share again. A round
is one aggregate over sources, and only two numbers of it reach the driver.

Each document is taken floor(rate) times, and once more where a hash of seed and document id,
read as a fraction of 1, lies below the rate's fraction. So reruns agree, however rows are
partitioned.

Defined results: NULL text has size 0. A NULL source is a source of its own, the last. NULL or
repeated ids are mixed row by row; equal ids share their hash, so a fraction takes all or
none of them. A source without a word has target 0 and rate 0: its documents are not taken. An
empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.llm.aside import passing_aside
from adkpi.operators.position import with_position
from adkpi.session import staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 17
_SPACES = r"[\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words; NULL text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{_SPACES}|{_SPACES}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPACES))).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0
) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in code-point order, NULL last, weigh ``weights`` in turn.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_position(per_source, [F.col("source").asc_nulls_last()])
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")
    )
    sources = staged(placed.select("source", "source_size", weight.alias("weight")))
    limit = F.col("source_size") * cap
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # Held at their limit: sources whose share at the present level lies above it.
        held = (F.col("weight") * level > limit) if level else F.lit(False)
        row = sources.agg(
            F.sum(F.when(held, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(held, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped = row["n"]
        level = (words * share - row["held"]) / row["weight"]
    target = F.least(F.col("weight") * level, limit).cast("double")
    return sources.select("source", "source_size", target.alias("target"))


def copies_of(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one where the document's hash falls below the rate's fraction."""
    # 13 hexadecimal digits, 52 bits: every value is an exact double in [0, 1).
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    chance = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")




def mixing_plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, rate, copies``."""
    sizes = staged(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    targets = source_targets(sizes, **options).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumn("rate", rate).withColumn(
        "copies", copies_of(F.col("rate"), F.col("doc_id"), seed)
    )


@passing_aside
def mix_sources(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 times: gone)."""
    sizes = docs.select("source", count_words(F.col("text")).alias("size"))
    targets = source_targets(sizes, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("source").alias("__source"), rate.alias("__rate"))
    taken = docs.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    copies = copies_of(F.col("__rate"), F.col("doc_id"), seed).cast("int")
    taken = taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = mixing_plan(docs)
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, {CAP}::DOUBLE * source_size AS most,
    ([{", ".join(map(str, WEIGHTS))}]::DOUBLE[])[
      (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM sums),
ranked AS (
  SELECT *, sum(most) OVER w - most AS held,
    sum(weight) OVER () - (sum(weight) OVER w - weight) AS left_weight,
    sum(source_size) OVER () AS words
  FROM weighed WINDOW w AS (ORDER BY most / weight, source ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (words - held) / left_weight AS at_level,
    (words - held) / left_weight * weight <= most AS fits
  FROM ranked),
level AS (SELECT coalesce(max(at_level) FILTER (fits), 0) AS level FROM levels),
targets AS (
  SELECT source, source_size, least(weight * level, most)::DOUBLE AS target FROM weighed, level),
rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || md5('{SEED}:' || d.doc_id)[1:13])::BIGINT::DOUBLE / {float(1 << 52)} AS chance
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, floor(rate)::BIGINT + (chance < rate - floor(rate))::BIGINT AS copies FROM rates)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""
