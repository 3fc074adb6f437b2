"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are equal when they are the same after replacing each run of white space by one space.
Every input partition makes a run: its distinct digests in order, each with the smallest
identifier that carries it and the number of rows. Runs are then merged in binomial rounds of
``fan_in`` partners. A run's number is read as digits in base ``fan_in``; in round ``r`` the
partners are the runs that differ in digit ``r`` alone, and each of them takes the part of the
others' runs whose digest has its own digit there. So every round halves (for ``fan_in`` 2) the
range of digests a slot is responsible for while it doubles the partitions that went into it,
and the last round leaves one entry per text. In each round a digest meets at most ``fan_in``
entries of itself in a slot, so a text that a third of all rows share loads no task, and no run
ever holds more than its share of the digests.

Runs are in order of a 64-bit hash; entries merge only where the whole SHA-256 and the length
agree as well, so the smallest identifier that is kept has been verified on every level. The
results go back to the rows by (run, digest): a text is held once per run there, too.

Defined results: NULL text counts as empty. Rows without an id come after all rows with one.
Of rows that repeat text and id one stays, the first in the input's order. Empty tables give no
rows. Columns other than the two named ones play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adkpi.session import staged

SPACES = r"[\x20\x09-\x0D]+"
FAN_IN = 8

_TEXT = ("order", "digest", "bytes")


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digested(docs: DataFrame, text: Column, doc_id: Column, *carry: Column) -> DataFrame:
    """One row per document: run (input partition), row number, id, and the text's digests."""
    numbered = docs.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        doc_id.alias("id"),
        normalised(text).alias("body"),
        *carry,
    )
    return numbered.withColumns(
        {
            "order": F.xxhash64("body"),
            "digest": F.unhex(F.sha2("body", 256)),
            "bytes": F.octet_length("body"),
        }
    ).drop("body")


def local_runs(rows: DataFrame) -> DataFrame:
    """Each run's distinct texts, with their smallest row; combined before the shuffle."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    return rows.groupBy("run", *_TEXT).agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")
    )


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per text, out of all runs, by rounds of ``fan_in`` partners."""
    if fan_in < 2:
        raise ValueError("a merge needs two partners at least")
    merged, width = runs, 1
    while width < n_runs:
        own = F.floor(F.col("run") / width) % fan_in
        aim = F.floor(F.pmod("order", F.lit(fan_in * width)) / width)
        sent = merged.withColumn("run", F.col("run") + (aim - own) * width)
        # The exchange is by slot alone; sorted runs of one slot are merged where they meet.
        met = sent.repartition("run").sortWithinPartitions("run", *_TEXT)
        merged = met.groupBy("run", *_TEXT).agg(
            F.min("first").alias("first"), F.sum("rows").alias("rows")
        )
        width *= fan_in
    return merged


def _resolved(rows: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """``rows`` with the row that stays and the size of the group."""
    runs = staged(local_runs(rows))
    found = tree_merge(runs, n_runs, fan_in).select(
        *_TEXT,
        F.col("first.id").alias("keep_id"),
        F.col("first.row").alias("keep_row"),
        F.col("rows").alias("group_size"),
    )
    # A text stands at most once in a run, so neither join has a hot key.
    per_run = runs.select("run", *_TEXT).join(found, list(_TEXT))
    return rows.join(per_run, ["run", *_TEXT])


def _staged_runs(rows: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = staged(rows.observe(seen, F.max("run").alias("last")))
    return out, (seen.get["last"] or 0) + 1


def exact_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in: int = FAN_IN
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``."""
    rows, n_runs = _staged_runs(digested(docs, F.col(f"`{text}`"), F.col(f"`{doc_id}`")))
    return _resolved(rows, n_runs, fan_in).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in: int = FAN_IN
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. The table is staged once with its digests."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows, n_runs = _staged_runs(digested(docs, F.col(f"`{text}`"), F.col(f"`{doc_id}`"), whole))
    narrow = _resolved(rows.drop("doc"), n_runs, fan_in)
    stays = narrow.filter(F.col("row") == F.col("keep_row")).select("row")
    return rows.join(stays, "row").select("doc.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept,
  sha256(body) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY body)
"""
