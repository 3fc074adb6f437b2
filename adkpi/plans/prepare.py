"""Raw dump to sampled, normalised, split CSV files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from adkpi.functions.scalars import DEFAULT_BASE_DATETIME, RELATIVE_TIMESTAMP_LIMIT, epoch_of
from adkpi.operators.normalise import normalise, timestamp_range
from adkpi.operators.position import (
    BATCH_ROWS,
    INITIAL_ROWS,
    SAMPLE_ROWS,
    with_position,
    with_splits,
)
from adkpi.operators.profile import dataset_profile
from adkpi.operators.sample import fixed_size_sample, with_row_key
from adkpi.session import in_utc
from adkpi.sources.delimited import ROW_ID, read_raw_tsv

# Fixed value: default number of sampled rows.
DEFAULT_SAMPLE = 1_000_000


def prepared_folder(out: str) -> str:
    return f"{out.rstrip('/')}/prepared"


def _inside(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies below it, local paths in any spelling."""
    plain = [p if "://" in p else os.path.abspath(p.removeprefix("file:")) for p in (path, folder)]
    return f"{plain[0].rstrip('/')}/".startswith(f"{plain[1].rstrip('/')}/")


@in_utc
def run(
    spark: SparkSession,
    source: str,
    out: str,
    sample: int | None = DEFAULT_SAMPLE,
    keep_cats: bool = False,
    seed: int = 42,
    base_datetime: str = DEFAULT_BASE_DATETIME,
    preserve_relative: bool = False,
    initial: int = INITIAL_ROWS,
    batches: Sequence[int] = BATCH_ROWS,
    quick: int = SAMPLE_ROWS,
) -> dict[str, Any]:
    """Sample, rebase, sort by time, split by position; write ``out/prepared/split=<name>/``.

    Only the folder ``prepared`` is ever replaced, and a source inside of it is refused.
    ``sample`` None takes all rows. Returns the profile of the sample, the row count of every
    split (``rest`` is what lies past the last batch), and the offset.
    """
    target = prepared_folder(out)
    if _inside(source, target):
        raise ValueError(f"{source} lies in {target}, which would be replaced")
    raw = read_raw_tsv(spark, source)
    seen = timestamp_range(raw).first()
    relative = seen["max_ts"] is not None and seen["max_ts"] < RELATIVE_TIMESTAMP_LIMIT
    offset = epoch_of(base_datetime) if relative and not preserve_relative else 0

    keyed = with_row_key(raw, ROW_ID)
    sampled = fixed_size_sample(keyed, sample, key=ROW_ID, seed=seed, total=seen["row_count"])
    records = normalise(sampled, offset, keep_cats, carry=(ROW_ID,))
    # The row id makes the order total, so copies of one row do not pile up in one task.
    positioned = with_position(records, ["timestamp", ROW_ID])
    splits = with_splits(positioned, initial, batches, quick).drop(ROW_ID, "position")
    splits.write.mode("overwrite").partitionBy("split").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(target)

    counts = splits.groupBy("split").count().collect()
    return {
        "output": target,
        "source_rows": seen["row_count"],
        "offset": offset,
        "splits": {row["split"]: row["count"] for row in counts},
        "profile": dataset_profile(positioned).first().asDict(),
    }
