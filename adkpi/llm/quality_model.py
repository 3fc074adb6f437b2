"""Quality classifier: boosted trees over figures of a document's text.

One pass over the texts computes ``FEATURES`` per document in Arrow batches and stages them (a
few dozen bytes a row); training and scoring read only those. The trees are fitted on at most
``max_rows`` labelled documents, chosen by a hash of their id, the only bound here; every
document is scored. Id, source, language and labels are never features.

Defined results: NULL or empty text has all figures 0 and is scored like any other. NULL ids
are scored and held out. Labels other than 0 and 1, and labels without a document, are left
out; repeated labels count as repeated rows. Without labels the score is 0.5 everywhere. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.llm.boosting import Trees, fit
from adkpi.llm.shipping import ship
from adkpi.llm.text import buffers, range_hashes, slices, spans, words
from adkpi.session import staged

FEATURES = (
    "log_words word_length long_words symbols marks closing upper digits other_bytes bangs bars "
    "repeat_next distinct_words repeat_trigrams lines_log open_lines repeat_lines line_words"
).split()
CUTOFF = 0.3
FIGURES, SCORE = "__figures", "__score"
MAX_TRAINING_ROWS = 200_000
_FOLDS = 5


def _byte_set(chars: str) -> np.ndarray:
    table = np.zeros(256, np.float64)
    table[list(chars.encode())] = 1
    return table


_SETS = {
    "symbols": _byte_set("#*$%&|<>@^~=+_{}[]\\"),
    "marks": _byte_set(",;:.!?"),
    "closing": _byte_set(".!?"),
    "upper": _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _byte_set("0123456789"),
    "other_bytes": np.repeat([0.0, 1.0], 128),
    "bangs": _byte_set("!"),
    "bars": _byte_set("|"),
}
_NEW_LINE = np.zeros(256, bool)
_NEW_LINE[10] = True


def _repeated(keys: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Per owner, how many items equal an earlier one of the same owner."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    again = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=owners)


def figures(texts: pa.Array) -> np.ndarray:
    """``FEATURES`` of each text, shape (texts, features)."""
    n = len(texts)
    raw, offsets = buffers(texts)
    size = np.maximum(np.diff(offsets), 1)
    start, end, owner = words(raw, offsets)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    length = end - start
    out = {"log_words": np.log1p(count), "word_length": np.bincount(owner, length, n) / some}
    out["long_words"] = np.bincount(owner, length > 15, n) / some
    sums = np.zeros(len(raw) + 1)
    for name, table in _SETS.items():
        np.cumsum(table[raw], out=sums[1:])
        per = size if name in ("upper", "digits", "other_bytes") else some
        out[name] = (sums[offsets[1:]] - sums[offsets[:-1]]) / per
    keys = range_hashes(raw, start, end)
    next_same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    out["repeat_next"] = np.bincount(owner[1:][next_same], minlength=n) / some
    out["distinct_words"] = (count - _repeated(keys, owner, n)) / some
    inside = owner[2:] == owner[:-2]
    three = keys[:-2] * np.uint64(3) + keys[1:-1] * np.uint64(5) + keys[2:] * np.uint64(7)
    out["repeat_trigrams"] = _repeated(three[inside], owner[2:][inside], n) / some
    first, last, of = spans(raw, offsets, _NEW_LINE)
    lines = np.bincount(of, minlength=n)
    at_least = np.maximum(lines, 1)
    out["lines_log"] = np.log1p(lines)
    closed = _SETS["closing"][raw[last - 1]] if len(last) else np.zeros(0)
    out["open_lines"] = (lines - np.bincount(of, closed, n)) / at_least
    out["repeat_lines"] = _repeated(range_hashes(raw, first, last), of, n) / at_least
    out["line_words"] = np.log1p(count / at_least)
    return np.stack([out[name] for name in FEATURES], 1).astype(np.float32)


def with_figures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and an array column ``FIGURES``."""
    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{FIGURES} array<float>"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                values = figures(part.column("__text"))
                step = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
                column = pa.ListArray.from_arrays(pa.array(step), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), column], names=[*keep, FIGURES]
                )

    text = F.col(f"`{text_col}`").cast("string").alias("__text")
    return docs.select(*(F.col(f"`{c}`") for c in keep), text).mapInArrow(measure, fields)


def held_out(doc_id: Column) -> Column:
    """One fold of five by CRC-32 of the id's text; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % _FOLDS == 0, F.lit(True))


def train(
    measured: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, **options
) -> Trees:
    """Trees fitted on labelled rows of the training folds, ``max_rows`` at most."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = usable.select("doc_id", F.col("quality").cast("double").alias("_label"))
    rows = known.join(measured.select("doc_id", FIGURES), "doc_id")
    total = rows.count()
    if total > max_rows:
        # A slice of the hash range that holds a little less than max_rows.
        share = int(max_rows * 0.95 / total * (1 << 31))
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < share)
    # limit() only guards the bound where many rows share an id.
    sample = rows.select("_label", FIGURES).limit(max_rows).toPandas()
    values = np.array(sample[FIGURES].tolist(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort((*values.T, sample["_label"]))  # the same fit in any row order
    return fit(values[order], sample["_label"].to_numpy()[order], **options)


def with_scores(measured: DataFrame, trees: Trees) -> DataFrame:
    """Add ``SCORE`` to frames with ``FIGURES``."""

    @F.pandas_udf("double")
    def score(column):
        values = np.array(column.tolist(), np.float32).reshape(-1, len(FEATURES))
        import pandas as pd

        return pd.Series(trees.scores(values))

    return measured.withColumn(SCORE, score(FIGURES))


def score_documents(
    docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **options
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    measured = staged(with_figures(docs, ["doc_id"]))
    scored = with_scores(measured, train(measured, labels, **options))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= cutoff).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **options
) -> DataFrame:
    """``docs`` without the rows whose score lies below ``cutoff``; same columns."""
    measured = staged(with_figures(docs, ["doc_id"]))
    trees = train(measured, labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good = trees.scores(figures(part.column("text"))) >= cutoff
                yield part.filter(pa.array(good))

    # Scored from the text again, which costs less than carrying whole rows through a shuffle.
    return docs.mapInArrow(keep, docs.schema)


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
