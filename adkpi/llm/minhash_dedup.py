"""Near duplicates of documents: an inverted join over bands of MinHash signatures.

A document's set holds its distinct shingles of ``SHINGLE`` words. Documents with equal sets are
one class from the start. Every class is posted under the bands of its signature: ``COORDINATES``
values, ``MATCHES`` of them a band. Classes that agree in a whole band are candidates; a pair right
at 0.85 agrees in none of the 20 bands with a chance of 3.9 in ten million, at 0.8 of 2.6 in
100,000. Single values would make one huge list of candidates out of documents that
share a little.

Candidates are confirmed on their full sets by ``links``, where a small family of them meets in one
place and a large one goes by blocks and leaders, so a group of very many near copies never becomes
all its pairs.

Words are runs of bytes that are no ASCII white space, A-Z lower-cased; shingles are compared
by 64-bit hashes.

Defined results: a document without words (NULL or empty text) has an empty set and is linked
with nothing. One with fewer words than a shingle has its whole sequence as the one element.
Rows with a NULL id are linked with nothing, have a NULL component and are kept. Rows that
repeat an id with another text are compared by their own texts; in ``op5_minhash_dedup`` such an
id gets the smallest component and the largest set size among them, and is kept if a row of it
is. Other columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adkpi.llm.aside import passing_aside
from adkpi.llm.components import components
from adkpi.llm.links import linked_pairs
from adkpi.llm.shipping import ship
from adkpi.llm.text import buffers, lower_ascii, mix, range_hashes, shingles, slices, words
from adkpi.session import frames_dropped, staged

SHINGLE = 5
PERCENT = 85
COORDINATES = 80
MATCHES = 4
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def distinct_grams(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, end to end, and the number of each text's."""
    raw, offsets = buffers(texts)
    raw = lower_ascii(raw)
    start, end, owner = words(raw, offsets)
    grams, owner = shingles(range_hashes(raw, start, end), owner, len(texts), size)
    grams = grams ^ np.uint64(1 << 63)  # order of signed integers, as Spark sorts
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[first], minlength=len(texts))
    return (grams[first] ^ np.uint64(1 << 63)), counts


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, shape (sets that are not empty, coordinates)."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), COORDINATES), np.uint32)
    if len(starts):
        for k, seed in enumerate(_SEEDS):
            values = ((grams ^ (seed >> np.uint64(7))) * seed >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(values, starts)
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """Per row of ``id, key, text`` with a word: ``id, key, n, f1, f2, sig`` of its set."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, counts = distinct_grams(part.column("text"), size)
                full = pa.array(np.flatnonzero(counts > 0))
                sig = signatures(grams, counts)
                step = np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(full),
                        part.column("key").take(full),
                        pa.array(counts[counts > 0]),
                        pa.array(_sums(mix(grams), counts).view(np.int64)),
                        pa.array(_sums(mix(grams ^ _SEEDS[0]), counts).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(step), pa.array(sig.view(np.int32).ravel())
                        ),
                    ],
                    names=["id", "key", "n", "f1", "f2", "sig"],
                )

    return docs.mapInArrow(measure, "id long, key long, n long, f1 long, f2 long, sig array<int>")


def candidate_lists(signed: DataFrame, matches: int) -> DataFrame:
    """``key, id`` of classes ``id, sig``: one row for every band of ``matches`` values."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(COORDINATES // matches - 1)),
        lambda k: F.xxhash64(k, F.slice("sig", k * matches + 1, matches)),
    )
    return signed.select(F.explode(bands).alias("key"), "id")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES, size: int = SHINGLE
) -> DataFrame:
    """``id, key, n_shingles, component`` for rows with an id and a word.

    ``key`` is the hash of the row's text; component is the least id. Documents that agree in
    ``matches`` neighbouring values of their signatures are compared.
    """
    own = docs.filter(F.col("doc_id").isNotNull())
    own = own.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("key"),
        F.col("text").cast("string"),
    )
    with frames_dropped(docs.sparkSession):
        signed = staged(_scan(own, size))
        kind = ["n", "f1", "f2"]
        # Several classes can have one least id, if it stands for several texts: they are numbered.
        classes = staged(
            signed.groupBy(*kind)
            .agg(F.min(F.struct("id", "key", "sig")).alias("_least"))
            .select(
                *kind,
                F.monotonically_increasing_id().alias("id"),
                F.col("_least.id").alias("doc"),
                "_least.key",
                "_least.sig",
            )
        )
        postings = candidate_lists(classes.select("id", "sig"), matches)

        def texts_of(ids: DataFrame) -> DataFrame:
            wanted = classes.select("id", "n", "doc", "key").join(ids, "id", "left_semi")
            texts = own.select(F.col("id").alias("doc"), "key", "text").join(wanted, ["doc", "key"])
            # Rows that repeat both id and text give a class's text again.
            return texts.dropDuplicates(["id"]).select("id", "n", "text")

        def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return distinct_grams(texts, size)

        known = staged(components(linked_pairs(postings, texts_of, elements, percent, unique=True)))
        # A component is named by its least document id.
        named = known.join(classes.select("id", "doc"), "id")
        least = named.groupBy("component").agg(F.min("doc").alias("_least"))
        known = known.join(least, "component").select("id", "_least")
        known = classes.select("id", "doc", *kind).join(known, "id", "left")
        known = known.select(*kind, F.coalesce("_least", "doc").alias("component"))
        joined = signed.select("id", "key", *kind).join(known, kind)
        found = joined.select("id", "key", F.col("n").alias("n_shingles"), "component")
        return staged(found, lasting=True)


@passing_aside
def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; same columns."""
    gone = near_duplicates(docs, **options).filter("component <> id")
    gone = gone.select(F.col("id").alias("__gone"), F.col("key").alias("__key")).distinct()
    same = (F.col("doc_id") == F.col("__gone")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(gone, same, "left_anti")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs).groupBy(F.col("id").alias("doc_id"))
    found = found.agg(
        F.max("n_shingles").alias("n_shingles"),
        F.min("component").alias("component"),
        F.max(F.col("component") == F.col("id")).alias("_kept"),
    )
    every = docs.select("doc_id").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return every.select(
        "doc_id",
        F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce("_kept", F.lit(True)).alias("kept"),
    )
