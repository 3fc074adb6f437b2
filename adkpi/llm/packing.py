"""Order-preserving packing of token ids into sequences, by dynamic programming over cuts.

Documents stay in the order of the input. Cuts may fall at the end of a document (free) or of a
sentence inside one (``sentence_cost``); where neither comes for a whole sequence, also every
``FORCED_STEP`` ids (``forced_cost``). A window between two cuts costs its padding, the penalty
of the cut that ends it, and ``SEQUENCE_COST``, so that short sequences are not made for
nothing. With ``f`` the least cost up to a cut at ``b``,

    f[j] = penalty[j] + capacity - b[j] + min(f[i] + b[i]  for  b[j] - b[i] <= capacity)

and the minimum over that sliding range is kept in a monotone queue: every cut enters and leaves
it once. A window of a power of two needs no padding; those few transitions are looked up.

Each task packs its own input partition in parts of some megabytes and carries its last windows
over to the next part, so memory is bounded by one part or one text, whichever is larger. No
shuffle: a hot source or a very long text is only more of the same. Sequence ids hold the
partition's number; the input's rows must come in the same order when a task is run again, as
they do from files (stage a shuffled frame first).

Defined results: NULL or empty text is the end id alone. NULL or repeated ids are packed row by
row. An empty table gives an empty result. Columns other than id and text are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adkpi.llm.shipping import ship
from adkpi.llm.text import slices
from adkpi.llm.tokens import default_vocabulary, encoder, with_end_id

CAPACITY = 2048
END_ID = 1
SENTENCE_COST = 16
FORCED_COST = 64
SEQUENCE_COST = 4
FORCED_STEP = 256
_TAIL_STEP = 64
_SEQUENCE_BITS = 40


def best_cuts(places: list[int], penalty: list[int], capacity: int = CAPACITY) -> list[int]:
    """Indices of the chosen cuts, first and last place included.

    ``places`` rise from 0, neighbours are at most ``capacity`` apart.
    """
    spots = np.asarray(places)
    exact: dict[int, list[int]] = {}
    size = _TAIL_STEP
    while size < capacity:
        at = np.searchsorted(spots, spots - size)
        for j in np.flatnonzero(spots[at] == spots - size).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    count = len(places)
    cost, back, key = [0] * count, [0] * count, [0] * count
    queue: deque[int] = deque([0])
    for j in range(1, count):
        place = places[j]
        low = place - capacity
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + capacity - place
        for other in exact.get(j, ()):
            if cost[other] < best:
                best, i = cost[other], other
        best += penalty[j] + SEQUENCE_COST
        cost[j], back[j] = best, i
        key[j] = reach = best + place
        while queue and key[queue[-1]] >= reach:
            queue.pop()
        queue.append(j)
    chosen = [count - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def candidate_cuts(
    ids: np.ndarray,
    doc_ends: np.ndarray,
    ends_sentence: np.ndarray,
    capacity: int,
    last: bool,
    costs: tuple[int, int],
) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall and their penalties."""
    total = len(ids)
    penalty = np.full(total + 1, -1, np.int64)
    penalty[1:][ends_sentence[ids]] = costs[0]
    penalty[doc_ends] = 0
    penalty[0] = penalty[total] = 0
    places = np.flatnonzero(penalty >= 0)
    for at in np.flatnonzero(np.diff(places) > capacity):
        steps = np.arange(places[at] + FORCED_STEP, places[at + 1], FORCED_STEP)
        penalty[steps] = costs[1]
    if last:
        # The end of the partition can be made of powers of two.
        steps = np.arange(total - _TAIL_STEP, max(0, total - capacity), -_TAIL_STEP)
        penalty[steps] = np.where(penalty[steps] < 0, costs[1], penalty[steps])
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


class _Packer:
    """Ids and document fragments of one partition that are not in a sequence yet."""

    def __init__(self, vocabulary: str, capacity: int, end_id: int, costs: tuple[int, int]):
        self.encoder = encoder(vocabulary)
        self.ends_sentence = np.append(self.encoder.ends_sentence, False)
        self.capacity, self.end_id, self.costs = capacity, end_id, costs
        self.ids = np.zeros(0, np.uint32)
        # Row of the part, ids before the fragment in its document, ids of the document, ids here.
        self.row = self.before = self.whole = self.size = np.zeros(0, np.int64)
        self.doc_ids: pa.Array | None = None
        self.sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS

    def add(self, part: pa.RecordBatch, id_col: str, text_col: str) -> None:
        ids, counts = self.encoder.encode(part.column(text_col))
        ids, counts = with_end_id(ids, counts, self.end_id)
        kept = 0 if self.doc_ids is None else len(self.doc_ids)
        new = part.column(id_col)
        self.doc_ids = pa.concat_arrays([self.doc_ids, new]) if kept else new
        self.ids = np.concatenate((self.ids, ids))
        self.row = np.concatenate((self.row, np.arange(kept, kept + len(counts))))
        self.before = np.concatenate((self.before, np.zeros(len(counts), np.int64)))
        self.whole = np.concatenate((self.whole, counts))
        self.size = np.concatenate((self.size, counts))

    def flush(self, last: bool, schema: pa.Schema) -> pa.RecordBatch | None:
        if not len(self.ids):
            return None
        ends = np.cumsum(self.size)
        sentence = self.ends_sentence
        capped = np.minimum(self.ids, len(sentence) - 1)
        places, penalty = candidate_cuts(
            capped, ends, sentence, self.capacity, last, self.costs
        )
        cuts = places[best_cuts(places.tolist(), penalty.tolist(), self.capacity)]
        if not last:
            cuts = cuts[:-2]  # the last windows wait for what follows
            if len(cuts) < 2:
                return None
        done = int(cuts[-1])
        begins = np.union1d(cuts[:-1], (ends - self.size)[ends - self.size < done])
        stops = np.append(begins[1:], done)
        fragment = np.searchsorted(ends, begins, "right")
        window = np.searchsorted(cuts, begins, "right") - 1
        first = (ends - self.size)[fragment]
        data = self.ids.astype("<u4").tobytes()
        out = pa.RecordBatch.from_arrays(
            [
                self.doc_ids.take(pa.array(self.row[fragment])),
                pa.array(self.before[fragment] + begins - first),
                pa.array(stops - begins),
                pa.array(self.whole[fragment]),
                pa.array(self.sequence + window),
                pa.array(begins - cuts[window]),
                pa.array([data[4 * i : 4 * j] for i, j in zip(begins, stops)], pa.binary()),
            ],
            schema=schema,
        )
        self.sequence += len(cuts) - 1
        left = ends > done
        cut_off = np.maximum(done - (ends - self.size), 0)[left]
        self.before, self.size = self.before[left] + cut_off, self.size[left] - cut_off
        self.whole = self.whole[left]
        self.doc_ids = self.doc_ids.take(pa.array(self.row[left]))
        self.row = np.arange(len(self.size))
        self.ids = self.ids[done:]
        return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    sentence_cost: int = SENTENCE_COST,
    forced_cost: int = FORCED_COST,
) -> DataFrame:
    """One row per piece: id, ``start, length, doc_tokens, sequence_id, offset`` and ``ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers.
    ``vocabulary`` is the tokenizer file's path on the executors.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = "start length doc_tokens sequence_id offset".split()
    fields = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in numbers), "ids binary"])

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(
            vocabulary or default_vocabulary(), capacity, end_id, (sentence_cost, forced_cost)
        )
        schema = None
        for batch in batches:
            names = [id_col, *numbers, "ids"]
            types = [batch.schema.field(id_col).type, *[pa.int64()] * 5, pa.binary()]
            schema = pa.schema(list(zip(names, types)))
            for part in slices(batch, text_col):
                packer.add(part, id_col, text_col)
                out = packer.flush(False, schema)
                if out is not None:
                    yield out
        if schema is not None:
            out = packer.flush(True, schema)
            if out is not None:
                yield out

    chosen = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(text_col))
    return chosen.mapInArrow(pack_partition, fields)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
