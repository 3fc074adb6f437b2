"""Spelling variants: words one edit apart, by permuterm rotations.

A word is marked with a terminator and written in all its rotations. A rotation that begins
behind the edited character ends with it: ``cat$`` turned to ``t$ca`` ends with the ``a`` of
the middle. All words that differ in that one character share the rest of it, ``t$c``, and so
does, as its whole rotation, the word that lacks the character (``ct$``). So replacements and
indels become one prefix range of the sorted rotations, which skips the edited character.

Every word is posted under each rotation without its last character (a *skip*, one for every
character) and under each whole rotation (one for every place where a character may be missing).
Postings are sorted by prefix; equal prefixes stand together, and one scan over each sorted
partition emits for every word of a group how many neighbours it has there and the best of them.
A group holds one word per character of the alphabet at most, plus the word without it, whatever
the size of the vocabulary; and its scan is linear: the best two stand for all others, so pairs
are never written. A missing character in a row of equal ones is counted at its first place
only, so every pair of neighbours is met once.

Words are counted before they are posted; occurrences of a hot word are combined within each
task. Chains of forms are short, as each step has ten times the occurrences of the one before;
they are followed from their ends, so a join never meets more rows of one word than it has
neighbours.

Defined results: NULL or empty text has no words; a row without id counts as one with an empty
id; repeated rows count each time. Ties between forms go to the smaller word in code-point
order. Empty tables give no rows. Extra columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.llm import sql
from adkpi.llm.shipping import ship
from adkpi.session import staged

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
SLIP_EVERY = 31
LETTERS = "A-Za-zÀ-ÿ"
TERMINATOR = "$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def runs_of_letters(text: Column, least: int = 1) -> Column:
    """Array of the maximal runs of letters that have at least ``least`` of them."""
    # A match begins where a run begins and takes all of it, so shorter runs match nowhere.
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def with_slips(doc_id: Column, run: Column) -> Column:
    """``run`` without one character, where its hash with the document says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    slipped = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIP_EVERY == 0, slipped).otherwise(run)


def count_words(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    long_enough = words.filter(F.length("word") >= least_length)
    counts = long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def postings(words: DataFrame) -> DataFrame:
    """``prefix, word, n, kind`` for all rotations of the terminator-marked words.

    Kind 0: the whole rotation. Kind 1: the rotation without its last character; kind 2: the
    same, where that character is the first of a row of equal ones.
    """
    marked = F.concat("word", F.lit(TERMINATOR))
    size = F.length("word")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    whole = F.concat(F.substring(marked, F.col("at") + 1, size + 1), F.substring("word", F.lit(1), F.col("at")))
    turned = turned.withColumn("whole", whole)
    # The rotation from ``at`` ends with the character before it; from 0, with the terminator.
    here = F.substring("word", F.col("at"), F.lit(1))
    before = F.when(F.col("at") > 1, F.substring("word", F.col("at") - 1, F.lit(1)))
    first = before.isNull() | (before != here)
    skip = F.struct(
        F.substring("whole", F.lit(1), size).alias("prefix"),
        F.when(first, 2).otherwise(1).alias("kind"),
    )
    kept = F.struct(F.col("whole").alias("prefix"), F.lit(0).alias("kind"))
    both = F.when(F.col("at") == 0, F.array(kept)).otherwise(F.array(kept, skip))
    return turned.select("word", "n", F.explode(both).alias("p")).select("p.*", "word", "n")


_FOUND = pa.schema(
    [("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]
)


def _best_other(group: np.ndarray, n: np.ndarray, rank: np.ndarray, use: np.ndarray) -> tuple:
    """Per group the best and second best row among ``use``, -1 where there is none.

    Best: the largest n, then the smallest rank. ``group`` ascends from 0 without gaps.
    """
    groups = int(group[-1]) + 1
    best, second = np.full(groups, -1), np.full(groups, -1)
    rows = np.flatnonzero(use)
    rows = rows[np.lexsort((rank[rows], -n[rows], group[rows]))]
    of = group[rows]
    first = np.ones(len(rows), bool)
    first[1:] = of[1:] != of[:-1]
    best[of[first]] = rows[first]
    next_of = np.zeros(len(rows), bool)
    next_of[1:] = first[:-1] & ~first[1:]
    second[of[next_of]] = rows[next_of]
    return best, second


def _scan(rows: pa.Table) -> pa.RecordBatch | None:
    """Neighbours within every group of equal prefixes; ``rows`` hold whole groups, in order."""
    prefix = rows.column("prefix").combine_chunks()
    if len(prefix) < 2:
        return None
    same = np.asarray(pc.equal(prefix[1:], prefix[:-1]))
    shared = np.zeros(len(prefix), bool)
    shared[1:] |= same
    shared[:-1] |= same
    if not shared.any():
        return None
    start = np.ones(len(prefix), bool)
    start[1:] = ~same
    at = np.flatnonzero(shared)
    group = np.cumsum(start[at]) - 1
    some = rows.take(at)
    n = some.column("n").to_numpy()
    kind = some.column("kind").to_numpy()
    words = some.column("word").combine_chunks()
    # Code-point order of the words as numbers; UTF-8 bytes sort alike.
    order = np.asarray(pc.sort_indices(words))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    skips, firsts, whole = kind > 0, kind == 2, kind == 0
    groups = int(group[-1]) + 1
    n_skips = np.bincount(group[skips], minlength=groups)
    n_firsts = np.bincount(group[firsts], minlength=groups)
    alone = np.full(groups, -1)  # the word without the character, where there is one
    alone[group[whole]] = np.flatnonzero(whole)
    best, second = _best_other(group, n, rank, skips)
    best_first, _ = _best_other(group, n, rank, firsts)

    me = np.arange(len(at))
    rival = np.where(best[group] == me, second[group], best[group])
    rival = np.where(whole, best_first[group], rival)
    lacking = np.where(firsts, alone[group], -1)
    better = (lacking >= 0) & (
        (rival < 0)
        | (n[lacking] > n[rival])
        | ((n[lacking] == n[rival]) & (rank[lacking] < rank[rival]))
    )
    rival = np.where(better, lacking, rival)
    near = np.where(whole, n_firsts[group], n_skips[group] - 1 + (lacking >= 0))
    out = np.flatnonzero(near > 0)
    if not len(out):
        return None
    return pa.record_batch(
        [
            words.take(pa.array(out)),
            pa.array(near[out], pa.int64()),
            words.take(pa.array(rival[out])),
            pa.array(n[rival[out]], pa.int64()),
        ],
        schema=_FOUND,
    )


def scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one sorted partition; a group that a batch leaves open waits for the next."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        prefix = rows.column("prefix")
        other = np.flatnonzero(~np.asarray(pc.equal(prefix, prefix[len(rows) - 1])))
        cut = int(other[-1]) + 1 if len(other) else 0
        found = _scan(rows.slice(0, cut)) if cut else None
        if found is not None:
            yield found
        held = rows.slice(cut)
    found = _scan(held) if held is not None else None
    if found is not None:
        yield found


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words (``word, n``) that have a neighbour."""
    ship(words.sparkSession)
    spark = words.sparkSession
    posted = postings(words)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = posted.repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
    found = ordered.mapInArrow(scan_sorted, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n")
    )


def with_forms(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n``: the form is the best neighbour, if frequent enough."""
    joined = words.join(neighbours(words), "word", "left")
    wins = F.col("best_n") >= factor * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(wins, F.col("best")).alias("form"),
        F.when(wins, F.col("best_n")).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: the end of the chain of forms, the word itself where it has none.

    Round by round, words whose form's root is known get it. A chain has as many steps as its
    counts have powers of the factor, and a round joins a form with its direct variants only.
    """
    ends = forms.filter(F.col("form").isNull()).select("word", F.col("word").alias("root"))
    known, left = ends, staged(forms.filter(F.col("form").isNotNull()).select("word", "form"))
    # Ends that nothing leads to are done; of the others the roots are handed down.
    reached = known.join(left.select(F.col("form").alias("word")).distinct(), "word", "left_semi")
    rounds = []
    while not left.isEmpty():
        step = reached.select(F.col("word").alias("form"), "root")
        joined = staged(left.join(step, "form", "left"))
        reached = joined.filter(F.col("root").isNotNull()).select("word", "root")
        left = joined.filter(F.col("root").isNull()).select("word", "form")
        rounds.append(reached)
    found = ends
    for part in rounds:
        found = found.unionByName(part)
    return forms.join(found, "word")


def variants(
    words: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FORM_FACTOR,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of occurrences ``word``, one row each.

    Words must not hold the terminator. Forms must gain occurrences, or chains had no end.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent as its variant")
    counted = staged(count_words(words, least_length, least_count))
    return with_roots(staged(with_forms(counted, factor)))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # A slip only shortens, so shorter runs cannot become words.
    runs = docs.select("doc_id", F.explode(runs_of_letters(F.col("text"), LEAST_LENGTH)).alias("run"))
    lowered = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = lowered.select(with_slips(F.col("doc_id"), F.col("run")).alias("word"))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE {sql.CRC_TABLE.strip()},
runs AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
    FROM documents)),
numbered AS (
  SELECT doc_id, run, count(*) AS times,
    {sql.crc32("coalesce(any_value(doc_id)::VARCHAR, '') || ':' || run")} AS h
  FROM runs, crc_table GROUP BY doc_id, run, entries),
spelt AS (
  SELECT times, CASE WHEN h % {SLIP_EVERY} = 0
    THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
    ELSE run END AS word
  FROM numbered),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH}
  GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
without AS (
  SELECT word, n, spot, left(word, spot - 1) || substr(word, spot + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS spot FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a
  JOIN without b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
    CASE WHEN r.other_n >= {FORM_FACTOR} * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= {FORM_FACTOR} * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chains AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""
