"""Line-first cleaning: rules per line, failing lines go, then documents that lost too much.

Built-in functions only, and no shuffle: every figure of a document is computed from array
functions inside its own row, so a hot source or a huge group of copies costs nothing extra.

A line without a word is neither kept nor lost (it stays in the text, it counts nothing). A
line with words fails when

* ``punctuation``: it does not end in closing punctuation, or it carries, besides one closing
  mark, more than ``MARKS_PER_WORD`` punctuation marks or more than ``SYMBOLS_PER_WORD`` symbols per word;
* ``navigation``: it is a list of links: separators stand between at least a quarter of its words;
* ``boilerplate``: it holds one of the fixed phrases and at most ``BOILERPLATE_WORDS`` words.

Defined results: NULL or empty text has no words, fails the base check and is not kept; the
cleaned text of NULL is NULL. Repeated rows are judged one by one. Other columns pass through;
columns of the input that carry the name of an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adkpi.llm.aside import passing_aside

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MARKS_PER_WORD = 0.6
SYMBOLS_PER_WORD = 0.1
BOILERPLATE_WORDS = 30
MAX_LOST_PERCENT = 50

# The same text in Java's and in RE2's syntax.
CLOSED = r"""[.!?:;…]["'”’»)\]]*[\x20\x09-\x0D]*$"""
MARKS = "!?,.;:"
SEPARATORS = "|>»•·"
BOILERPLATE = (
    "(?i)(all rights reserved|cookie policy|accept cookies|privacy policy|terms of (use|service)|"
    "enable javascript|click here|sign up now|subscribe to our|share this (page|article|post)|"
    "back to top|skip to (main )?content|follow us on)"
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def line_verdicts(line: Column) -> dict[str, Column]:
    """Rule name -> whether the line fails it; meant for lines that hold a word."""
    words = _count_words(line)
    return {
        "punctuation": ~line.rlike(CLOSED)
        | (_count_chars(line, MARKS) - 1 > MARKS_PER_WORD * words)
        | (_count_chars(line, SYMBOLS) > SYMBOLS_PER_WORD * words),
        "navigation": (_count_chars(line, SEPARATORS) * 4 >= words)
        & (_count_chars(line, SEPARATORS) >= 2),
        "boilerplate": line.rlike(BOILERPLATE) & (words <= BOILERPLATE_WORDS),
    }


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Words covered by 5-word windows that occur twice or more, from ``_words``.

    Windows are compared by a 64-bit hash inside one document. Sorting happens only in
    documents that repeat a window at all.
    """
    words, grams, ranked, at = (F.col(c) for c in ("__words", "__grams", "__ranked", "__at"))
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    window = F.transform(
        starts,
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))),
    )
    docs = docs.withColumn("__grams", window)
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn(
        "__ranked", F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs)
    )
    same = F.filter(
        ranked,
        lambda e, j: F.coalesce(
            F.when(j > 0, F.get(ranked, j - 1)["g"] == e["g"]), F.lit(False)
        )
        | F.coalesce(F.get(ranked, j + 1)["g"] == e["g"], F.lit(False)),
    )
    docs = docs.withColumn("__at", F.sort_array(F.transform(same, lambda e: e["i"])))
    # least() skips the NULL after the last place.
    covered = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.get(at, j + 1) - p))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


@passing_aside
def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts, verdicts and ``clean_text`` to every row of ``docs``."""
    value = F.coalesce(F.col(text), F.lit(""))
    added = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_bad_lines n_lost_words "
        "base_failed kept clean_text"
    ).split()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    df = docs.select(
        *rest,
        F.regexp_extract_all(value, F.lit(WORD), F.lit(0)).alias("__words"),
        F.split(value, "\n").alias("__lines"),
    )
    df = _repeat_words(df)
    lines, bad = F.col("__lines"), F.col("__bad")
    with_word = F.filter(lines, lambda x: F.length(_without(x, SPACES)) > 0)
    df = df.withColumn("__worded", with_word)

    def fails(line):
        first, *others = line_verdicts(line).values()
        for rule in others:
            first = first | rule
        return first

    df = df.withColumn("__bad", F.filter(F.col("__worded"), fails))
    lost = F.aggregate(
        F.transform(bad, _count_words), F.lit(0).cast("long"), lambda s, x: s + x
    )
    df = df.withColumn("n_lost_words", lost)
    n_words = F.size("__words").cast("long")
    base_failed = (n_words < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > n_words * MAX_REPEAT_PERCENT
    )
    too_much = F.col("n_lost_words") * 100 > n_words * MAX_LOST_PERCENT
    stays = F.filter(
        lines, lambda x: (F.length(_without(x, SPACES)) == 0) | ~F.array_contains(bad, x)
    )
    clean = F.when(F.size(bad) == 0, F.col(f"`{text}`")).otherwise(F.array_join(stays, "\n"))
    return df.select(
        *rest,
        n_words.alias("n_words"),
        F.length(_without(value, SPACES)).cast("long").alias("word_chars"),
        _count_chars(value, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(bad).cast("long").alias("n_bad_lines"),
        "n_lost_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~too_much).alias("kept"),
        clean.alias("clean_text"),
    )


DIGEST = (
    "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
    "n_bad_lines n_lost_words"
).split()


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(*DIGEST)


def _sql_count(expr: str, chars: str) -> str:
    return f"length({expr}) - length(translate({expr}, '{chars}', ''))"


_SQL_WORDS = f"regexp_extract_all({{}}, '{WORD}')"
_CLOSED_SQL = CLOSED.replace("'", "''")

ORACLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS value, {_SQL_WORDS.format("coalesce(text, '')")} AS words
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS place, words FROM docs WHERE len(words) >= 5),
named AS (SELECT doc_id, place, words[place:place + 4] AS gram FROM grams),
counted AS (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM named),
gaps AS (
  SELECT doc_id, least(5, coalesce(
    lead(place) OVER (PARTITION BY doc_id ORDER BY place) - place, 5)) AS w
  FROM counted WHERE n > 1),
repeats AS (SELECT doc_id, sum(w)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
worded AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(value, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}')),
judged AS (
  SELECT doc_id, line, len({_SQL_WORDS.format("line")}) AS words,
    {_sql_count("line", MARKS)} AS marks, {_sql_count("line", SYMBOLS)} AS symbols,
    {_sql_count("line", SEPARATORS)} AS separators
  FROM worded),
failed AS (
  SELECT *, NOT regexp_matches(line, '{_CLOSED_SQL}') OR marks - 1 > {MARKS_PER_WORD}::DOUBLE * words
    OR symbols > {SYMBOLS_PER_WORD}::DOUBLE * words OR (separators * 4 >= words AND separators >= 2)
    OR (regexp_matches(line, '{BOILERPLATE}') AND words <= {BOILERPLATE_WORDS}) AS bad
  FROM judged),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(words) FILTER (bad), 0)::BIGINT AS n_lost_words
  FROM failed GROUP BY doc_id),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(value, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    ({_sql_count("value", SYMBOLS)})::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines,
    coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
    AS base_failed FROM figures)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM based
"""
