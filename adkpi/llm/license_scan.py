r"""License scan: MinHash bands over overlapping windows retrieve templates, containment decides.

Built-in functions only. Words are lower-cased and lose punctuation and the signs that open or
frame comment lines, so a notice wrapped in ``#``, ``//``, ``*``, ``--``, ``;``, ``%`` or ``<!--``
reads like plain text. A shingle is five words, a window six: two shingles. Windows begin at
every other word, so each overlaps the next one in four words and every shingle lies in a window.

A window has ``BANDS`` bands of one MinHash value, under an order of the hashes and under its
reverse. A template's windows are its single shingles, so that one shingle in common is enough.
That setting is the cheapest one with a certain collision: of a document window's two shingles
one comes first in an order and the other one in its reverse, so both meet the template's
windows, with probability 1, where two independent orders would lose a shingle with 1/4. (Windows
of ``s`` shingles under ``k`` orders and their reverses post ``2k / s`` values a word and lose a
lone shingle with ``(1 - 2 / s) ** k``: two shingles post one value a word and lose none.)

The band values of all templates are a table (value, template) that the documents' band values
are joined with, broadcast up to ``BROADCAST`` rows and shuffled beyond, so full license texts
fit. The windows that met a template are then compared exactly: a document matches if some
stretch of ``1.25 * m`` (rounded up) consecutive shingles holds at least 80 % of the template's
``m`` distinct shingles. Only shingles that stand in a template are shuffled, by document and
template.

Defined results: a template of fewer than five words (an SPDX line) is one shingle, its whole
sequence, in a window of its own, and is looked for at every word. Templates without a word
match nothing, nor do NULL or empty texts. Repeated templates match under each of their names.
NULL or repeated document ids are scanned row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.session import staged

SHINGLE = 5
WINDOW = 2  # shingles of a document's window
PERCENT = 80
BROADCAST = 300_000
_FIRST_WORDS = 1_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = ".,;:!?()[]\"#*/%<>|=-"  # what frames comments goes like other punctuation
_ORDERS = (0x2545F4914F6CDD1D, ~0x2545F4914F6CDD1D)  # an order of hashes, and its reverse
BANDS = len(_ORDERS)
_GAP = r"[\x20\x09-\x0D]+"

# Short public notices, distinctive passages of public licenses, SPDX lines.
TEMPLATES = {
    "agpl-3.0-notice": "the terms of the GNU Affero General Public License as published by the "
    "Free Software Foundation, either version 3 of the License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at",
    "apache-2.0-text": "Subject to the terms and conditions of this License, each Contributor hereby "
    "grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable "
    "copyright license to reproduce, prepare Derivative Works of",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International "
    "License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
    "International License.",
    "gpl-2.0-notice": "the terms of the GNU General Public License as published by the Free "
    "Software Foundation; either version 2 of the License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License",
    "gpl-text": "When we speak of free software, we are referring to freedom, not price. Our General "
    "Public Licenses are designed to make sure that you have the freedom to distribute copies of "
    "free software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies.",
    "lgpl-2.1-notice": "the terms of the GNU Lesser General Public License as published by the Free "
    "Software Foundation; either version 2.1 of the License",
    "lgpl-3.0-notice": "the terms of the GNU Lesser General Public License as published by the Free "
    "Software Foundation, either version 3 of the License",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
    "this software and associated documentation files, to deal in the software without "
    "restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
    "v. 2.0.",
    "mpl-2.0-text": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive "
    "license under intellectual property rights (other than patent or trademark) Licensable by such "
    "Contributor",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES |= {
    f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}"
    for name in (
        "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
        "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
        "MPL-2.0", "Unlicense", "Zlib",
    )
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def _words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _UPPER.lower())
    return F.filter(F.split(plain, _GAP), lambda w: w != "")


def _hash(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(size)))


def _windows(words: Column, shingles: int) -> Column:
    """Windows of one or two ``shingles``, end to end: where each begins and its hashes."""
    last = F.size(words) - SHINGLE

    def window(i: Column) -> Column:
        second = F.when((i < last) & F.lit(shingles > 1), _hash(words, i + 1, SHINGLE))
        return F.struct(i.alias("i"), _hash(words, i, SHINGLE).alias("a"), second.alias("b"))

    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(shingles)))
    return F.coalesce(F.transform(starts, window), F.array().cast(_WINDOWS))


_WINDOWS = "array<struct<i: int, a: bigint, b: bigint>>"


def _brief(words: Column, size: int, first: list[str] | None = None) -> Column:
    """Windows of one shingle of ``size`` words, of those that begin with one of ``first``."""
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    last = F.size(words) - size
    met = F.filter(at, lambda e: e["i"] <= last)
    if first is not None:
        met = F.filter(at, lambda e: e["w"].isin(first) & (e["i"] <= last))
    none = F.lit(None).cast("bigint")
    return F.transform(
        met,
        lambda e: F.struct(
            e["i"].alias("i"), _hash(words, e["i"], size).alias("a"), none.alias("b")
        ),
    )


def _bands(first: Column, second: Column) -> Column:
    """MinHash value of each band; least() skips a second shingle that is missing."""
    ordered = (F.least(first.bitwiseXOR(o), second.bitwiseXOR(o)) for o in map(F.lit, _ORDERS))
    return F.array(*ordered)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``doc_id, license, containment, first_word`` for every match.

    ``containment`` is the largest share of the template's shingles in one stretch,
    ``first_word`` the number of the word where the first such stretch begins.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    words = F.col("_words")
    cut = templates.select(
        "license", F.monotonically_increasing_id().alias("_t"), _words(F.col("text")).alias("_words")
    )
    every = F.when(F.size(words) >= SHINGLE, _windows(words, 1))
    for size in range(1, SHINGLE):
        # A brief template is one window of one shingle, itself.
        every = every.when(F.size(words) == size, _brief(words, size))
    cut = staged(cut.select("license", "_t", "_words", every.alias("_every")))
    own = cut.select("license", "_t", F.array_distinct("_every.a").alias("_own"))
    own = own.select("license", "_t", F.size("_own").alias("_m"), F.explode("_own").alias("h"))
    none = F.lit(None).cast("bigint")
    index = own.select("*", F.explode(_bands(F.col("h"), none)).alias("band"))
    brief = cut.filter(F.size("_words").between(1, SHINGLE - 1))
    brief = brief.select(F.size("_words").alias("n"), F.get("_words", F.lit(0)).alias("w")).distinct()
    first: dict[int, list[str] | None] = {}
    for r in brief.limit((SHINGLE - 1) * (_FIRST_WORDS + 1)).collect():
        first.setdefault(r["n"], []).append(r["w"])
    if sum(map(len, first.values())) > _FIRST_WORDS:
        first = dict.fromkeys(range(1, SHINGLE))  # too many to name: every word may begin one
    if index.count() <= BROADCAST:
        index = F.broadcast(index)
    cut_docs = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), _words(F.col("text")).alias("_words")
    )
    windows = [_windows(words, WINDOW), *(_brief(words, n, w) for n, w in sorted(first.items()))]
    row = ["doc_id", "_row"]
    placed = cut_docs.select(*row, F.explode(F.concat(*windows)).alias("w"))
    banded = placed.select(*row, "w", F.explode(_bands(F.col("w.a"), F.col("w.b"))).alias("band"))
    retrieved = banded.join(index, "band")
    # Which of a retrieved window's shingles is the template's.
    both = F.array(
        F.struct(F.col("w.i").alias("i"), F.col("w.a").alias("h")),
        F.struct((F.col("w.i") + 1).alias("i"), F.col("w.b").alias("h")),
    )
    met = retrieved.select(
        *row, "_t", "license", "_m", F.explode(F.filter(both, lambda x: x["h"] == F.col("h"))).alias("hit")
    )
    met = met.groupBy("_row", "doc_id", "_t", "license", "_m").agg(
        F.sort_array(F.collect_set("hit")).alias("_hits")
    )
    reach = F.ceil(F.col("_m") * 1.25)
    held = F.transform(
        "_hits",
        lambda e, j: F.struct(
            F.size(
                F.array_distinct(
                    F.transform(
                        F.filter(
                            # No more hits than shingles fit into the stretch.
                            F.slice("_hits", j + 1, reach.cast("int")),
                            lambda x: x["i"] < e["i"] + reach,
                        ),
                        lambda x: x["h"],
                    )
                )
            ).alias("n"),
            (-e["i"]).alias("m"),
        ),
    )
    best = met.select("doc_id", "license", "_m", F.explode(F.array(F.array_max(held))).alias("_best"))
    return best.filter(F.col("_best.n") * 100 >= F.col("_m") * PERCENT).select(
        "doc_id",
        "license",
        (F.col("_best.n") / F.col("_m")).alias("containment"),
        (-F.col("_best.m")).cast("long").alias("first_word"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs)


_SQL_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
    f"'{_UPPER}{_MARKS}', '{_UPPER.lower()}'), '{_GAP}'), lambda w: w <> '')"
)
_SQL_SHINGLES = """
  SELECT {key}, place, words[place + 1:place + n] AS shingle
  FROM (SELECT {key}, words, n, unnest(range(0, len(words) - n + 1)) AS place
    FROM {table} WHERE len(words) >= n)
"""

ORACLE = f"""
WITH templates(license, text) AS (VALUES
  {", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))}),
cut AS (
  SELECT *, least(len(words), {SHINGLE}) AS n
  FROM (SELECT license, {_SQL_WORDS} AS words FROM templates) WHERE len(words) > 0),
owned AS (SELECT DISTINCT license, shingle FROM ({_SQL_SHINGLES.format(key="license", table="cut")})),
sized AS (SELECT license, count(*) AS m FROM owned GROUP BY license),
docs AS (
  SELECT doc_id, words, n FROM (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
    (SELECT DISTINCT n FROM cut)),
grams AS ({_SQL_SHINGLES.format(key="doc_id", table="docs")}),
hits AS (SELECT doc_id, license, place, shingle, m FROM grams JOIN owned USING (shingle)
  JOIN sized USING (license)),
held AS (
  SELECT a.doc_id, a.license, a.place, any_value(a.m) AS m, count(DISTINCT b.shingle) AS n
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.license = b.license
    AND b.place >= a.place AND b.place < a.place + ceil(a.m * 1.25)
  GROUP BY a.doc_id, a.license, a.place),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n DESC, place) AS r FROM held)
SELECT doc_id, license, n / m::DOUBLE AS containment, place::BIGINT AS first_word
FROM best WHERE r = 1 AND 100 * n >= {PERCENT} * m
"""
