"""Token, text and line operators on odd documents, against plain Python."""

import os
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, connect
from fixtures_llm import SCHEMA, WORD, as_counter, documents, frame, groups, prose
from pyspark.sql import functions as F

from adkpi.llm import license_scan, line_dedup, packing, quality_rules, source_mix, token_codec
from adkpi.llm.minhash_dedup import deduplicate
from adkpi.llm.queries import ORACLE, QUERIES
from adkpi.llm.text import buffers, order_of, span_hashes
from adkpi.llm.tokens import default_vocabulary, encoder
from adkpi.session import checkpoint_dir

SF_DIR = "/root/testdata/sf0.001"


def expected_ids(text, end_id):
    tool = encoder(default_vocabulary()).whole
    return [*tool.encode(text or "", add_special_tokens=False).ids, end_id]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name])


def test_encoder_equals_the_library():
    texts = [r[1] for r in documents()]
    texts += ["'", "''s 'super we'LL x'", "'re", "12 34'd", "a\x1cb\x0bc", "İstanbul ΣΑΣ", "x\xa0y"]
    ids, counts = encoder(default_vocabulary()).encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [expected_ids(t, 0)[:-1] for t in texts]


def test_a_text_of_very_many_pieces():
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(1_100_000)]
    tool = encoder(default_vocabulary())
    ids, counts = tool.encode(pa.array([" ".join(words), "one two"]))
    parts = [" ".join(words[k : k + 50_000]) for k in range(0, len(words), 50_000)]
    near, sizes = tool.encode(pa.array(parts))
    assert counts[0] == sizes.sum() and counts[1] == 2
    assert (ids[: counts[0]] == near).all()


def test_quality_rules(spark):
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark)).collect()}
    assert (rows[4]["n_words"], rows[4]["base_failed"], rows[4]["kept"]) == (0, True, False)
    assert rows[4]["clean_text"] is None and rows[5]["clean_text"] == ""
    assert rows[9]["n_bad_lines"] == 1 and rows[9]["kept"]
    assert "Menu" not in rows[9]["clean_text"] and "ok." in rows[9]["clean_text"]
    assert rows[10]["n_repeat_words"] == rows[10]["n_words"] and not rows[10]["kept"]
    assert not rows[16]["kept"] and rows[13]["kept"]
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    clash = frame(spark).withColumnRenamed("source", "kept")
    assert quality_rules.apply_rules(clash).count() == len(documents())


HELPERS = (
    "__words __lines __bad __worded __at __rate __source __copy __gone __key __id __removed __left "
    "__text __figures __score __n passing_0"
).split()


@pytest.mark.parametrize(
    "operator",
    [quality_rules.apply_rules, source_mix.mix_sources, deduplicate, line_dedup.deduplicate_lines],
    ids=lambda f: f.__name__,
)
def test_names_of_helper_columns_pass(spark, operator):
    docs = frame(spark, [r for r in documents() if r[0] is not None][:9])
    clash = docs.select("*", *(F.lit(name).alias(name) for name in HELPERS))
    rows = operator(clash).collect()
    assert rows and all(r[name] == name for r in rows for name in HELPERS)
    assert len(rows) == operator(docs).count()


def test_source_mix(spark):
    docs = frame(spark)
    plan = source_mix.mixing_plan(docs).collect()
    sizes = {s: 0 for s in {r[3] for r in documents()}}
    for r in documents():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = {r["source"]: r["target"] for r in plan}
    assert {r["source"]: r["source_size"] for r in plan} == sizes
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert all(0 <= r["copies"] <= 3 for r in plan)
    mixed = source_mix.mix_sources(docs)
    assert mixed.columns == docs.columns
    wanted = {}
    for r in plan:
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + r["copies"]
    taken = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {i: n for i, n in wanted.items() if n}
    assert source_mix.mixing_plan(frame(spark, [])).count() == 0
    blank = [(1, None, "en", "a", 0), (2, " ", "en", None, 0)]
    assert source_mix.mix_sources(frame(spark, blank)).count() == 0


@pytest.mark.parametrize("count", [0, 1, 2047, 2048, 2049, 5000])
def test_codec_round_trip(count):
    ids = np.random.default_rng(count).integers(0, 1 << 16, count).astype(np.uint32)
    segment = token_codec.encode_ids(ids)
    assert token_codec.decode_ids(segment).tolist() == ids.tolist()


def test_codec_blocks_are_independent_and_checked():
    ids = np.arange(6000, dtype=np.uint32) % 300
    segment = bytearray(token_codec.encode_ids(ids))
    assert len(segment) < 2 * len(ids)
    assert token_codec.decode_ids(bytes(segment), range(1, 2)).tolist() == ids[2048:4096].tolist()
    first_words = 8 + 12 * 3
    segment[first_words + 20] ^= 255
    with pytest.raises(ValueError, match="block 0"):
        token_codec.decode_ids(bytes(segment))
    assert token_codec.decode_ids(bytes(segment), range(2, 3)).tolist() == ids[4096:].tolist()


def test_codec_corpus(spark, tmp_path):
    token_codec.write_corpus(frame(spark).repartition(3), str(tmp_path / "c"))
    rows = token_codec.read_corpus(spark, str(tmp_path / "c")).orderBy("start").collect()
    # None first, then ascending ids.
    assert [r["doc_id"] for r in rows] == sorted(
        (r[0] for r in documents()), key=lambda i: (i is not None, i)
    )
    texts = {r[0]: r[1] for r in documents()}
    place = 0
    for r in rows:
        want = expected_ids(texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"]) == (place, len(want))
        assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want)
        place += len(want)
    token_codec.write_corpus(frame(spark, []), str(tmp_path / "e"))
    assert token_codec.read_corpus(spark, str(tmp_path / "e")).count() == 0


def test_packing(spark):
    rows = packing.pack(frame(spark).repartition(2)).collect()
    pieces = {}
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert windows.get(r["sequence_id"], 0) == r["offset"]
        windows[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert max(windows.values()) <= 2048
    got = as_counter(
        (i, r["start"], zlib.crc32(bytes(r["ids"]))) for (i, _), p in pieces.items() for r in p
    )
    assert sum(got.values()) == len(rows)
    for row in documents():
        want = expected_ids(row[1], 1)
        mine = [r for r in rows if r["doc_id"] == row[0]]
        assert {r["doc_tokens"] for r in mine} == {len(want)}
        copies = sum(d[0] == row[0] for d in documents())
        assert sum(r["length"] for r in mine) == copies * len(want)
        for r in mine:
            part = want[r["start"] : r["start"] + r["length"]]
            assert bytes(r["ids"]) == struct.pack(f"<{len(part)}I", *part)
    assert packing.pack(frame(spark, [])).count() == 0


def test_best_cuts_equals_trying_everything():
    rng = np.random.default_rng(4)
    for _ in range(30):
        steps = rng.integers(1, 60, 12)
        places = [0, *np.cumsum(steps).tolist()]
        penalty = [0, *rng.integers(0, 30, 12).tolist()]
        least = [0] + [None] * 12
        for j in range(1, 13):
            options = []
            for i in range(j):
                size = places[j] - places[i]
                if size <= 128:
                    # Exact powers of two from 64 on need no padding.
                    pad = 0 if size in (64, 128) else 128 - size
                    options.append(least[i] + pad + penalty[j] + packing.SEQUENCE_COST)
            least[j] = min(options)
        cuts = packing.best_cuts(places, penalty, 128)
        cost = 0
        for i, j in zip(cuts, cuts[1:]):
            size = places[j] - places[i]
            pad = 0 if size in (64, 128) else 128 - size
            cost += pad + penalty[j] + packing.SEQUENCE_COST
        assert (cuts[0], cuts[-1], cost) == (0, 12, least[12])


def test_license_scan(spark):
    found = license_scan.scan(frame(spark)).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(14, "mit"), (18, "cc-by-nc-4.0")}
    assert all(r["containment"] == 1.0 and r["first_word"] == 0 for r in found)
    assert license_scan.scan(frame(spark, [])).count() == 0
    none = spark.createDataFrame([("short", "three little words")], "license string, text string")
    assert license_scan.scan(frame(spark), none).count() == 0


def test_line_dedup(spark):
    docs = frame(spark).filter("doc_id is not null")
    got = line_dedup.deduplicate_lines(docs)
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in documents() if r[0] is not None}
    lines = {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            if WORD.search(line):
                lines.setdefault(line, (i, k))
    sets = {
        at: frozenset(line[j : j + 8] for j in range(max(1, len(line) - 7)))
        for line, at in lines.items()
    }
    home = groups(sets, 80)

    def left(i):
        if texts[i] is None:
            return None
        kept = [
            line
            for k, line in enumerate(texts[i].split("\n"))
            if not WORD.search(line) or home[lines[line]] == (i, k)
        ]
        return "\n".join(kept)

    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows == {i: left(i) for i in texts}
    full = line_dedup.deduplicate_lines(docs, drop_empty=True)
    gone = {i for i in texts if texts[i] and texts[i].strip() and not left(i).strip()}
    assert {r["doc_id"] for r in full.collect()} == set(texts) - gone
    assert line_dedup.deduplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def lines_left(rows, percent=80):
    """Text left of each row, by brute force; rows with a NULL id count as the last."""
    places = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                at = (i is None, i or 0, k)
                places[line] = min(places.get(line, at), at)
    names = sorted(places, key=lambda line: (places[line], line))
    sets = {
        n: frozenset(line[j : j + 8] for j in range(max(1, len(line) - 7)))
        for n, line in enumerate(names)
    }
    home = groups(sets, percent)
    stays = {line for n, line in enumerate(names) if home[n] == n}
    out = []
    for i, text in rows:
        kept = None if text is None else [
            line
            for k, line in enumerate(text.split("\n"))
            if not WORD.search(line) or (line in stays and places[line] == (i is None, i or 0, k))
        ]
        out.append((i, None if kept is None else "\n".join(kept)))
    return out


def test_line_dedup_of_repeated_content(spark):
    """Lines whose distinct shingles are alike while their lengths are far apart."""
    rows = [
        (1, "buy now " * 9 + "\n" + "-=" * 30 + " a"),
        (2, "buy now " * 30 + "\n" + "-=" * 90 + " a"),
        (3, "Home | About | News | " * 4),
        (4, "Home | About | News | " * 12),
    ]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = line_dedup.deduplicate_lines(docs).select("doc_id", "text").collect()
    assert dict(map(tuple, got)) == dict(lines_left(rows))
    assert dict(lines_left(rows))[2] == ""


def test_line_signatures_are_least_products():
    rng = np.random.default_rng(2)
    counts = np.array([1, 31, 32, 33, 64, 500, 2])
    hashes = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    got = line_dedup.signatures(hashes, counts)
    seeds = [int(x) for x in line_dedup._SEEDS]
    assert len(set(seeds)) == len(seeds) and all(x % 2 for x in seeds)
    for row, part in zip(got, np.split(hashes, np.cumsum(counts)[:-1])):
        high = [int(h) >> 32 for h in part]
        assert row.tolist() == [min(h * x % (1 << 32) for h in high) for x in seeds]
    # Order and repeats make no difference.
    part = hashes[64:97]
    again = rng.permutation(np.concatenate((part, part[:9])))
    one, two = (line_dedup.bands(x, np.array([len(x)]))[0] for x in (part, again))
    assert (one == two).all()
    assert line_dedup.bands(hashes[:0], counts[:0])[0].size == 0


@pytest.mark.parametrize("size", [10, 90, 400])
def test_lines_at_the_threshold_share_a_band(size):
    rng = np.random.default_rng(size)
    pairs, both = 3000, -(-size * 8 // 9)  # a similarity of 0.8
    one, two = (rng.integers(0, 1 << 64, (pairs, size), dtype=np.uint64) for _ in range(2))
    two[:, :both] = one[:, :both]
    keys = [
        line_dedup.bands(x.ravel(), np.full(pairs, size))[0].reshape(pairs, -1) for x in (one, two)
    ]
    assert (keys[0] == keys[1]).any(1).mean() > 0.99


def test_span_hashes_tell_ranges_apart():
    texts = ["", "a", "a\x00", "abcdefgh", "abcdefghabcdefgh", "abcdefghi", "ihgfedcba" * 50]
    texts += ["12345678abcdefgh", "abcdefgh12345678", "x" * 100_000, "x" * 100_001]
    raw, offsets = buffers(pa.array([*texts, *texts]))
    got = span_hashes(raw, offsets[:-1], offsets[1:])
    assert (got[: len(texts)] == got[len(texts) :]).all()
    assert len(set(got.tolist())) == len(texts)
    assert span_hashes(raw, offsets[:0], offsets[:0]).size == 0


def test_lists_of_two_or_more(spark):
    """Every key with two ids stays whole, also one that covers several partitions."""
    rows = [(7, k) for k in range(3000)] + [(k, 1) for k in range(100, 3000)]
    rows += [(k, 2) for k in range(100, 3000, 10)]
    postings = spark.createDataFrame(rows, "key long, id long").repartition(5)
    got = [tuple(r) for r in line_dedup.met(postings).collect()]
    by_key = {}
    for key, i in rows:
        by_key.setdefault(key, []).append(i)
    want = {(k, i) for k, ids in by_key.items() if len(ids) > 1 for i in ids}
    assert len(got) == len(set(got)) and want <= set(got) <= set(rows)
    # Beside whole lists only first and last rows of partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(set(got) - want) <= 2 * parts
    assert line_dedup.met(postings.limit(0)).count() == 0


def test_order_of_values():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    values[::7] = values[3] ^ np.arange(len(values[::7]), dtype=np.uint64) % np.uint64(5)
    for some in (values, values[:0], values[:1], values >> np.uint64(50)):
        assert (order_of(some) == np.argsort(some, kind="stable")).all()


def test_met_counts_an_item_once(spark):
    """Postings that come again make no list; keys of several blocks meet."""
    rows = [(k % 40, k % 8) for k in range(400)] + [(1000 + k, 5) for k in range(50)] * 3
    got = [tuple(r) for r in line_dedup.met(spark.createDataFrame(rows, "key long, id long").repartition(6)).collect()]
    want = Counter(k for k, _ in set(rows))
    assert sorted(got) == sorted(r for r in set(rows) if want[r[0]] > 1)


@pytest.mark.parametrize("operator", [line_dedup.deduplicate_lines, deduplicate])
def test_deduplication_leaves_one_frame(spark, operator):
    """What is staged on the way is dropped as soon as it is known what goes."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = operator(frame(spark))
    assert len(set(os.listdir(folder)) - before) == 1
    assert got.count() <= len(documents())


def test_line_dedup_of_null_and_repeated_ids(spark):
    """Rows without an id, or with one id and different texts, keep their own lines."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefghij klm"), 60)).strip() for _ in range(12)]
    near = [line[:-1] + "#" for line in pool]
    rows = [
        (1, f"{pool[0]}\n{pool[1]}"),
        (1, f"{pool[2]}\n{pool[3]}"),
        (1, f"{pool[4]}\n{pool[5]}"),
        (2, f"{near[3]}\n{near[0]}\n{near[5]}"),
        (2, pool[6]),
        (None, f"{near[1]}\n{pool[7]}"),
        (None, f"{pool[8]}\n{pool[9]}"),
        (None, f"{near[8]}\n{near[7]}"),
        (None, f"{pool[10]}\n{near[2]}\n{pool[11]}"),
        (None, f"{near[4]}\n{near[6]}"),
    ]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = line_dedup.deduplicate_lines(docs).select("doc_id", "text").collect()
    # Every near copy goes but that of line 8, which meets its like among the rows without an id.
    gone = set(near)
    want = []
    for i, text in rows:
        want.append((i, "\n".join(line for line in text.split("\n") if line not in gone)))
    got = sorted(((r[0] is None, r[0], r[1]) for r in got), key=str)
    eight = [(None, pool[8] + "\n" + pool[9]), (None, pool[9])], [(None, ""), (None, near[8])]
    either = []
    for first, second in zip(*eight):
        other = list(want)
        other[6], other[7] = first, second
        either.append(sorted(((i is None, i, t) for i, t in other), key=str))
    assert got in either

    same = [(None, f"{pool[0]}\n{pool[k]}", "en", "a", 0) for k in (1, 2, 3)]
    got = line_dedup.deduplicate_lines(frame(spark, same)).collect()
    assert sum(pool[0] in r["text"].split("\n") for r in got) == 1


def test_license_notices_and_brief_templates(spark):
    notice = (
        "This {0} is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU {1}General Public License as published by the Free Software Foundation, either version "
        "{2} of the License, or (at your option) any later version."
    )
    texts = [
        (notice.format("program", "", "3"), {"gpl-3.0-notice"}),
        (notice.format("program", "", "2"), {"gpl-2.0-notice"}),
        (notice.format("library", "Lesser ", "2.1"), {"lgpl-2.1-notice"}),
        (notice.format("library", "Lesser ", "3"), {"lgpl-3.0-notice"}),
        (notice.format("program", "Affero ", "3"), {"agpl-3.0-notice"}),
        ("// SPDX-License-Identifier: MIT\nint main() {}", {"spdx-mit"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"spdx-gpl-2.0-only"}),
        ("SPDX-License-Identifier: none of these licenses", set()),
        ("MIT", set()),
    ]
    texts += [(t, {n}) for n, t in license_scan.TEMPLATES.items()]
    found = license_scan.scan(frame(spark, [(k, t, "en", "a", 0) for k, (t, _) in enumerate(texts)]))
    mine = {k: set() for k in range(len(texts))}
    for r in found.collect():
        mine[r["doc_id"]].add(r["license"])
    assert [mine[k] for k in mine] == [names for _, names in texts]


COMMENTS = [("# ", ""), (" * ", " */"), ("// ", ""), ("-- ", ""), (";; ", ""), ("<!-- ", " -->")]


@pytest.mark.parametrize("opens, closes", COMMENTS)
def test_license_notices_in_comments(spark, opens, closes):
    """Notices wrapped at a few words, each line in a comment."""
    texts = sorted(license_scan.TEMPLATES.items())
    docs = []
    for k, (_, text) in enumerate(texts):
        words = text.split(" ")
        lines = [" ".join(words[at : at + 4]) for at in range(0, len(words), 4)]
        docs.append((k, "\n".join(f"{opens}{x}{closes}" for x in lines), "en", "a", 0))
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(frame(spark, docs)).collect()}
    assert {(k, name) for k, (name, _) in enumerate(texts)} <= found


def by_hand(text, templates):
    """``license, containment, first word`` by counting every stretch."""

    def cut(value):
        for mark in license_scan._MARKS:
            value = value.replace(mark, "")
        return WORD.findall(value.translate({i: i + 32 for i in range(65, 91)}))

    words = cut(text or "")
    for name, template in templates:
        own = cut(template)
        n = min(len(own), 5)
        if not n:
            continue
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        reach = -(-len(wanted) * 5 // 4)
        held = [(len(wanted & set(grams[k : k + reach])), -k) for k in range(len(grams))]
        held = [h for h in held if grams[-h[1]] in wanted]
        if held and max(held)[0] * 100 >= 80 * len(wanted):
            yield name, max(held)[0] / len(wanted), -max(held)[1]


def test_license_scan_equals_counting_every_stretch(spark):
    """Templates of one to forty words, at even and odd words, with edits at and beyond the limit."""
    texts = sorted(license_scan.TEMPLATES.items()) + [
        (f"t{n}", prose(700 + n, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 40)
    ]
    texts += [("again", texts[0][1]), ("nothing", " .. ")]
    docs = []
    for number, (_, text) in enumerate(texts):
        words = text.split(" ")
        for shift in (0, 1, 2):
            for at in (None, 0, len(words) // 2, len(words) - 1):
                own = [w if k != at else f"edit{k}" for k, w in enumerate(words)]
                docs.append(" ".join([*["pad"] * shift, *own, "end", *own[: 2 * shift]]))
    docs += [None, "", "a b c", texts[0][1] * 3]
    rows = [(k, text, "en", "a", 0) for k, text in enumerate(docs)]
    names = spark.createDataFrame(texts, "license string, text string")
    got = [tuple(r) for r in license_scan.scan(frame(spark, rows), names).collect()]
    wanted = [(k, *found) for k, text in enumerate(docs) for found in by_hand(text, texts)]
    assert sorted(got) == sorted(wanted) and len(got) > 300


def test_license_scan_with_full_texts(spark):
    """More shingles than fit into literals, found at their place."""
    long = [(f"l{k}", prose(900 + k, 800)) for k in range(20)]
    templates = spark.createDataFrame(long, "license string, text string")
    docs = frame(spark, [(k, f"one two {t}", "en", "a", 0) for k, (_, t) in enumerate(long)])
    rows = license_scan.scan(docs, templates).collect()
    assert sorted((r["doc_id"], r["license"], r["first_word"]) for r in rows) == [
        (k, f"l{k}", 2) for k in range(20)
    ]
