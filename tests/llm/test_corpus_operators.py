"""Operators over all documents, against brute force."""

import math

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import (
    SCHEMA,
    as_counter,
    documents,
    edited,
    frame,
    groups,
    prose,
    shingles,
    without_repeats,
)

from adkpi.llm import boosting, links, minhash_dedup, pivot_search, quality_model, suffix_dedup
from adkpi.llm.components import components
from adkpi.llm.links import linked_pairs
from adkpi.session import settings

SF_DIR = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (9, 8), (20, 9), (1, 5), (1, 5), (7, 7)]
    edges += [(k, k + 1) for k in range(100, 130)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 8} | {k: 100 for k in range(100, 131)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rows = minhash_dedup.near_duplicates(frame(spark)).distinct().collect()
    sets = {r[0]: shingles(r[1]) for r in documents() if r[0] is not None}
    home = groups(sets, 85)
    assert {r["id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items() if s}
    assert {r["id"]: r["component"] for r in rows} == {i: home[i] for i in sets if sets[i]}
    kept = minhash_dedup.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns
    want = as_counter((r[0],) for r in documents() if r[0] is None or home[r[0]] == r[0])
    assert as_counter(kept.select("doc_id").collect()) == want
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts: each is compared by its own."""
    bases = [prose(50 + k, 160) for k in range(4)]
    texts = [(5, b) for b in bases] + [(3, bases[1]), (None, bases[2])]
    texts += [(10 + k, edited(b, 150, 60 + k)) for k, b in enumerate(bases)]
    rows = [(i, t, "en", "a", 0) for i, t in texts]
    sets = {n: shingles(t) for n, (_, t) in enumerate(texts) if texts[n][0] is not None}
    home = groups(sets, 85)
    least = {}
    for n, h in home.items():
        least[h] = min(least.get(h, texts[n][0]), texts[n][0])
    want = as_counter((texts[n][0], least[h]) for n, h in home.items())
    found = minhash_dedup.near_duplicates(frame(spark, rows))
    assert as_counter(found.select("id", "component").collect()) == want
    kept = minhash_dedup.deduplicate(frame(spark, rows)).select("doc_id", "text").collect()
    stays = [texts[n] for n, h in home.items() if least[h] == texts[n][0]]
    assert as_counter(kept) == as_counter([*stays, (None, bases[2])])


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    n, percent = minhash_dedup.COORDINATES, minhash_dedup.PERCENT
    p = percent / 100
    short = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(minhash_dedup.MATCHES))
    assert short < 1e-5


def test_a_pair_at_the_threshold_meets_in_a_band():
    bands = minhash_dedup.COORDINATES // minhash_dedup.MATCHES
    for p, most in ((0.85, 1e-6), (0.8, 4e-5)):
        assert (1 - p**minhash_dedup.MATCHES) ** bands < most


def near_copies(count):
    """Word lists of several templates, with edits: pairs far from any leader, chains, cuts."""
    rng = np.random.default_rng(23)
    texts = {}
    for k in range(count):
        words = [f"t{k % 3}w{j}" if j % 4 else f"w{j}" for j in range(160)]
        for at in rng.integers(0, 160, int(rng.integers(0, 14))):
            words[at] = f"e{rng.integers(0, 30)}"
        texts[k] = words[: 160 - 5 * int(rng.integers(0, 8))]
    return texts


@pytest.mark.parametrize("family", [8, 128])
def test_links_in_large_families(spark, monkeypatch, family):
    """Families beyond the bound go by blocks, leaders and what lies outside those."""
    monkeypatch.setattr(links, "FAMILY", family)
    monkeypatch.setattr(links, "_BLOCK", family // 2)
    texts = near_copies(150)
    home = groups({k: shingles(" ".join(w)) for k, w in texts.items()}, 85)
    sized = spark.createDataFrame(
        [(k, len(shingles(" ".join(w))), " ".join(w)) for k, w in texts.items()],
        "id long, n long, text string",
    )
    # Lists of neighbours that overlap, and one that holds everything.
    lists = [(k // 7, k) for k in texts] + [(100 + k // 11, k) for k in texts] + [(-1, k) for k in texts]
    edges = linked_pairs(
        spark.createDataFrame(lists, "key long, id long"),
        lambda wanted: sized.join(wanted, "id", "left_semi"),
        minhash_dedup.distinct_grams,
        85,
    )
    linked = {r["id"]: r["component"] for r in components(edges).collect()}
    assert {k: linked.get(k, k) for k in texts} == home


def test_links_in_wide_families(spark, monkeypatch):
    """Families of thousands meet in one task; their links are those of all pairs of a list."""
    monkeypatch.setattr(links._Linker, "blocks", None)  # no further jobs
    rng = np.random.default_rng(7)
    texts, home = {}, {}
    for k in range(2100):
        kind = k % 700
        words = [f"t{kind // 7}w{j}" for j in range(30)] + [f"k{kind}w{j}" for j in range(12)]
        if k % 3 == 0:
            words[int(rng.integers(0, 40))] = f"e{k}"
        texts[k] = " ".join(words)
        home.setdefault(kind, k)
    sets = {k: shingles(t) for k, t in texts.items()}
    want = {}
    for kind in range(700):
        same = range(kind, 2100, 700)
        want |= groups({k: sets[k] for k in same}, 80)
    sized = spark.createDataFrame(list(texts.items()), "id long, text string")
    # One list of each kind's members, and lists that hold thousands.
    lists = [(k % 700, k) for k in texts] + [(-1, k) for k in texts] + [(-2, k) for k in texts if k % 5]
    edges = linked_pairs(
        spark.createDataFrame(lists, "key long, id long"),
        lambda wanted: sized.join(wanted, "id", "left_semi"),
        minhash_dedup.distinct_grams,
        80,
    )
    linked = {r["id"]: r["component"] for r in components(edges).collect()}
    assert {k: linked.get(k, k) for k in texts} == want


@pytest.mark.parametrize("bits", [64 * 150, 1 << 29])
def test_links_by_leaders_and_lists(monkeypatch, bits):
    """The same components as from a table of all members, for one list and for several."""
    monkeypatch.setattr(links, "_BITS", bits)
    monkeypatch.setattr(links, "_LEADERS", 3)
    texts = near_copies(150)
    grams, counts = minhash_dedup.distinct_grams(pa.array(" ".join(w) for w in texts.values()))
    group = np.zeros(150, np.int64)
    keys = pa.array([[0, 1 + k % 2] for k in range(150)], pa.list_(pa.int64()))
    found = []
    for table, sorted_at_once in ((1000, 1 << 22), (10, 1 << 22), (10, 1000)):
        monkeypatch.setattr(links, "_TABLE", table)
        monkeypatch.setattr(links, "_SORTED", sorted_at_once)
        a, b = links._linked(grams, counts, group, 85, keys)
        found.append(links.least_reached(a, b, 150).tolist())
    assert found[0] == found[1] == found[2] and len(set(found[0])) < 150


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr("adkpi.llm.components._FEW", few)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 140)]
    home = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in home:
        for a, b in pairs:
            if a != b:
                home[a] = home[b] = min(home[a], home[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == home and len(got) == len(home)


def test_links_in_groups_of_any_size(spark):
    """Whole groups, also those that go on in another batch; no edge between groups."""
    texts = near_copies(150)
    rows, home = [], {}
    for group, (start, stop) in enumerate([(0, 1), (1, 3), (3, 10), (10, 19), (19, 150)]):
        rows += [(group, k, " ".join(texts[k])) for k in range(start, stop)]
        home |= groups({k: shingles(" ".join(texts[k])) for k in range(start, stop)}, 85)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        edges = links.links_in_groups(
            spark.createDataFrame(rows, "grp long, id long, text string"),
            minhash_dedup.distinct_grams,
            85,
        )
        linked = {r["id"]: r["component"] for r in components(edges).collect()}
    assert {k: linked.get(k, k) for k in home} == home


def test_links_in_a_long_list(spark):
    """Members far from every leader but close to each other, and chains, are not lost."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 12))):
            words[at] = f"e{k}x{at}"
        texts[k] = words
    for k in range(60, 70):  # pairs that share their edits
        words = list(texts[k - 60 + 20])
        for at in rng.integers(0, 200, 18):
            words[at] = f"s{k // 2}x{at}"
        texts[k] = words
        texts[k + 20] = [*words[:-1], f"end{k}"]
    for k in range(70, 80):  # cut short
        texts[k] = base[: 200 - 4 * (k - 69)]
    rows = [(k, " ".join(w), "en", "a", 0) for k, w in texts.items()]
    home = groups({k: shingles(r[1]) for k, r in zip(texts, rows)}, 85)
    docs = frame(spark, rows)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r["id"]: r["component"] for r in got} == home

    # The same from a single list that holds everything.
    ids = docs.selectExpr("doc_id as id")
    sized = spark.createDataFrame(
        [(k, len(shingles(r[1])), r[1]) for k, r in zip(texts, rows)], "id long, n long, text string"
    )
    edges = linked_pairs(
        ids.selectExpr("0L as key", "id"),
        lambda wanted: sized.join(wanted, "id", "left_semi"),
        minhash_dedup.distinct_grams,
        85,
    )
    linked = {r["id"]: r["component"] for r in components(edges).collect()}
    assert {k: linked.get(k, k) for k in texts} == home


def test_suffix_dedup(spark):
    rows = documents()
    rows += [(100, rows[13][1][500:900], "en", "a", 0), (101, "x" + "a" * 60, "en", "a", 0)]
    # An id with two texts.
    rows += [(102, rows[13][1][2000:2100], "en", "a", 0), (102, rows[11][1], "en", "a", 0)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).drop("kept").collect()
    assert as_counter(got) == as_counter(without_repeats(rows))
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_picks_cover_every_string():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    grams, low, high = suffix_dedup.picked(raw)
    hashes = suffix_dedup.window_hashes(raw, suffix_dedup.GRAM)
    assert low[0] == 0 and high[-1] == len(raw) - 50 and (low[1:] == high[:-1] + 1).all()
    for g, a, b in zip(grams, low, high):
        for p in range(a, b + 1):
            assert hashes[p : p + 26].min() == g


def vectors(count, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=16).astype(float).tolist()) for k in range(count)]
    rows[3] = (3, rows[1][1])
    rows[5] = (5, rows[0][1])
    rows[7] = (7, None)
    rows[8] = (8, [0.0] * 16)
    rows[9] = (9, [math.nan] + [1.0] * 15)
    rows[10] = (10, [None] + [1.0] * 15)
    rows[11] = (11, [])
    return [*rows, (None, [1.0] * 16), rows[20]]


def exact_neighbours(rows, queries, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v) / np.linalg.norm(v)
    out = {}
    for q in queries:
        if q in usable:
            near = sorted((-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def test_pivot_search(spark):
    rows = vectors(600)
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [k for k in range(600) if k % 20 == 0]
    options = {"block_rows": 100, "block_queries": 7}
    asked = frame_.filter("vec_id % 20 = 0")
    got = pivot_search.search(frame_, asked, at_least=100, **options).collect()
    want = exact_neighbours(rows, queries)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
    assert mine.keys() == want.keys() and all(len(v) == 5 for v in mine.values())
    hits = sum(len(set(mine[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert mine[0][0] == 5
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    got = pivot_search.search(few, few).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {
        (a, b) for a in range(4) for b in range(4) if a != b
    }
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert pivot_search.search(empty, empty).count() == 0


def test_pivot_search_in_a_hot_cluster(spark):
    """Near copies of one vector with a pivot or two among them; production parameters."""
    rng = np.random.default_rng(17)
    count, hot = 40000, 1500
    rows = rng.normal(size=(count, 16))
    inside = rng.permutation(count)[:hot]
    rows[inside] = rows[0] + 0.0001 * rng.normal(size=(hot, 16))
    frame_ = spark.createDataFrame(
        [(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>"
    )
    queries = inside[:60]
    asked = frame_.filter(frame_.vec_id.isin(queries.tolist()))
    mine = {}
    for r in pivot_search.search(frame_, asked).collect():
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    hits = 0
    for q in queries.tolist():
        # Cosines of near copies differ in their last digits only: the distance tells them apart.
        apart = np.linalg.norm(units - units[q], axis=1)
        apart[q] = 4
        hits += len(mine[q] & set(np.argsort(apart)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(queries), hits


def test_trees_learn_and_stay_the_same():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 4)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(rows[:2000], labels[:2000])
    assert ((trees.scores(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.95
    assert boosting.fit(rows[:0], labels[:0]).scores(rows[:3]).tolist() == [0.5] * 3
    assert len(trees.scores(rows[:0])) == 0


def test_quality_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = quality_model.score_documents(docs, labels)
    both = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in both) >= 0.9 * len(both) > 0
    odd = quality_model.score_documents(frame(spark), labels.limit(0)).collect()
    assert len(odd) == len(documents()) and {r["score"] for r in odd} == {0.5}
    assert quality_model.keep_good(frame(spark, []), labels).count() == 0
    for one, two in (("figures", "score"), ("__figures", "__score"), ("__text", "_label")):
        clash = docs.withColumnRenamed("lang", one).withColumnRenamed("source", two)
        kept = quality_model.keep_good(clash, labels)
        assert kept.columns == clash.columns
        good = quality_model.score_documents(docs, labels).filter("predicted = 1")
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
            r["doc_id"] for r in good.collect()
        )
    bounded = quality_model.score_documents(docs, labels, max_rows=40)
    assert bounded.count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == columns
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= left
        left = {r["doc_id"] for r in rows}
        if name == "near dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
            assert groups(sets, 80) == {i: i for i in sets}
        texts = rows
    sizes = {}
    for r in docs.collect():
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 2048
    assert docs.select("doc_id").distinct().count() == len({r["doc_id"] for r in texts})


def test_near_dedup_stage_at_its_threshold(spark):
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(12):  # 300 words cut to 250 ... 239: 0.83 to 0.79 of the shingles
        own = [f"{w}v{k}" for w in base]
        rows += [(2 * k, " ".join(own), "en", "a", 0), (2 * k + 1, " ".join(own[: 250 - k]), "en", "a", 0)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    home = groups(sets, 80)
    assert groups(sets, 85) != home
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), SF_DIR)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in sets if home[i] == i}


def test_pipeline_without_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF_DIR)
        assert out.count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 25, 50])
def test_window_hashes(size):
    raw = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcx", np.uint8)
    hashes = suffix_dedup.window_hashes(raw, size)
    parts = [raw[k : k + size].tobytes() for k in range(len(raw) - size + 1)]
    assert len(hashes) == len(parts)
    assert len(set(hashes.tolist())) == len(set(parts))
