"""Merkle manifest of a dataset: a store of digests, and proofs by descent from the root.

Every row is a leaf, the digest of its fields. Leaves of one group (a language) ascend by id; every
``ARITY`` consecutive ones are hashed together, level by level, to the group's subroot, and the
subroots, in the order of their groups, likewise to the root. What is stored is content-addressed:
a record leads from a digest to the digests of its children, and holds no place in any tree.

A proof descends. A request starts at the root with the digits, in base ``ARITY``, of its rank.
At each node the digit picks one child to go on with, and the children it did not pick become a
segment of the path; reversed, the segments run from leaf to root. Requests with the same digits
so far travel as one row, so the root is looked up once and not once per leaf, and no key of a
join grows with the table. Equal subtrees (of repeated rows) share a digest; records are kept
once per digest and per ``LOT`` consecutive places, so no record is looked up more often than
that. Hashing needs two columns of digests, never texts: these are read once, by the leaves.

Ranks within a group come from one range sort of narrow rows, with start positions per sorted
partition, so a group with most of all rows is split like any other.

Defined results: groups order NULL first, then by bytes; a group's rows without id come first;
repeated ids are ordered by their leaf, and rows that repeat in all fields stand next to each
other in any order, which changes no digest. A lone leaf is its group's subroot, a lone subroot
the root. Empty tables have no root and no rows. A proof without siblings is the digest of
nothing. Only the named columns are hashed; extra ones play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adkpi.llm import sql
from adkpi.operators.position import with_position
from adkpi.session import staged

ARITY = 8
LOT = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST = 32  # bytes of a digest
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def field(value: Column) -> Column:
    """``-`` for NULL, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass(frozen=True)
class Manifest:
    """``records``: height, lot, digest, children. ``leaves``: tree, rank, n and what they carry.

    ``trees``: tree, group, n, height, digest (the subroot). ``root``: one row, height and digest.
    ``height`` only says which part of the records to read; a lookup is by digest.
    """

    records: DataFrame
    leaves: DataFrame
    trees: DataFrame
    root: DataFrame
    groups: int
    heights: tuple[int, int]  # of the tallest group, and of the tree over the subroots


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, id, digest, …) with tree, rank and n; and group, tree, n of every tree."""
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest", "row"]
    placed = staged(
        leaves.withColumn("row", F.monotonically_increasing_id())
        .orderBy(*order)
        .withColumn("slot", F.monotonically_increasing_id())
        .drop("row")
    )
    placed = placed.withColumn("part", F.shiftright("slot", _ROW_BITS))
    # One row per sorted partition and group in it: partitions plus groups at most.
    stretches = placed.groupBy("part", "group").agg(
        F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first")
    )
    stretches = staged(stretches)
    trees = stretches.groupBy("group").agg(F.sum("rows").alias("n"))
    trees = with_position(trees, [F.col("group").asc_nulls_first()])
    trees = staged(trees.withColumnRenamed("position", "tree"))
    before = Window.partitionBy("group").orderBy("part")
    start = F.coalesce(
        F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    known = stretches.withColumn("start", start).alias("s").join(
        trees.alias("t"), F.col("s.group").eqNullSafe(F.col("t.group"))
    )
    known = known.select("s.part", F.col("s.group").alias("of"), "first", "start", "tree", "n")
    same = (placed["part"] == known["part"]) & placed["group"].eqNullSafe(known["of"])
    ranked = placed.join(known, same).withColumn("rank", F.col("slot") - F.col("first") + F.col("start"))
    return ranked.drop("part", "slot", "of", "first", "start", "group"), trees


def _parents(level: DataFrame) -> DataFrame:
    """Every ``ARITY`` consecutive nodes under the digest of their digests."""
    nodes = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    above = level.groupBy("tree", _div("idx", ARITY).alias("idx"), "n").agg(
        F.array_join(F.transform(nodes, lambda node: hex_of(node.digest)), "").alias("text")
    )
    return above.select(
        "tree",
        "idx",
        F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.unhex("text").alias("children"),
    )


def _grown(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Levels above the leaves (tree, idx, n, digest), each tree's top, and the greatest height."""
    levels: list[DataFrame] = []
    level = leaves
    tops = []
    while True:
        top = level.filter("n = 1")
        tops.append(top.select("tree", "digest", F.lit(len(levels)).alias("height")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, tops), len(levels)
        level = staged(_parents(level.filter("n > 1")))
        most = -(-most // ARITY)
        levels.append(level)


def _records(levels: list[DataFrame], below: int) -> list[DataFrame]:
    return [
        level.select(
            F.lit(below + k).alias("height"),
            _div("idx", LOT).alias("lot"),
            "digest",
            "children",
        ).distinct()
        for k, level in enumerate(levels, 1)
    ]


def build(leaves: DataFrame) -> Manifest:
    """The manifest of leaves ``group, id, digest`` (binary); their other columns are carried."""
    ranked, trees = _ranked(leaves)
    ranked = staged(ranked)
    sizes = trees.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    nodes = ranked.select("tree", F.col("rank").alias("idx"), "n", "digest")
    levels, tops, height = _grown(nodes, sizes["most"] or 0)
    trees = staged(trees.join(tops, "tree"))
    subroots = trees.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("idx"),
        F.lit(sizes["groups"]).cast("long").alias("n"),
        "digest",
    )
    upper, root, upper_height = _grown(subroots, sizes["groups"])
    empty = nodes.sparkSession.createDataFrame(
        [], "height int, lot long, digest binary, children binary"
    )
    records = reduce(
        DataFrame.unionByName, [*_records(levels, 0), *_records(upper, height)], empty
    )
    return Manifest(records, ranked, trees, root, sizes["groups"], (height, upper_height))


def _step(frontier: DataFrame, records: DataFrame, asked: DataFrame) -> DataFrame:
    """One level down: look the node up by digest, pick the asked children, keep the others."""
    there = frontier.join(asked, ["tree", "idx"]).withColumn("lot", _div("idx", LOT))
    found = there.join(records.select("lot", "digest", "children"), ["digest", "lot"])
    found = found.withColumn("want", F.explode("wanted"))
    at = F.col("want.digit") * _DIGEST
    left = F.substring("children", F.lit(1), at)
    right = F.substring("children", at + (_DIGEST + 1), F.lit(ARITY * _DIGEST))
    return found.select(
        "tree",
        (F.col("idx") * ARITY + F.col("want.digit")).alias("idx"),
        F.substring("children", at + 1, F.lit(_DIGEST)).alias("digest"),
        F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))).alias("path"),
        "tops",
        F.col("want.payload").alias("payload"),
    )


def _descend(
    starts: DataFrame, records: DataFrame, requests: DataFrame, tallest: int, below: int
) -> DataFrame:
    """From ``starts`` (tree, height, digest, path, tops) to the requested leaves.

    ``requests`` are tree, n, rank and a payload; ranks do not repeat within a tree. Result:
    payload, digest (the leaf's), path (from the root down), tops.
    """
    starts = starts.withColumn("idx", F.lit(0).cast("long"))
    digit = lambda of: F.pmod(of, F.lit(ARITY)).cast("int").alias("digit")
    nothing = F.lit(None).cast(requests.schema["payload"].dataType).alias("payload")
    place = ["tree", "idx", "digest", "path", "tops"]
    frontier = None
    for height in range(tallest, 0, -1):
        begun = starts.filter(F.col("height") == height).select(*place)
        frontier = begun if frontier is None else frontier.select(*place).unionByName(begun)
        # A node at this height covers ARITY ** height ranks.
        node = _div("rank", ARITY**height).alias("idx")
        tall = requests.filter("n > 1")
        if height == 1:
            wanted = F.collect_list(F.struct(digit(F.col("rank")), "payload"))
        else:
            child = _div("rank", ARITY ** (height - 1))
            wanted = F.collect_set(digit(child))
        asked = tall.groupBy("tree", node).agg(wanted.alias("wanted"))
        if height > 1:
            pair = F.transform("wanted", lambda d: F.struct(d.alias("digit"), nothing))
            asked = asked.withColumn("wanted", pair)
        level = records.filter(F.col("height") == below + height)
        frontier = _step(frontier, level, asked)
    lone = starts.filter("height = 0").join(requests.filter("n = 1"), "tree")
    found = lone.select("payload", "digest", "path", "tops")
    return found if frontier is None else found.unionByName(frontier.select(*found.columns))


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``payload, digest, path, root, subroot`` of every request (tree, n, rank, payload).

    ``path`` holds structs of bytes ``left`` and ``right`` of the requested node, leaf first.
    """
    height, upper = manifest.heights
    segment = "array<struct<left: binary, right: binary>>"
    begin = manifest.root.select(
        "tree",
        "height",
        "digest",
        F.array().cast(segment).alias("path"),
        F.struct(F.col("digest").alias("root")).alias("tops"),
    )
    to_trees = manifest.trees.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(manifest.groups).cast("long").alias("n"),
        F.col("tree").alias("rank"),
        F.struct("tree", "height").alias("payload"),
    )
    tops = _descend(begin, manifest.records, to_trees, upper, height).select(
        F.col("payload.tree").alias("tree"),
        F.col("payload.height").alias("height"),
        "digest",
        "path",
        F.struct(F.col("tops.root").alias("root"), F.col("digest").alias("subroot")).alias("tops"),
    )
    found = _descend(tops, manifest.records, requests, height, 0)
    return found.select("payload", "digest", F.reverse("path").alias("path"), "tops.*")


def siblings_hash(path: Column) -> Column:
    """Hash of all siblings, leaf level first, left to right."""
    parts = F.transform(path, lambda s: hex_of(F.concat(s.left, s.right)))
    return F.sha2(F.array_join(parts, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` (hex) leads to along ``path``."""
    return F.aggregate(
        path,
        leaf,
        lambda below, s: F.sha2(F.concat(hex_of(s.left), below, hex_of(s.right)), 256),
    )


def audit(leaves: DataFrame) -> DataFrame:
    """Build the manifest, prove every leaf and fold its ``presented`` digest, NULL: its own.

    ``id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests in hex.
    """
    manifest = build(leaves)
    requests = manifest.leaves.select("tree", "n", "rank", F.struct("id", "presented").alias("payload"))
    found = proofs(manifest, requests)
    shown = hex_of(F.coalesce("payload.presented", "digest"))
    return found.select(
        F.col("payload.id").alias("id"),
        hex_of(F.col("digest")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        hex_of(F.col("root")).alias("root"),
        siblings_hash(F.col("path")).alias("proof_sha256"),
        folded(shown, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = {name: F.col(name) for name in FIELDS}
    tampered = leaf_hash((values | {"text": lower_ascii(F.col("text"))}).values())
    number = F.crc32(F.col("doc_id").cast("string"))
    leaves = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").alias("id"),
        F.unhex(leaf_hash(values.values())).alias("digest"),
        F.when(number % TAMPER_EVERY == 0, F.unhex(tampered)).alias("presented"),
    )
    return audit(staged(leaves)).withColumnRenamed("id", "doc_id")


def _leaf_sql(text: str) -> str:
    values = [text if name == "text" else name for name in FIELDS]
    parts = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """``name`` (key, level, idx, n, digest): the leaves and all levels above them."""
    return f"""
{name} AS (
  SELECT {key}, 0 AS level, idx, n, digest FROM {leaves}
  UNION ALL
  SELECT {key}, max(level) + 1, idx // {ARITY}, (max(n) + {ARITY - 1}) // {ARITY},
    sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY {key}, idx // {ARITY})"""


def _siblings_sql(name: str, tree: str, key: str) -> str:
    """``name`` (key, leaf, level, before, after): what stands beside a leaf's way up."""
    return f"""
{name} AS (
  SELECT l.{key}, l.idx AS leaf, own.level,
    coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < own.idx), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > own.idx), '') AS after
  FROM {tree} l
  JOIN {tree} own ON own.{key} IS NOT DISTINCT FROM l.{key}
    AND own.idx = l.idx // ({ARITY} ** own.level)::BIGINT AND own.n > 1
  JOIN {tree} s ON s.{key} IS NOT DISTINCT FROM own.{key} AND s.level = own.level
    AND s.idx // {ARITY} = own.idx // {ARITY}
  WHERE l.level = 0 GROUP BY l.{key}, l.idx, own.level, own.idx)"""


_TAMPERED = _leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")
ORACLE = f"""
WITH RECURSIVE {sql.CRC_TABLE.strip()},
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS digest,
    CASE WHEN {sql.crc32("doc_id::VARCHAR")} % {TAMPER_EVERY} = 0 THEN {_TAMPERED} END AS presented,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc_table),
{_tree_sql("nodes", "leaves", "lang").strip()},
subroots AS (
  SELECT 1 AS one, lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx,
    count(*) OVER () AS n
  FROM nodes WHERE n = 1),
{_tree_sql("tops", "subroots", "one").strip()},
{_siblings_sql("beside", "nodes", "lang").strip()},
{_siblings_sql("above", "tops", "one").strip()},
path AS (
  SELECT l.doc_id, b.level, b.before, b.after
  FROM leaves l JOIN beside b ON b.lang IS NOT DISTINCT FROM l.lang AND b.leaf = l.idx
  UNION ALL
  SELECT l.doc_id, 1000 + a.level, a.before, a.after
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  JOIN above a ON a.leaf = s.idx),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM path),
proofs AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS siblings, count(*) AS steps
  FROM steps GROUP BY doc_id),
climb AS (
  SELECT doc_id, 0::BIGINT AS step, coalesce(presented, digest) AS digest FROM leaves
  UNION ALL
  SELECT c.doc_id, s.step, sha256(s.before || c.digest || s.after)
  FROM climb c JOIN steps s ON s.doc_id = c.doc_id AND s.step = c.step + 1),
found AS (
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot,
    (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    c.digest AS folded_root
  FROM leaves l
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN proofs p ON p.doc_id = l.doc_id
  JOIN climb c ON c.doc_id = l.doc_id AND c.step = coalesce(p.steps, 0))
SELECT *, folded_root = root AS verified FROM found
"""
