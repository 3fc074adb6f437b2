"""Compare a Spark frame with a DuckDB query, regardless of row order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return float(repr(value))
    return value


def assert_same(spark_df, con, sql):
    relation = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(relation.columns)
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, f"{len(wrong)} rows differ, first: {wrong[0]}"
    return len(got)
