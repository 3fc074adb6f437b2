"""Delimited text: the raw tab-separated dump and the normalised comma-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adkpi.schemas import normalised_schema

ROW_ID = "_row_id"


def read_raw_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw dump, plain or gzip, all columns as text, names from the header line.

    Short lines are padded, surplus cells cut, blank lines skipped, quotes are ordinary
    characters.
    """
    rows = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if any(name.endswith(".gz") for name in rows.inputFiles()):
        # A gzip file cannot be split, so spread its rows before any work is done on them.
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def read_normalised_csv(spark: SparkSession, path: str, keep_cats: bool = False) -> DataFrame:
    """Normalised files, columns found by the header's names in any order.

    Cells that do not fit their column's type are NULL. A needed column that no file has is an
    error; the category columns are blank where they are absent.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    schema, plain = normalised_schema(keep_cats), normalised_schema(False)
    missing = [name for name in plain.fieldNames() if name not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(
        *(
            (F.col(f.name) if f.name in rows.columns else F.lit(None))
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        )
    )
