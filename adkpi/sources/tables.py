"""Day-partitioned tables: Parquet by path, or tables of a catalog with row-level merge."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adkpi.paths import Layout
from adkpi.schemas import GOLD, KPI_STATE, SILVER, STATE
from adkpi.session import settings
from adkpi.sources import snapshots
from adkpi.sources.snapshots import Snapshot


# Fixed value: folder name of the partition that holds rows without a day.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"

_LISTING_TASKS = 200

# Runs of the key index after which it is written anew from the table.
KEY_RUNS = 8


@dataclass(frozen=True)
class DayTable:
    """A table partitioned by one date column, in versions.

    Data folders are never changed: a write puts the days it replaces into a folder of its own,
    and one new version file switches all of them at once (see ``snapshots``). Readers keep the
    version they began with until ``expire`` removes it. One writer at a time; a second one that
    comes in between is refused. A folder that an earlier release wrote without versions is
    read as it is, and adopted by the first write.

    Where rows can move to another day, a key index lies beside the data: hashes of the keys
    and their day, as sorted runs. It never misses a row's day; it may hold days a key has left,
    which costs a look at such a day and nothing else. So an upsert finds the rows it replaces
    without reading the other days.
    """

    path: str
    schema: T.StructType
    day: str
    keys: tuple[str, ...]
    null_safe: bool = False
    name: str | None = None

    @classmethod
    def silver(cls, layout: Layout, table: str = "processed_events", database: str | None = None):
        name = f"{database}.{table}" if database else None
        return cls(layout.silver(table), SILVER, "event_date", ("event_id",), name=name)

    @classmethod
    def state(cls, silver_path: str):
        """What a silver table was made from, per id; rows without a day include the orphans."""
        return cls(f"{silver_path}_state", STATE, "event_date", ("event_id",))

    @classmethod
    def kpi_state(cls, gold_path: str):
        """Mergeable state beside a summary (see ``operators.kpi_state``)."""
        keys = ("summary_date", "campaign")
        return cls(f"{gold_path}_state", KPI_STATE, "summary_date", keys, null_safe=True)

    @classmethod
    def gold(
        cls, layout: Layout, table: str = "campaign_daily_summary", database: str | None = None
    ):
        name = f"{database}.{table}" if database else None
        keys = ("summary_date", "campaign")
        return cls(layout.gold(table), GOLD, "summary_date", keys, null_safe=True, name=name)

    # Reading

    def snapshot(self, spark: SparkSession, version: int | None = None) -> Snapshot:
        """The newest or the given version; an older folder's days where there is none."""
        found = snapshots.load(spark, self.path, version)
        if found is not None:
            return found
        folders = [n for n in snapshots.children(spark, self.path) if n.startswith(f"{self.day}=")]
        days = {n.partition("=")[2]: f"{self.path}/{n}" for n in folders}
        return Snapshot(0, days, None if days else [])

    def read(
        self,
        spark: SparkSession,
        days: Iterable[dt.date | None] | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """All rows, or those of ``days``, whose folders alone are then listed and read."""
        return self._rows(spark, self.snapshot(spark, version), days)

    def _rows(
        self, spark: SparkSession, snapshot: Snapshot, days: Iterable[dt.date | None] | None = None
    ) -> DataFrame:
        chosen = snapshot.days
        if days is not None:
            wanted = {_day_text(day) for day in days}
            chosen = {day: folder for day, folder in chosen.items() if day in wanted}
        # Folders of one root share their partition columns; a copy reads from two roots.
        roots: dict[tuple[str, bool], list[str]] = {}
        for folder in chosen.values():
            above = folder.rpartition("/")[0]
            made_here = "/gen=" in above
            root = above.rpartition("/gen=")[0] if made_here else above
            roots.setdefault((root, made_here), []).append(folder)
        # Folders are listed in a few hundred tasks at most, many in each.
        listing = settings(
            spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=str(_LISTING_TASKS)
        )
        with listing:
            frames = [
                spark.read.schema(self.schema)
                .option("basePath", root)
                .parquet(*folders)
                .select(*self.schema.fieldNames())
                for (root, _), folders in roots.items()
            ]
        if not frames:
            return spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, frames)

    @property
    def indexed(self) -> bool:
        """A key that holds the day cannot move, so no index is needed to find it."""
        return self.day not in self.keys

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def known_days(self, spark: SparkSession, keys: DataFrame) -> DataFrame | None:
        """``hash, day`` of the index for the keys in ``keys``; None where there is no index."""
        runs = self.snapshot(spark).keys
        if not self.indexed or runs is None:
            return None
        schema = T.StructType().add("hash", T.LongType()).add("day", T.DateType())
        if not runs:
            return spark.createDataFrame([], schema)
        asked = keys.select(self._hash().alias("hash")).distinct()
        return spark.read.schema(schema).parquet(*runs).join(asked, "hash", "left_semi").distinct()

    def unknown_keys(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows whose key and day the index does not hold yet."""
        held = known.select(F.col("hash").alias("_hash"), F.col("day").alias("_day"))
        same = (self._hash() == F.col("_hash")) & F.col(self.day).eqNullSafe(F.col("_day"))
        return rows.join(held, same, "left_anti")

    # Writing

    def overwrite_days(self, df: DataFrame) -> None:
        """Replace exactly the days that occur in ``df``."""
        self.change_days(df)

    def replace_all(self, df: DataFrame) -> None:
        """Replace the whole table, which ``df`` may read from."""
        self.change_days(df, keep_others=False)

    def change_days(
        self,
        df: DataFrame,
        emptied: Iterable[dt.date | None] = (),
        new_keys: DataFrame | None = None,
        keep_others: bool = True,
    ) -> None:
        """Replace the days that occur in ``df`` and clear ``emptied``, in one step.

        ``new_keys`` are keys with days that the index may lack; all of ``df`` unless given.
        """
        spark = df.sparkSession
        before = self.snapshot(spark)
        written = self._write(df)
        gone = {_day_text(day) for day in emptied}
        kept = {d: f for d, f in before.days.items() if keep_others and d not in gone}
        days = {**kept, **written}
        keys = before.keys if keep_others else []
        after = replace(before, version=before.version + 1, days=days, keys=keys)
        if self.indexed:
            rows = new_keys
            if keys is None or len(keys) >= KEY_RUNS:
                # No index yet, or one of many runs with days that keys have left: from the data.
                rows, keys = self._rows(spark, after), []
            elif rows is None:
                rows = self._rows(spark, replace(after, days=written))
            after = replace(after, keys=[*keys, *self._write_keys(rows)])
        snapshots.commit(spark, self.path, after)
        self._point_catalog(spark, before, after)

    def _write(self, df: DataFrame) -> dict[str, str]:
        """New folders with the rows of ``df``, by day; nothing points to them yet."""
        spark = df.sparkSession
        folder = f"{self.path}/gen={uuid.uuid4().hex}"
        # Nothing shows before the version does, so tasks may move their files into place
        # themselves. A day is whole in its partition; merging partitions would not make fewer
        # files, only fewer tasks to write them.
        with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
            self._laid_out(df).write.option(
                "mapreduce.fileoutputcommitter.algorithm.version", "2"
            ).partitionBy(self.day).parquet(folder)
        names = [n for n in snapshots.children(spark, folder) if n.startswith(f"{self.day}=")]
        return {name.partition("=")[2]: f"{folder}/{name}" for name in names}

    def _write_keys(self, rows: DataFrame) -> list[str]:
        folder = f"{self.path}/keys/run={uuid.uuid4().hex}"
        pairs = rows.select(self._hash().alias("hash"), F.col(self.day).alias("day"))
        # Neighbouring hashes take little room, and runs of one order are quick to compare.
        pairs.repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(folder)
        return [folder]

    def _laid_out(self, df: DataFrame) -> DataFrame:
        # Rebalance, not repartition: rows of a day come together, yet a day that holds a
        # large share of the table is still split into files of the advisory size.
        return conform(df, self.schema).hint("rebalance", F.col(self.day))

    # Versions

    def note(self, spark: SparkSession, **properties: str) -> None:
        """Store properties with the table, in a version of their own if they are new."""
        now = self.snapshot(spark)
        told = {**now.properties, **properties}
        if told != now.properties:
            snapshots.commit(spark, self.path, replace(now, version=now.version + 1, properties=told))

    def restore(self, spark: SparkSession, version: int) -> None:
        """Make an earlier version the newest again. Its folders are shared, not copied."""
        newest = self.snapshot(spark)
        old = self.snapshot(spark, version)
        after = replace(old, version=newest.version + 1)
        snapshots.commit(spark, self.path, after)
        self._point_catalog(spark, newest, after)

    def clone(self, spark: SparkSession, path: str) -> DayTable:
        """A table at ``path`` that begins as this one is now, without copying any data.

        What is written to either is not seen by the other. This table must not ``expire``
        versions that a clone still reads from.
        """
        copy = replace(self, path=path, name=None)
        snapshots.commit(spark, path, replace(self.snapshot(spark), version=1))
        return copy

    def expire(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Forget all but the newest ``keep`` versions; remove and return folders of no other."""
        if keep < 1:
            raise ValueError("the newest version must stay")
        known = snapshots.versions(spark, self.path)
        if not known:
            return []
        kept = [snapshots.load(spark, self.path, v) for v in known[-keep:]]
        live = {f for s in kept for f in [*s.days.values(), *(s.keys or [])]}
        snapshots.drop_versions(spark, self.path, known[:-keep])
        present = []
        for name in snapshots.children(spark, self.path):
            below = f"{self.path}/{name}"
            if name.startswith("gen=") or name == "keys":
                inner = snapshots.children(spark, below)
                present += [f"{below}/{n}" for n in inner if "=" in n]
            elif name.startswith(f"{self.day}="):
                present.append(below)
        gone = [folder for folder in present if folder not in live]
        for folder in gone:
            snapshots.remove(spark, folder)
        for name in snapshots.children(spark, self.path):
            folder = f"{self.path}/{name}"
            if name.startswith("gen=") and not any(f.startswith(f"{folder}/") for f in live):
                snapshots.remove(spark, folder)
        return gone

    # Catalog

    def ensure(self, spark: SparkSession) -> None:
        """Create the namespace and the catalog entry if they are missing."""
        if self.name is None or spark.catalog.tableExists(self.name):
            return
        nothing = spark.createDataFrame([], self.schema)
        if not snapshots.versions(spark, self.path):
            self.change_days(nothing)
        _create(spark, self.name, self.schema, "parquet", self.day, f"LOCATION '{self.path}'")
        self._point_catalog(spark, Snapshot(), self.snapshot(spark))

    def _point_catalog(self, spark: SparkSession, before: Snapshot, after: Snapshot) -> None:
        """Let the catalog entry, where there is one, follow: day by day, as a catalog can."""
        if self.name is None or not spark.catalog.tableExists(self.name):
            return
        for day in before.days.keys() - after.days.keys():
            spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {self._partition(day)}")
        changed = {d: f for d, f in after.days.items() if before.days.get(d) != f}
        for day, folder in changed.items():
            place = f"'{folder}'"
            part = self._partition(day)
            if day in before.days:
                spark.sql(f"ALTER TABLE {self.name} {part} SET LOCATION {place}")
            else:
                spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {part} LOCATION {place}")
        spark.catalog.refreshTable(self.name)

    def _partition(self, day: str) -> str:
        value = "NULL" if day == _NO_DAY else f"DATE'{day}'"
        return f"PARTITION (`{self.day}` = {value})"


def _day_text(day: dt.date | None) -> str:
    return _NO_DAY if day is None else day.isoformat()


@dataclass(frozen=True)
class CatalogTable:
    """A table of a configured catalog, by its one- to three-part name.

    Writing needs a table format with row-level operations; reading works for any.
    ``provider`` names the format to create the table with, if it is missing.
    """

    name: str
    schema: T.StructType
    day: str
    keys: tuple[str, ...]
    null_safe: bool = False
    provider: str | None = None

    @classmethod
    def silver(cls, name: str, provider: str | None = None):
        return cls(name, SILVER, "event_date", ("event_id",), provider=provider)

    @classmethod
    def gold(cls, name: str, provider: str | None = None):
        keys = ("summary_date", "campaign")
        return cls(name, GOLD, "summary_date", keys, null_safe=True, provider=provider)

    def ensure(self, spark: SparkSession) -> None:
        if self.provider is not None and not spark.catalog.tableExists(self.name):
            _create(spark, self.name, self.schema, self.provider, self.day)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def overwrite_days(self, df: DataFrame) -> None:
        conform(df, self.schema).writeTo(self.name).overwritePartitions()

    def replace_all(self, df: DataFrame) -> None:
        conform(df, self.schema).writeTo(self.name).overwrite(F.lit(True))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; wrong names or types are an error."""
    wanted = {f.name: f.dataType for f in schema}
    given = {f.name: f.dataType for f in df.schema}
    if given != wanted:
        odd = sorted(n for n in wanted.keys() | given.keys() if wanted.get(n) != given.get(n))
        raise ValueError(f"frame does not fit the table: columns {odd}")
    return df.select(*schema.fieldNames())


def _create(
    spark: SparkSession, name: str, schema: T.StructType, provider: str, day: str, place: str = ""
) -> None:
    namespace = name.rpartition(".")[0]
    if namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {provider} "
        f"PARTITIONED BY (`{day}`) {place}"
    )
