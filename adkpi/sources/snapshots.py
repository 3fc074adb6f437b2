"""Which folders make up a table: small version files, switched by one rename.

A version file names the folder of every day (calendar-sized, never per row), the runs of the
table's key index, and a few properties. Writers add new folders first and a version last, so
a reader sees all days of a change or none, and a run that dies leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

_FOLDER = "_versions"


class ConcurrentWriteError(RuntimeError):
    """Another writer made the version this one was about to make."""


@dataclass(frozen=True)
class Snapshot:
    """``days``: day (partition text) -> folder, absolute. ``keys``: index runs, None: no index."""

    version: int = 0
    days: dict[str, str] = field(default_factory=dict)
    keys: list[str] | None = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    names = children(spark, f"{path}/{_FOLDER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def load(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The given version, or the newest; None where the table has no versions."""
    known = versions(spark, path)
    if version is None:
        if not known:
            return None
        version = known[-1]
    elif version not in known:
        raise ValueError(f"{path} has no version {version}, only {known}")
    files, place = _file_system(spark, f"{path}/{_FOLDER}/{version:010d}.json")
    stream = files.open(place)
    try:
        return Snapshot(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> None:
    """Make ``snapshot`` the newest version: written aside, then renamed into place."""
    target = f"{path}/{_FOLDER}/{snapshot.version:010d}.json"
    files, aside = _file_system(spark, f"{path}/{_FOLDER}/.{uuid.uuid4().hex}.tmp")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if files.exists(place):
        raise ConcurrentWriteError(f"{target} is there already")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(asdict(snapshot)).encode()))
    finally:
        stream.close()
    if not files.rename(aside, place):
        files.delete(aside, False)
        raise ConcurrentWriteError(f"{target} could not be put in place")


def drop_versions(spark: SparkSession, path: str, gone: list[int]) -> None:
    for version in gone:
        remove(spark, f"{path}/{_FOLDER}/{version:010d}.json")
