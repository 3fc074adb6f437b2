"""Session helpers: the UTC session and the shared folder for staged frames."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A UTC session; everything else is left to the cluster's own settings.

    ``shuffle_partitions`` is the starting number only. Adaptive execution merges small
    partitions, so on a large input choose it high (input bytes / 128 MiB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "134217728",
        # A task reading one day of silver meets every campaign of that day. The default of
        # 128 percentile sketches in memory would make most such tasks sort their rows.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2048",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ZONE = "spark.sql.session.timeZone"


def in_utc(job: Callable[..., Any]) -> Callable[..., Any]:
    """Run a job with the session's time zone at UTC, and put the zone back afterwards.

    Days and hours of events must not depend on the session a job is called in. The job's
    first argument is a session, or a frame of it.
    """

    @wraps(job)
    def run(first: SparkSession | DataFrame, *args: Any, **kwargs: Any) -> Any:
        spark = first if isinstance(first, SparkSession) else first.sparkSession
        before = spark.conf.get(_ZONE)
        spark.conf.set(_ZONE, "UTC")
        try:
            return job(first, *args, **kwargs)
        finally:
            spark.conf.set(_ZONE, before)

    return run


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster that folder
    would exist on one machine alone.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="adkpi-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for what runs inside; ``__`` stands for a dot. Put back afterwards."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not at some later collection.

    For writes whose frame is not run again: what was written takes its place.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_open = threading.local()


@contextmanager
def frames_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames staged inside go when it ends, but for lasting ones.

    For steps whose result is staged as lasting: nothing outside may read the others.
    """
    outer = getattr(_open, "paths", None)
    _open.paths = []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives lost executors, and stays
    columnar, so later passes read only the columns they need. The folder is scratch
    space: the owner of ``spark.checkpoint.dir`` decides when it is emptied. Inside of
    ``frames_dropped`` only ``lasting`` frames stay that long.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/adkpi-{uuid.uuid4().hex}"
    if not lasting and getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
