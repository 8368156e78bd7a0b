"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written through and not yet released, by application.
_written: dict[str, list[str]] = {}
#: What holds inside a ``step``: shuffle files go with the job that made them, and written tables are small.
_IN_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def local_session(cores: str = "8", name: str = "pairloom") -> SparkSession:
    """A small session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("pairloom.text.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A single-machine session without that setting gets a fresh temporary folder. A cluster session
    without it is an error: a folder on one machine would be lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, which ``release`` deletes with whatever is written there."""
    path = os.path.join(shared_folder(spark), f"pairloom-{uuid.uuid4().hex}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_through(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df``, and ``more`` of the same columns one after the other, to the shared folder and read it back.

    The result has no lineage, is computed once and survives the loss of any executor. Call
    ``release`` once the results that build on it have been consumed.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    for part in more:
        part.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A step that leaves no more on disk than its results: ``with step(spark) as keep: ...; return keep(result)``.

    Tables written through inside go at its end, but for those written by ``keep``. Shuffle files go
    as soon as the job that made them is done, instead of when the driver collects its garbage.
    """
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    first, kept = len(written), []

    def keep(*parts: DataFrame) -> DataFrame:
        result = write_through(*parts)
        kept.append(written.pop())
        return result

    before = {name: spark.conf.get(name, None) for name in _IN_STEP}
    for name, value in _IN_STEP.items():
        spark.conf.set(name, value)
    try:
        yield keep
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        passed, written[first:] = written[first:], kept
        _delete(spark, passed)


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = hadoop.Path(name)
        path.getFileSystem(conf).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table that was written through, ahead of ``release``, as nothing is to be computed from it any more."""
    spark = table.sparkSession
    written = _written.get(spark.sparkContext.applicationId, [])
    folders = {os.path.basename(os.path.dirname(name)) for name in table.inputFiles()}
    passed = [path for path in written if os.path.basename(path) in folders]
    written[:] = [path for path in written if path not in passed]
    _delete(spark, passed)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written through."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))
