"""Helpers shared by operators that need more than one Spark job: shared scratch tables and plan sizes."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package even if the driver found it by sys.path alone."""
    home = str(Path(__file__).resolve().parents[1])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, held] if held else [home])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where the session has none (tests on one machine), a local
    temporary folder is set; on a cluster the setting must be present.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Spark's own setting: an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writing = threading.Lock(), {}


def cleaned(spark: SparkSession):
    """Turns the session's _CLEANUP on while any thread writes here, and back after the last one."""
    return _held(spark, _CLEANUP, "true")


def split(spark: SparkSession, size: int):
    """Files are read in tasks of so many bytes while any thread is in here; a task has whole row groups, see publish()."""
    return _held(spark, "spark.sql.files.maxPartitionBytes", str(size))


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    with _lock:
        n, held = _writing.get((id(spark), key), (0, None))
        if n == 0:
            held = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _writing[id(spark), key] = n + 1, held
    try:
        yield
    finally:
        with _lock:
            n, held = _writing[id(spark), key]
            if n > 1:
                _writing[id(spark), key] = n - 1, held
            else:
                del _writing[id(spark), key]
                if held is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The rows are in the table then, so the shuffle files that led to it are deleted at once.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Hadoop's names of stores that pyarrow knows by others.
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "abfs": "abfss"}


def arrow_store(path: str):
    """(file system, path) of a URI or plain path, for Python on any machine."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if not mark:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{_ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


def discard(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        remove(df.sparkSession, path.rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a file scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return
