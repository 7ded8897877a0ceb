"""Session helpers shared by all operators: table loading, shared working folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir`` as the cluster sets it.

    Only where that is unset (tests, local mode) a folder of this process is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        at = context.getCheckpointDir()
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="spangraph-")
            context.setCheckpointDir(at)
            atexit.register(_remove_tree, at.removeprefix("file://"))
    return at


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes away with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Cuts the lineage and outlives any executor, unlike a cache or a local checkpoint.
    """
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """What operators write within this block goes away at its end; results that are still needed have to be stored before."""
    begin = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[begin:]:
            remove(spark, path)
        del _written[begin:]


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a URI."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                remove(spark, path)
            elif path.startswith("file://"):
                _remove_tree(path.removeprefix("file://"))
        except Exception:  # the session may already be gone
            pass

