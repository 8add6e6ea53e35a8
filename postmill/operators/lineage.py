"""Shared folders: cutting lineage in iterative jobs and staging files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


# Temporary folders of local sessions that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[name] = tempfile.mkdtemp(prefix="postmill-")
    return _LOCAL_FOLDERS[name]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def observed(seen: Observation) -> dict[str, int]:
    """Metrics of a frame that ran; empty where Spark left the frame out because no row could come of it."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    The plan is computed once, a lost executor costs only its own task, and the
    files give the next join real sizes to choose its strategy by.
    """
    return _written(df, staging_path(df.sparkSession, "step"))


# Spark deletes the shuffle files of a plan when its action ends; otherwise they stay until the JVM happens to collect them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """The plan of a write runs for this write only, so nobody reads its shuffles again."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``cut_lineage`` for tables that only the steps of this block read: its end deletes them.

    What goes on from there has to be written, by ``cut_lineage`` itself, before the block ends.
    """
    paths: list[str] = []

    def cut(df: DataFrame) -> DataFrame:
        paths.append(staging_path(spark, "step"))
        return _written(df, paths[-1])

    try:
        yield cut
    finally:
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
