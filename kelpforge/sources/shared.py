"""The folder that driver and executors share, tables settled in it, and files that only one writer can create."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it names none: a folder of this machine in local mode, an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kelpforge-"))
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within needs none of its shuffles again, so their files are removed as soon as it is written."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def settle_at(df: DataFrame, path: str) -> DataFrame:
    """df written as a compressed table to a new path and read from there, of which later jobs read only the columns that they need."""
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written to the shared folder and read from there: later jobs neither recompute it nor lose it."""
    return settle_at(df, scratch(df.sparkSession, name))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none if it isn't there."""
    fs, at = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def create_once(spark: SparkSession, path: str, body: str = "") -> bool:
    """Creates a small file unless it is there; of several writers exactly one gets True.

    Object stores and HDFS refuse the later writer themselves; on this machine's disk the operating system does, since
    Hadoop's local file system looks first and creates then.
    """
    fs, at = _path(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":
        whole = unquote(urlparse(fs.makeQualified(at).toString()).path)
        own = f"{whole}.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as file:
            file.write(body)
        try:
            os.link(own, whole)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001  what the JVM throws has no class here
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(body, "utf-8"))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a file of a driver's own making."""
    fs, at = _path(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
