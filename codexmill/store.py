"""Derived tables, written once for each state of their sources and then read.

A derived table (a cleaned one, an index) is a Parquet folder in a folder that all executors share:
``spark.codexmill.tables`` where it is set, to keep tables over sessions, else a part of the
session's checkpoint folder. Its name holds a digest of where its sources lie, how large they are
and when they last changed, so a changed source makes a new table and readers of the old one are
not disturbed. It is written whole beside its place and then renamed.

Rows are clustered by the columns a reader filters on: ranges of them make the files, and within a
file rows are sorted, so the statistics of files, row groups and pages prune the scan. Ranges are
taken over all the columns given, so one key with very many rows is spread over several files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_system(path: str):
    """(file system, name in it) of a path or an address such as hdfs: or s3:, for tasks that read or write files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.codexmill.tables", None) or f"{ensure_checkpoint_dir(spark)}/tables"


def _state(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    size = fs.getContentSummary(p)
    return f"{path} {size.getLength()} {size.getFileCount()} {fs.getFileStatus(p).getModificationTime()}"


def place(spark: SparkSession, sf_dir: str, name: str, sources: list[str]) -> str:
    """Where something derived from tables of a data folder lies, as they are now."""
    states = "\n".join(_state(spark, f"{sf_dir}/{t}.parquet") for t in sources)
    return f"{folder(spark)}/{name}-{hashlib.md5(states.encode()).hexdigest()}"


def written(spark: SparkSession, where: str, write: Callable[[str], None]) -> str:
    """A folder of files, written whole beside its place and renamed, unless it is there."""
    p, fs = _path(spark, where)
    if not fs.exists(p):
        tmp, _ = _path(spark, f"{folder(spark)}/_next-{uuid.uuid4().hex}")
        write(tmp.toString())
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(tmp, p):  # another session was faster
            fs.delete(tmp, True)
    return where


def stored(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build: Callable[[], DataFrame], by: list[str]) -> DataFrame:
    """The derived table ``name`` of tables of a data folder, built if it is not there yet."""
    where = place(spark, sf_dir, name, sources)
    known = spark.sparkContext.__dict__.setdefault("_codexmill_tables", {})
    p, fs = _path(spark, where)
    if where in known and fs.exists(p):
        return known[where]
    written(spark, where, lambda to: build().repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(to))
    known[where] = spark.read.parquet(where)
    return known[where]
