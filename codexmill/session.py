"""Session helpers: a local session for tests and the shared cut point for iterative plans."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only where that
    is unset (a local session) a temporary folder is set.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codexmill-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The files are replicated or shared storage, so a lost executor costs no recomputation
    of earlier rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, whether or not it is installed where they run.

    The archive is made where the driver runs and handed to Spark at once, which sends it to the
    executors; nothing reads it as shared data.
    """
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_codexmill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not sc.master.startswith("local[") and sc.master != "local":
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="codexmill-"), "codexmill"), "zip", root, "codexmill")
        sc.addPyFile(made)  # Spark sends the file to every executor
    sc._codexmill_shipped = True
