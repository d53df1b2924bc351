"""Ingest drivers and table versions (SNK21-SNK24, ST7, ST9).

A table is a folder of versions and a small file that names the current one. A new version is
written whole and then named, so readers see the old or the new table and never a mixture, and a
cancelled or failed ingest leaves no trace. Re-ingesting the same file changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dumps
from ..store import _path
from . import mutations as M
from .lookup import without_embedding
from .vectors import embed_titles


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The current version of a table, None if it has none yet."""
    p, fs = _path(spark, f"{table}/CURRENT")
    if not fs.exists(p):
        return None
    return spark.read.parquet(f"{table}/{spark.read.text(str(p)).first()[0]}")


def write_version(df: DataFrame, table: str, by: str | None = None) -> DataFrame:
    """Writes the next version, clustered by a column if given, and makes it the current one."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    out = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
    out.write.parquet(f"{table}/{version}")
    p, fs = _path(spark, f"{table}/CURRENT")
    tmp, _ = _path(spark, f"{table}/_next-{version}")
    f = fs.create(tmp, True)
    f.write(bytearray(version.encode()))
    f.close()
    if not fs.rename(tmp, p):  # a file system that does not rename onto a file
        fs.delete(p, False)
        fs.rename(tmp, p)
    return spark.read.parquet(f"{table}/{version}")


def ingest_index(articles: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """SNK22: the table after an offset index; new pages are cold, titles must stay unique."""
    change = entries.select("page_id", "title", "stream_offset").withColumn("seq", F.col("stream_offset"))
    return M.batch_upsert_cold(articles, change, F.lit(now).cast("bigint"), "seq")


def ingest_table(spark: SparkSession, path: str, dump_table: str, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK23: (the table after a dump of geo_tags, categorylinks or redirect, one row with ``processed``)."""
    project, upsert = {
        "geo_tags": (dumps.geotags_from, M.upsert_geotags),
        "categorylinks": (dumps.categorylinks_from, M.upsert_categorylinks),
        "redirect": (dumps.redirects_from, M.upsert_redirects),
    }[dump_table]
    rows = project(dumps.read_table_dump(spark, path, dump_table))
    return upsert(current, rows), rows.agg(F.count("*").alias("processed"))


def ingest_index_stream(spark: SparkSession, folder: str, table: str, now: int, checkpoint: str):
    """SNK22, ST1: index files as they arrive, each micro-batch one version of the table."""

    def sink(batch: DataFrame, _: int) -> None:
        write_version(ingest_index(read_current(batch.sparkSession, table), dumps.parse_index_lines(batch), now), table, "page_id")

    return spark.readStream.text(folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def backfill_embeddings(articles: DataFrame, embeddings: DataFrame, model: str, embedder: Callable, most: int = 0) -> DataFrame:
    """SNK24, ST9: the embeddings after the pending articles, ``most`` at a time (0: all).

    What is there is told by an anti-join, so a run that was stopped goes on where it was.
    """
    pending = without_embedding(articles, embeddings, model)
    return M.upsert_embeddings(embeddings, embed_titles(pending.limit(most) if most > 0 else pending, model, embedder))
