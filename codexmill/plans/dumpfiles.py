"""Dump files made from the tables, so that queries go the whole way through the real readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import curated as C
from ..sources import dumps as D
from ..store import folder, place, written


def new_folder(s: SparkSession) -> str:
    return f"{folder(s)}/dump-{uuid.uuid4().hex}"


def index_lines(s: SparkSession, d: str) -> DataFrame:
    a = C.articles(s, d).where("stream_offset is not null")
    return a.select(F.concat_ws(":", "stream_offset", "page_id", "title").alias("value"))


def index_file(s: SparkSession, d: str) -> str:
    """A folder of bz2 files of index lines."""
    return written(s, place(s, d, "dump-index", ["articles"]), lambda to: index_lines(s, d).write.option("compression", "bzip2").text(to))


def pages(s: SparkSession, d: str) -> DataFrame:
    return C.articles(s, d).select("page_id", "title", "revision_id", F.concat(F.lit("See ["), "title", F.lit("] & <more>")).alias("wikitext"))


def multistream(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    """(index, folder) of a multistream dump of all articles."""
    where = place(s, d, "dump-pages", ["articles"])
    written(s, where, lambda to: D.write_multistream(pages(s, d), f"{to}/streams").write.parquet(f"{to}/index"))
    return s.read.parquet(f"{where}/index"), f"{where}/streams"


def _quoted(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    x = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), x, F.lit("'")))


def _tuple(*fields: Column | str) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))


def _statements(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Some twenty tuples a statement, and before each of them one of another table."""
    x = rows.groupBy(F.floor(F.col(key) / 20).alias("g")).agg(F.concat_ws(",", F.collect_list("t")).alias("t"))
    own = F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), "t")
    x = x.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # as the blocks of a large dump would be
    return x.select(F.explode(F.array(F.concat(F.lit("INSERT INTO `other` VALUES (1,'"), "g", F.lit("')")), own)).alias("value"))


def geo_statements(s: SparkSession, d: str, kind: Column | None = None) -> DataFrame:
    """The geotags, and after each a tuple out of range and one that is short."""
    n = F.lit("NULL")
    kind = F.col("kind") if kind is None else kind
    t = _tuple(F.lit("1"), "page_id", F.lit("'earth'"), F.when(F.col("primary_"), "1").otherwise("0"), "lat", "lon", F.lit("1000"), _quoted(kind), F.lit("'Saint ''X\\\\'', (a)'"), n, n)
    return _statements(C.geotags(s, d).select("page_id", F.concat(t, F.lit(",(1,2,'earth',1,999,0,1,NULL,'',NULL,NULL),(1,2,3)")).alias("t")), "geo_tags", "page_id")


def link_statements(s: SparkSession, d: str, kind: Column | None = None) -> DataFrame:
    """The category links, and after each one of an unknown type and one without a name."""
    kind = F.col("cl_type") if kind is None else kind
    t = _tuple("cl_from", _quoted("cl_to"), F.lit("'KEY; (x)'"), F.lit("'2024-01-01 00:00:00'"), F.lit("''"), F.lit("'uca-default'"), _quoted(kind))
    more = F.concat(F.lit(",("), "cl_from", F.lit(",'Other','','','','','portal'),("), "cl_from", F.lit(",'','','','','','page')"))
    return _statements(C.categorylinks(s, d).select("cl_from", F.concat(t, more).alias("t")), "categorylinks", "cl_from")


def redirect_statements(s: SparkSession, d: str, target: Column | None = None) -> DataFrame:
    """The redirects, and after each one out of the main namespace, one to another wiki and one to nothing."""
    target = F.col("target_title") if target is None else target
    t = _tuple("from_page_id", F.lit("0"), _quoted(F.translate(target, " ", "_")), F.lit("''"), F.lit("''"))
    more = [F.concat(F.lit(",("), "from_page_id", F.lit(x)) for x in (",1,'Talk','','')", ",0,'Far','de','')", ",0,'_','','')")]
    return _statements(C.redirects(s, d).select("from_page_id", F.concat(t, *more).alias("t")), "redirect", "from_page_id")


def table_file(s: SparkSession, d: str, name: str, source: str, statements: DataFrame) -> str:
    """The statements as gz files; an address that names them all."""
    lines = statements.select(F.concat("value", F.lit(";")).alias("value"))
    return written(s, place(s, d, f"dump-{name}", [source]), lambda to: lines.write.option("compression", "gzip").text(to)) + "/*.gz"
