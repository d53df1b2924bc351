"""Dump files: offset index, page XML, table dumps (SRC1-SRC9, SRC16, ST1).

Index and table dumps are read as delimited text, so Spark splits bz2 files by block and streams
gz files; a gz file is one task, so its statements are spread again before they are parsed.
Multistream files are opened where the tasks run, in whatever file system their address names.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, norm_title
from ..session import cut
from ..store import file_system

_INDEX = r"^([0-9]+):([0-9]+):(.*)$"


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC2: stream_offset, page_id, title of 'offset:page_id:title' lines; blank lines are skipped.

    Titles keep their colons. A line of another form is an error, not a skip.
    """
    x = lines.select(F.rtrim(F.col(column), F.lit("\r\n")).alias("v")).where(F.btrim("v") != "")
    ok = F.when(F.col("v").rlike(_INDEX), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("bad index line: "), "v")))
    x = x.select(ok.alias("v"))
    return x.select(F.regexp_extract("v", _INDEX, 1).cast("bigint").alias("stream_offset"), F.regexp_extract("v", _INDEX, 2).cast("bigint").alias("page_id"), F.regexp_extract("v", _INDEX, 3).alias("title"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: an offset index, plain or bz2 of any number of members."""
    return parse_index_lines(spark.read.text(path))


_PAGE = "title string, id string, revision array<struct<id string, text string>>"


def parse_page_xml(chunks: DataFrame, column: str = "value") -> DataFrame:
    """SRC4: page_id, title, revision_id, wikitext of chunks holding one <page> each, its end tag optional.

    Entities are unescaped; ids inside contributors are other elements and do not count. A page
    whose id is no number is an error. Chunks without a page are skipped.
    """
    x = F.regexp_extract(column, r"(?s)(<page\b.*)$", 1)
    x = chunks.select(F.when(x.contains("</page>"), x).otherwise(F.concat(x, F.lit("</page>"))).alias("x"), (x != "").alias("has")).where("has")
    # Attributes of text, such as xml:space, would turn it into a struct.
    x = x.select(F.from_xml(F.regexp_replace("x", r"<(text|page|revision)\s[^>]*?(/?)>", "<$1$2>"), _PAGE, {"ignoreSurroundingSpaces": "false"}).alias("p"))
    rev = F.element_at("p.revision", -1)
    pid = F.btrim("p.id").try_cast("bigint")
    pid = F.when(pid.isNotNull(), pid).otherwise(F.raise_error(F.concat(F.lit("bad page id: "), F.coalesce("p.id", F.lit("none")))).cast("bigint"))
    return x.select(pid.alias("page_id"), F.col("p.title").alias("title"), F.btrim(rev["id"]).try_cast("bigint").alias("revision_id"), F.coalesce(rev["text"], F.lit("")).alias("wikitext"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: all pages of a dump, with a root element or without, also bz2 of many members."""
    return parse_page_xml(spark.read.option("lineSep", "</page>").text(path))


def write_multistream(pages: DataFrame, folder: str, per_stream: int = 100) -> DataFrame:
    """SRC16: pages (page_id, title, revision_id, wikitext) as files of bz2 streams, in order of page_id.

    Every task writes one file of the folder. The result is the index: file, stream_offset,
    stream_length, page_id, title.
    """
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.concat(F.lit("  <page>\n<title>"), esc("title"), F.lit("</title><id>"), "page_id", F.lit("</id><revision><id>"), F.coalesce(F.col("revision_id").cast("string"), F.lit("")), F.lit('</id><text xml:space="preserve">'))
    rows = pages.select("page_id", "title", F.concat(head, esc("wikitext"), F.lit("</text></revision></page>\n")).alias("xml")).repartitionByRange("page_id").sortWithinPartitions("page_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, f, at = f"part-{TaskContext.get().partitionId():05}.xml.bz2", None, 0
        where, base = file_system(folder)
        for x in frames:
            for k in range(0, len(x), per_stream):
                if f is None:
                    where.create_dir(base, recursive=True)
                    f = where.open_output_stream(f"{base}/{name}", compression=None)
                part = x.iloc[k : k + per_stream]
                data = bz2.compress("".join(part["xml"]).encode())
                f.write(data)
                yield pd.DataFrame({"file": name, "stream_offset": at, "stream_length": len(data), "page_id": part["page_id"], "title": part["title"]})
                at += len(data)
        if f is not None:
            f.close()

    return cut(rows.mapInPandas(run, "file string, stream_offset bigint, stream_length bigint, page_id bigint, title string"))


def read_streams(index: DataFrame, path: str) -> DataFrame:
    """SRC3: the pages of the streams an index names, by seeking in the multistream file.

    Offsets are spread over tasks; each stream is decoded once. ``path`` is an address in a file
    system that all executors reach (a path, file:, hdfs:, s3: and others): of the file, or of the
    folder of those that the index names in a column ``file``. A stream_length column, where not
    null, bounds the read.
    """
    length = F.max("stream_length") if "stream_length" in index.columns else F.lit(None).cast("bigint")
    file = F.col("file") if "file" in index.columns else F.lit(None).cast("string")
    offsets = index.groupBy(file.alias("file"), "stream_offset").agg(length.alias("stream_length"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = file_system(path)
        opened: dict = {}
        for x in frames:
            for name, at, n in zip(x["file"], x["stream_offset"], x["stream_length"]):
                name = base if pd.isna(name) else f"{base}/{name}"
                if name not in opened:
                    for f in opened.values():  # one file at a time
                        f.close()
                    opened = {name: where.open_input_file(name)}
                f = opened[name]
                f.seek(int(at))
                left = None if pd.isna(n) else int(n)
                d, parts = bz2.BZ2Decompressor(), []
                while not d.eof:
                    want = 1 << 18 if left is None else min(1 << 18, left)
                    block = f.read(want)
                    if not block:
                        raise EOFError(f"stream at {at} is cut short")
                    left = None if left is None else left - len(block)
                    parts.append(d.decompress(block))
                text = b"".join(parts).decode("utf-8", "replace")
                yield pd.DataFrame({"value": pd.Series([p for p in text.split("</page>") if "<page" in p], dtype=object)})

    return parse_page_xml(offsets.sortWithinPartitions("file", "stream_offset").mapInPandas(run, "value string"))


# Possessive loops neither backtrack nor recurse, so statements of any length are read, in one pass:
# a tuple begins where the one before it ended, and none begins after a ';'.
_QUOTED = r"'(?:[^'\\]++|\\.)*+'"
_TUPLE = rf"(?s)\G[^(;]*+\(((?:[^')]++|{_QUOTED})*+)\)"
_FIELD = rf"(?s),((?:[^',]++|{_QUOTED})*+)"
_SEGMENT = rf"(?s)[^']++|{_QUOTED}"


def _unquoted(x: Column) -> Column:
    """A field without its quotes: within them a backslash takes the next character as it is, elsewhere it is one."""
    inner = lambda v: F.regexp_replace(F.substring(v, 2, 2**31 - 1).substr(F.lit(1), F.length(v) - 2), r"(?s)\\(.)", "$1")
    parts = F.transform(F.regexp_extract_all(x, F.lit(_SEGMENT), F.lit(0)), lambda v: F.when(v.startswith("'"), inner(v)).otherwise(v))
    simple = x.startswith("'") & (F.instr(F.substring(x, 2, 2**31 - 1), "'") == F.length(x) - 1) & ~x.contains("\\")
    text = F.when(~x.contains("'"), x).when(simple, x.substr(F.lit(2), F.length(x) - 2)).otherwise(F.array_join(parts, ""))
    return F.btrim(text, F.lit(WHITE_SPACE))


def insert_tuples(statements: DataFrame, table: str, column: str = "value") -> DataFrame:
    """SRC5, SRC6: one ``fields`` array per tuple of the table's INSERT statements; others are ignored.

    Quotes vanish (doubled ones too) and fields are trimmed. All inside the JVM.
    """
    head = f"INSERT INTO `{table}` VALUES "
    mine = statements.select(F.ltrim(column, F.lit(" \r\n")).alias("v")).where(F.col("v").startswith(head))
    bodies = mine.select(F.explode(F.regexp_extract_all(F.substring("v", len(head) + 1, 2**31 - 1), F.lit(_TUPLE), F.lit(1))).alias("b"))
    # A comma before each field, so that none is an empty match.
    fields = F.regexp_extract_all(F.concat(F.lit(","), "b"), F.lit(_FIELD), F.lit(1))
    return bodies.select(F.transform(fields, _unquoted).alias("fields"))


def read_table_dump(spark: SparkSession, path: str, table: str, spread: int | None = None) -> DataFrame:
    """SRC5: tuples of a dump, plain or gz; a ';' inside quotes ends no statement unless a line ends there.

    A gz file cannot be split, so its statements are dealt out to ``spread`` tasks (as many as a
    shuffle has, if none are given) before they are parsed.
    """
    s = spark.read.option("lineSep", ";\n").text(path)
    if spread is None and path.endswith(".gz"):
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return insert_tuples(s.repartition(spread) if spread else s, table)


def _f(i: int) -> Column:
    return F.get("fields", F.lit(i))


def geotags_from(tuples: DataFrame) -> DataFrame:
    """SRC7: rows with at least six fields and coordinates in range."""
    t = tuples.where(F.size("fields") >= 6).select(
        _f(1).try_cast("bigint").alias("page_id"), _f(4).try_cast("double").alias("lat"), _f(5).try_cast("double").alias("lon"), (_f(3) == "1").alias("primary_"), F.nullif(F.nullif(_f(7), F.lit("")), F.lit("NULL")).alias("kind")
    )
    return t.where("page_id is not null and not isnan(lat) and not isnan(lon) and lat between -90 and 90 and lon between -180 and 180")


def categorylinks_from(tuples: DataFrame) -> DataFrame:
    """SRC8: rows with at least seven fields, a category and a known type."""
    t = tuples.where(F.size("fields") >= 7).select(_f(0).try_cast("bigint").alias("cl_from"), _f(1).alias("cl_to"), _f(6).alias("cl_type"))
    return t.where("cl_from is not null and cl_to not in ('', 'NULL') and cl_type in ('page', 'subcat', 'file')")


def redirects_from(tuples: DataFrame) -> DataFrame:
    """SRC9: main namespace, no interwiki (a literal NULL is one), a target left after normalising."""
    t = tuples.where((F.size("fields") >= 4) & (_f(1).try_cast("int") == 0) & (_f(3) == ""))
    return t.select(_f(0).try_cast("bigint").alias("from_page_id"), norm_title(_f(2)).alias("target_title")).where("from_page_id is not null and target_title <> ''")
