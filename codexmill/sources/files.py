"""Small files: module specifications, backups, revision lists, checksums, byte windows (SRC10-SRC14, SNK16, SNK25, SNK26, F13)."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import tomllib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import _path, file_system, folder

MOST_DEPTH, WINDOW_MOST = 10, 32 * 1024 * 1024


def read_module(path: str) -> dict:
    """SRC10, F13: a TOML specification by TOML's own scoping, checked."""
    with open(path, "rb") as f:
        return check_module(tomllib.load(f))


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: id, name, default_tier, titles of all specifications at a path, parsed where they are read."""

    @F.pandas_udf("id string, name string, default_tier string, titles array<string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        specs = [check_module(tomllib.loads(t)) for t in texts]
        return pd.DataFrame({"id": [x["id"] for x in specs], "name": [x["name"] for x in specs], "default_tier": [x.get("default_tier", "cold") for x in specs], "titles": [x.get("explicit_titles", []) for x in specs]})

    return spark.read.text(path, wholetext=True).select(parse("value").alias("m")).select("m.*")


def check_module(spec: dict) -> dict:
    """id in lower-case letters, digits and '-'; a name; depths up to 10; some content."""
    if not re.fullmatch(r"[a-z0-9-]+", spec.get("id", "")):
        raise ValueError("a module's id has lower-case letters, digits and '-' only")
    if not str(spec.get("name", "")).strip():
        raise ValueError("a module needs a name")
    for c in spec.get("categories", []):
        if not 0 <= int(c.get("depth", 0)) <= MOST_DEPTH:
            raise ValueError(f"a depth lies in 0..{MOST_DEPTH}")
    if not spec.get("categories") and not spec.get("explicit_titles"):
        raise ValueError("a module needs categories or titles")
    return spec


_FOLDER, _MARK = "name string, parent string, created_at bigint", "title string, folder string, note string, created_at bigint"
_BACKUP = f"app string, kind string, format_version bigint, exported_at bigint, folders array<struct<{_FOLDER}>>, bookmarks array<struct<{_MARK}>>"
_FIELDS, _MIDDLE, _END, _HEAD_MOST, _SAMPLED = ["app", "kind", "format_version", "exported_at", "folders"], '],"bookmarks":[', "]}", 4096, 128


def _head(app: str, kind: str, version: int, now: int) -> str:
    """The first line of a backup, up to its first folder."""
    return json.dumps(dict(zip(_FIELDS, (app, kind, version, now, []))), ensure_ascii=False, separators=(",", ":"))[:-2]


def _named(record: Column, key: str) -> Column:
    """The JSON of a record that begins with its key, even where that is null; this tells a folder from a bookmark."""
    bare = F.when(record == "{}", F.lit(f'{{"{key}":null}}')).otherwise(F.concat(F.lit(f'{{"{key}":null,'), F.substring(record, 2, 2**31 - 1)))
    return F.when(record.startswith(f'{{"{key}":'), record).otherwise(bare)


def _by_lines(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame] | None:
    """(head, folders, bookmarks) of a file laid out by write_backup(), a record a line, read in many tasks; None for any other file.

    All lines are looked at first: each has to be what its own record is written as, and in its place.
    """
    p, fs = _path(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return None
    f = fs.open(p)
    first = bytes(f.readNBytes(_HEAD_MOST)).decode("utf-8", "replace").split("\n")[0]
    f.close()
    try:
        head = json.loads(first + _END)
    except ValueError:
        return None
    if not isinstance(head, dict) or list(head) != _FIELDS or [type(head[k]) for k in _FIELDS] != [str, str, int, int, list] or _head(*(head[k] for k in _FIELDS[:4])) != first:
        return None
    follows = F.col("value").startswith(",")
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")  # rises along the file
    text = spark.read.text(path)
    line = F.when(follows, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("line")
    looked, read = [], []
    for key, schema in (("name", _FOLDER), ("title", _MARK)):
        own, record = F.col("line").startswith(f'{{"{key}":'), F.from_json("line", schema)
        looked += [F.count_if(own & (_named(F.to_json(record), key) == F.col("line"))), F.count_if(own & ~F.col("follows")), F.min(F.when(own, F.col("at"))), F.max(F.when(own, F.col("at"))), F.min(F.when(own & ~F.col("follows"), F.col("at")))]
        read.append(text.select(line).where(own).select(record.alias("r")).select("r.*"))
    for x in (first, _MIDDLE, _END):
        looked += [F.count_if(F.col("value") == x), F.min(F.when(F.col("value") == x, F.col("at")))]
    folders, folders1, f_min, f_max, f_first, marks, marks1, m_min, m_max, m_first, heads, h_at, middles, mid_at, ends, e_at, n = text.select("value", line, follows.alias("follows"), at).agg(*looked, F.count("*")).first()
    if (heads, middles, ends) != (1, 1, 1) or folders + marks + 3 != n or (folders1, marks1) != (min(folders, 1), min(marks, 1)) or (f_min, m_min) != (f_first, m_first):
        return None
    places = [h_at, *([f_min, f_max] if folders else []), mid_at, *([m_min, m_max] if marks else []), e_at]
    return (head, *read) if places == sorted(places) else None


def read_backup(spark: SparkSession, path: str, app: str, kind: str, known_version: int = 1) -> tuple[DataFrame, DataFrame, bool]:
    """SRC11: (folders, bookmarks, is it of a newer version); unknown fields are ignored.

    Files written by write_backup() are read in parts of any number, others as one JSON document by one task.
    """
    laid = _by_lines(spark, path)
    if laid:
        head, folders, marks = laid
    else:
        b = spark.read.option("multiLine", True).schema(_BACKUP).json(path)
        head, folders, marks = b.select("app", "kind", "format_version").first(), b.select(F.inline("folders")), b.select(F.inline("bookmarks"))
    if head is None or head["format_version"] is None:
        raise ValueError("no backup: an integer format_version is missing")
    if head["app"] not in (None, app) or head["kind"] not in (None, kind):
        raise ValueError("a backup of something else")
    return folders, marks, head["format_version"] > known_version


def write_backup(rows: DataFrame, expected: int, path: str, app: str, kind: str, now: int, version: int = 1) -> str:
    """SNK16: writes export_rows() as one file, first beside it and then in its place.

    Refuses a partial export. A folder gets a default file name. Tasks sort and write the records into
    a shared folder, a record a line; these parts are then copied one after another, in small blocks.
    """
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) and os.path.isdir(path):
        path = os.path.join(path, f"{kind}-{now}.json")
    spark = rows.sparkSession
    parts = f"{folder(spark)}/_next-{uuid.uuid4().hex}"
    record = F.when(F.col("kind") == "folder", _named(F.col("json"), "name")).otherwise(_named(F.col("json"), "title"))
    p, fs = _path(spark, parts)
    try:
        placed = rows.repartitionByRange("kind", F.substring("json", 1, _SAMPLED)).sortWithinPartitions("kind", "json")  # in the order of whole records, of which only the beginnings are sampled
        placed.select("kind", F.concat(F.lit(","), record).alias("value")).write.partitionBy("kind").option("compression", "gzip").text(parts)
        found = spark.read.schema("value string, kind string").text(parts).where("kind = 'bookmark'").count()
        if found < expected:
            raise ValueError(f"{found} of {expected} bookmarks read; nothing written")
        with _replacing(spark, path) as out:
            out.write(bytearray(f"{_head(app, kind, version, now)}\n".encode()))
            _append(spark, f"{parts}/kind=folder", out)
            out.write(bytearray(f"{_MIDDLE}\n".encode()))
            _append(spark, f"{parts}/kind=bookmark", out)
            out.write(bytearray(f"{_END}\n".encode()))
    finally:
        fs.delete(p, True)
    return path


def _append(spark: SparkSession, where: str, out) -> None:
    """Copies a folder's parts in the order of their rows, without the comma before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, fs = _path(spark, where)
    if not fs.exists(p):
        return
    parts = {x.getPath().getName(): x.getPath() for x in fs.listStatus(p)}
    first = True
    for name in sorted((k for k in parts if k.startswith("part-")), key=lambda k: (int(k.split("-")[1]), k)):
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(parts[name])
        f = codec.createInputStream(fs.open(parts[name]))
        if not first or f.read() >= 0:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(f, out, 1 << 20, False)
            first = False
        f.close()


@contextmanager
def _replacing(spark: SparkSession, path: str):
    """A stream for a new file, which then takes the place of ``path``; nothing is left if that fails. A path without scheme is one of this machine."""
    far = bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path))
    if far:
        (p, fs), (tmp, _) = _path(spark, path), _path(spark, f"{path}._next")
    else:
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).getRaw()
        p, tmp = (jvm.org.apache.hadoop.fs.Path(os.path.abspath(x)) for x in (path, f"{path}._next"))
    out = fs.create(tmp, True)
    try:
        yield out
        out.close()
    except BaseException:
        out.close()
        fs.delete(tmp, False)
        raise
    if far:
        fs.delete(p, False)  # here the renaming replaces it
    if not fs.rename(tmp, p):
        raise OSError(f"{path} could not be written")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any file system, written beside its place first."""
    p, fs = _path(spark, path)
    tmp, _ = _path(spark, f"{path}._next")
    f = fs.create(tmp, True)
    f.write(bytearray(text.encode()))
    f.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"{path} could not be written")


def _replace(path: str, text: str) -> None:
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def load_settings(path: str, defaults: dict) -> dict:
    """SNK26: known keys over the defaults; a missing or corrupt file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return defaults | {k: v for k, v in got.items() if k in defaults}
    except (OSError, ValueError, AttributeError):
        return dict(defaults)


def save_settings(path: str, settings: dict) -> None:
    _replace(path, json.dumps(settings, indent=2))


_REVISIONS = "struct<query: struct<pages: array<struct<missing: string, revisions: array<struct<revid: bigint, parentid: bigint, minor: boolean, user: string, timestamp: string, size: bigint, comment: string>>>>>>"


def parse_revisions(responses: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """SRC12: the revisions of the first page of each response, absent fields defaulted; missing pages give none."""
    x = responses.select(*keep, F.from_json(column, _REVISIONS).alias("r")).withColumn("p", F.get("r.query.pages", F.lit(0)))
    x = x.where("p is not null and p.missing is null").select(*keep, F.explode("p.revisions").alias("v"))
    z = lambda c, d: F.coalesce(f"v.{c}", F.lit(d)).alias(c)
    return x.select(*keep, z("revid", 0), z("parentid", 0), z("minor", False), z("user", ""), z("timestamp", ""), z("size", 0), z("comment", ""))


def sha1_of(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: path, sha1 of the files at a path, of any size: each is read in blocks by one task."""
    files = spark.read.format("binaryFile").load(path).select("path")  # lists them; no content is read

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            found = []
            for name in x["path"]:
                where, base = file_system(name)
                digest = hashlib.sha1()
                with where.open_input_file(base) as f:
                    while block := f.read(1 << 23):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield pd.DataFrame({"path": x["path"], "sha1": found})

    return files.mapInPandas(run, "path string, sha1 string")


def verify_sha1(files: DataFrame, wanted: str) -> DataFrame:
    return files.select("path", (F.lower("sha1") == wanted.lower()).alias("ok"))


def read_window(path: str, first: int, last: int) -> bytes:
    """SRC14: the bytes of a range, at most 32 MiB."""
    if last - first + 1 > WINDOW_MOST:
        raise ValueError("the range is too large; ask for less")
    with open(path, "rb") as f:
        f.seek(first)
        return f.read(last - first + 1)


def zstd_compress(c: Column | str, level: int = 9) -> Column:
    """SNK25."""

    @F.pandas_udf(T.BinaryType())
    def run(v: pd.Series) -> pd.Series:
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        return v.map(lambda x: None if x is None else z.compress(x.encode()))

    return run(c)


def zstd_decompress(c: Column | str, most: int = 50 * 1024 * 1024) -> Column:
    """SNK25: an error if the text would be larger than ``most`` bytes."""

    @F.pandas_udf(T.StringType())
    def run(v: pd.Series) -> pd.Series:
        import zstandard

        z = zstandard.ZstdDecompressor()

        def one(x: bytes | None) -> str | None:
            if x is None:
                return None
            with z.stream_reader(x) as r:
                out = r.read(most + 1)
            if len(out) > most:
                raise ValueError("a text is too large")
            return out.decode()

        return v.map(one)

    return run(c)
