"""Bookmarks, folders, stored revisions and modules (Q9-Q12, Q14, Q15, A7, A11, SNK11-SNK16, J8, J10, J11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from ..session import cut
from .lookup import clamp


def is_bookmarked(bookmarks: DataFrame, titles: DataFrame) -> DataFrame:
    """Q9: (title) -> (title, bookmarked), in whatever folder."""
    there = bookmarks.select(F.col("article_title").alias("title"), F.lit(True).alias("_b")).distinct()
    return titles.select("title").join(there, "title", "left").select("title", F.coalesce("_b", F.lit(False)).alias("bookmarked"))


def in_folder(bookmarks: DataFrame, folder_id: int | None, limit: int = 1000) -> DataFrame:
    """Q10: a folder's bookmarks (None: the unfiled), newest first."""
    return bookmarks.where(F.col("folder_id").eqNullSafe(F.lit(folder_id))).orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 1, 1_000_000))


def all_bookmarks(bookmarks: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Q11: newest first."""
    return bookmarks.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 1, 1_000_000))


def list_folders(folders: DataFrame) -> DataFrame:
    """Q12: by name, ASCII case folded."""
    return folders.orderBy(ascii_fold("name"), "id")


def folder_tally(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks per folder, 'unfiled' and the 'total'."""
    key = F.coalesce(F.col("folder_id").cast("string"), F.lit("unfiled")).alias("folder")
    t = bookmarks.select(key).rollup("folder").agg(F.count("*").alias("n"))
    return t.select(F.coalesce("folder", F.lit("total")).alias("folder"), "n")


def add_bookmarks(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """SNK11, J10: those not there yet by (title, folder), no folder being a folder of its own."""
    new = new.dropDuplicates(["article_title", "folder_id"])
    known = bookmarks.select(F.col("article_title").alias("_t"), F.col("folder_id").alias("_f"))
    fresh = new.join(known, (F.col("article_title") == F.col("_t")) & F.col("folder_id").eqNullSafe(F.col("_f")), "left_anti")
    return bookmarks.unionByName(fresh)


def remove_bookmarks(bookmarks: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK12: unknown ids are ignored."""
    return bookmarks.join(ids.select("id"), "id", "left_anti")


def move_bookmarks(bookmarks: DataFrame, moves: DataFrame) -> DataFrame:
    """SNK12: (id, folder_id) pairs give bookmarks a new folder."""
    m = moves.select("id", F.col("folder_id").alias("_f"), F.lit(True).alias("_m"))
    return bookmarks.join(m, "id", "left").withColumn("folder_id", F.when(F.col("_m"), F.col("_f")).otherwise(F.col("folder_id"))).drop("_f", "_m")


def create_folder(folders: DataFrame, new: DataFrame) -> DataFrame:
    """SNK13."""
    return folders.unionByName(new)


def rename_folder(folders: DataFrame, folder_id: int, name: str) -> DataFrame:
    """SNK13."""
    return folders.withColumn("name", F.when(F.col("id") == folder_id, F.lit(name)).otherwise(F.col("name")))


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the given folders and all below them; cycles end by themselves."""
    found = cut(roots.select("id").distinct())
    new = found
    while True:
        kids = folders.select("id", "parent_id").join(new.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        new = cut(kids.join(found, "id", "left_anti"))
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new))


def delete_folders(folders: DataFrame, bookmarks: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK14: the folders and all below go; their bookmarks become unfiled."""
    gone = descendants(folders, roots)
    b = bookmarks.join(gone.select(F.col("id").alias("folder_id"), F.lit(True).alias("_g")), "folder_id", "left")
    b = b.withColumn("folder_id", F.when(F.col("_g").isNull(), F.col("folder_id"))).select(*bookmarks.columns)
    return folders.join(gone, "id", "left_anti"), b


def import_bookmarks(folders: DataFrame, bookmarks: DataFrame, new_folders: DataFrame, new_bookmarks: DataFrame, wipe: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK15, J11: (folders, bookmarks, one row of counters) after an import of named folders.

    ``new_folders`` (name, parent, created_at) merge into folders of the same name, names compared in
    Unicode lower case; every such row counts as merged. The others are made below their parents,
    parents first; of one name the row that can be made first counts, of equals the earliest. When
    no further folder can be made, all that are left (orphans, their children, cycles) become roots.
    ``new_bookmarks`` (title, folder, note, created_at) go unfiled if their folder is unknown, and are
    skipped if (title, folder) is there already. A user's folders are few; ids are hashes of names.
    """
    if wipe:
        folders, bookmarks = folders.limit(0), bookmarks.limit(0)
    known = cut(folders.where("name is not null").groupBy(F.lower("name").alias("_k")).agg(F.min("id").alias("id")))
    incoming = new_folders.where("name is not null").select(F.lower("name").alias("_k"), F.lower("parent").alias("_p"), "name", "created_at")
    merged = incoming.join(known, "_k", "left_semi")
    pending = cut(incoming.join(known, "_k", "left_anti"))
    new_id = F.abs(F.xxhash64("_k")).alias("id")

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_k").agg(F.min(F.struct("created_at", "name", "parent_id")).alias("f")).select("_k", "f.name", "f.parent_id", "f.created_at", new_id)

    ids, made = known, None
    while True:
        top = pending.where("_p is null").withColumn("parent_id", F.lit(None).cast("bigint"))
        below = pending.join(ids.select(F.col("_k").alias("_p"), F.col("id").alias("parent_id")), "_p")
        step = cut(first(top.unionByName(below).join(ids.select("_k"), "_k", "left_anti")))
        if step.isEmpty():
            break
        made = step if made is None else made.unionByName(step)
        ids = cut(ids.unionByName(step.select("_k", "id")))
    rest = cut(first(pending.withColumn("parent_id", F.lit(None).cast("bigint")).join(ids.select("_k"), "_k", "left_anti")))
    made = rest if made is None else made.unionByName(rest)
    ids = ids.unionByName(rest.select("_k", "id"))
    out_folders = folders.unionByName(made.select("id", "name", "parent_id", "created_at"))
    b = new_bookmarks.withColumn("_k", F.lower("folder")).join(ids.select("_k", F.col("id").alias("folder_id")), "_k", "left")
    b = b.select(F.col("title").alias("article_title"), "folder_id", "note", "created_at")
    total = b.count()
    one = b.groupBy("article_title", "folder_id").agg(F.min(F.struct("created_at", "note")).alias("x")).select("article_title", "folder_id", "x.note", "x.created_at")
    seen = bookmarks.select(F.col("article_title").alias("_t"), F.col("folder_id").alias("_f"))
    one = cut(one.join(seen, (F.col("article_title") == F.col("_t")) & F.col("folder_id").eqNullSafe(F.col("_f")), "left_anti"))
    one = one.withColumn("id", F.abs(F.xxhash64("article_title", "folder_id", "created_at")))
    added = one.count()
    counters = folders.sparkSession.createDataFrame([(made.count(), merged.count(), added, total - added)], "folders_added bigint, folders_merged bigint, bookmarks_added bigint, bookmarks_skipped bigint")
    return out_folders, bookmarks.unionByName(one.select(*bookmarks.columns)), counters


def export_rows(folders: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """SNK16, J11: (kind, json) of every folder and bookmark, ids replaced by names."""
    names = folders.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    f = folders.join(names, folders["parent_id"] == names["_id"], "left")
    f = f.select(F.lit("folder").alias("kind"), F.to_json(F.struct("name", F.col("_name").alias("parent"), "created_at")).alias("json"))
    b = bookmarks.join(names, bookmarks["folder_id"] == names["_id"], "left")
    return f.unionByName(b.select(F.lit("bookmark").alias("kind"), F.to_json(F.struct(F.col("article_title").alias("title"), F.col("_name").alias("folder"), "note", "created_at")).alias("json")))


def list_revisions(stored: DataFrame) -> DataFrame:
    """Q14: the archive without texts, newest first."""
    return stored.select("id", "title", "revision_id", "fetched_at", "user_note").orderBy(F.desc("fetched_at"), F.desc("id"))


def revisions_of(stored: DataFrame, title: str) -> DataFrame:
    """Q14: of one title, last revision first."""
    return list_revisions(stored).where(F.col("title") == title).orderBy(F.desc("revision_id"))


def list_modules(modules: DataFrame, members: DataFrame) -> DataFrame:
    """By name, with the number of members (0 kept)."""
    n = members.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("n"))
    return modules.join(n, "id", "left").select("id", "name", "default_tier", "installed_at", F.coalesce("n", F.lit(0)).cast("bigint").alias("member_count")).orderBy("name", "id")


def owners_of(members: DataFrame, modules: DataFrame, titles: Column) -> DataFrame:
    """Q15: (title, id, name) of the modules that hold the titles selected."""
    return members.where(titles).join(modules.select(F.col("id").alias("module_id"), "name"), "module_id").select("title", F.col("module_id").alias("id"), "name")
