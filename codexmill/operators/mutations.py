"""Table changes as pure functions (current, change) -> new table (SNK1-SNK10, SNK17-SNK21).

Each is one outer join on the key, with the change reduced to one row per key first (the last in
``seq`` wins). The caller writes the result as the next version of the table; nothing is updated in
place, so readers of the old version are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..curated import latest
from .lookup import TIERS


class NotFound(ValueError):
    """The key that a change names is not in the table."""


def upsert(current: DataFrame, change: DataFrame, keys: list[str], replace: list[str], seq: str | None = None, now: Column | None = None, insert: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``change`` replace the columns ``replace`` where the keys exist, else are inserted.

    ``seq`` orders changes to one key. ``now`` goes into updated_at. ``insert`` gives columns of new
    rows that the change does not have; others are null.
    """
    insert = insert or {}
    change = change.select(*keys, *replace, *([seq] if seq else []))
    change = latest(change, keys, [seq] if seq else []).select(*(F.col(k) for k in keys), *(F.col(c).alias(f"_n_{c}") for c in replace), F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(change, keys, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in replace:
            return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        if c == "updated_at" and now is not None:
            return F.when(F.col("_new"), now).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(insert.get(c, F.lit(None))).alias(c)

    return both.select(*(value(c) for c in current.columns))


def title_collisions(articles: DataFrame) -> DataFrame:
    """Titles of more than one page; a batch that makes any must fail as a whole."""
    return articles.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


def check_titles(articles: DataFrame) -> DataFrame:
    bad = title_collisions(articles).limit(3).collect()
    if bad:
        raise ValueError(f"titles of several pages, such as {bad[0]['title']!r}")
    return articles


def upsert_metadata(articles: DataFrame, change: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """SNK1: replaces title, tier, pinned, offset, length, revision; reading history and creation stay.

    A batch that would give one title to several pages fails as a whole, before anything is written.
    """
    columns = ["title", "tier", "pinned", "stream_offset", "stream_length", "revision_id"]
    return check_titles(upsert(articles, change, ["page_id"], columns, seq, now, {"last_accessed": F.lit(0), "access_count": F.lit(0), "created_at": now, "updated_at": now}))


def batch_upsert_cold(articles: DataFrame, change: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """SNK2: new pages come in cold and unpinned; of known ones only title and offset change. Titles stay unique, as in SNK1."""
    new = {"tier": F.lit("cold"), "pinned": F.lit(False), "last_accessed": F.lit(0), "access_count": F.lit(0), "created_at": now, "updated_at": now}
    return check_titles(upsert(articles, change, ["page_id"], ["title", "stream_offset"], seq, now, new))


def upsert_geotags(tags: DataFrame, change: DataFrame, seq: str | None = None) -> DataFrame:
    """SNK3."""
    return upsert(tags, change, ["page_id", "lat", "lon"], ["primary_", "kind"], seq)


def upsert_categorylinks(links: DataFrame, change: DataFrame, seq: str | None = None) -> DataFrame:
    """SNK4."""
    return upsert(links, change, ["cl_from", "cl_to"], ["cl_type"], seq)


def upsert_redirects(redirects: DataFrame, change: DataFrame, seq: str | None = None) -> DataFrame:
    """SNK5."""
    return upsert(redirects, change, ["from_page_id"], ["target_title"], seq)


def upsert_embeddings(embeddings: DataFrame, change: DataFrame, seq: str | None = None) -> DataFrame:
    """SNK6: one row a page, whatever the model."""
    return upsert(embeddings, change, ["page_id"], ["embedding", "model"], seq)


def _require(df: DataFrame, condition: Column, what: str) -> None:
    if df.where(condition).isEmpty():
        raise NotFound(what)


def set_tier(articles: DataFrame, hot: DataFrame, warm: DataFrame, page_id: int, tier: str, text: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK7: (articles, hot, warm) after a page moves; hot and warm need a text, cold a stored offset."""
    if tier not in TIERS:
        raise ValueError(f"no tier {tier!r}")
    here = F.col("page_id") == page_id
    _require(articles, here, f"page {page_id}")
    if tier in ("hot", "warm") and text is None:
        raise ValueError(f"{tier} needs a text")
    if tier == "cold":
        _require(articles, here & F.col("stream_offset").isNotNull(), f"stream offset of page {page_id}")
    hot, warm = hot.where(~here), warm.where(~here)
    if tier in ("hot", "warm"):
        row = articles.sparkSession.createDataFrame([(page_id, text)], "page_id bigint, wikitext string")
        hot, warm = (hot.unionByName(row), warm) if tier == "hot" else (hot, warm.unionByName(row))
    return articles.withColumn("tier", F.when(here, tier).otherwise(F.col("tier"))), hot, warm


def pin(articles: DataFrame, page_id: int, pinned: bool) -> DataFrame:
    """SNK8."""
    here = F.col("page_id") == page_id
    _require(articles, here, f"page {page_id}")
    return articles.withColumn("pinned", F.when(here, F.lit(pinned)).otherwise(F.col("pinned")))


def touch_all(articles: DataFrame, log: DataFrame) -> DataFrame:
    """SNK9, ST4: reading history after a log of (page_id, at); pages not in the table are ignored."""
    seen = log.groupBy("page_id").agg(F.max("at").alias("_at"), F.count("*").alias("_n"))
    a = articles.join(seen, "page_id", "left")
    return a.withColumn("last_accessed", F.greatest("last_accessed", "_at")).withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_at", "_n")


def clear_history(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK10: (articles without history, one row n with the number of pages that had any)."""
    had = (F.col("last_accessed") > 0) | (F.col("access_count") > 0)
    cleared = articles.withColumn("last_accessed", F.lit(0).cast("bigint")).withColumn("access_count", F.lit(0).cast("bigint"))
    return cleared, articles.agg(F.count_if(had).alias("n"))


def save_revisions(stored: DataFrame, change: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """SNK17: (title, revision_id) is the key; id and fetched_at of a known one stay."""
    new = {"fetched_at": now, "id": F.xxhash64("title", "revision_id")}
    return upsert(stored, change, ["title", "revision_id"], ["wikitext", "user_note"], seq, None, new)


def delete_rows(table: DataFrame, key: str, value) -> DataFrame:
    """SNK18: without the row of a key, which must be there."""
    _require(table, F.col(key) == value, f"{key} {value}")
    return table.where(F.col(key) != value)


def install_module(modules: DataFrame, members: DataFrame, spec: dict, now: int) -> tuple[DataFrame, DataFrame]:
    """SNK19: the module is added or replaced (its first installed_at stays), its members are replaced."""
    spark = modules.sparkSession
    row = spark.createDataFrame([(spec["id"], spec["name"], spec.get("default_tier", "cold"))], "id string, name string, default_tier string")
    modules = upsert(modules, row, ["id"], ["name", "default_tier"], None, None, {"installed_at": F.lit(now).cast("bigint")})
    titles = sorted(set(spec.get("explicit_titles", [])))
    new = spark.createDataFrame([(spec["id"], t) for t in titles], "module_id string, title string")
    return modules, members.where(F.col("module_id") != spec["id"]).unionByName(new)


def uninstall_module(modules: DataFrame, members: DataFrame, module_id: str) -> tuple[DataFrame, DataFrame]:
    """SNK20: without the module and its members."""
    return delete_rows(modules, "id", module_id), members.where(F.col("module_id") != module_id)
