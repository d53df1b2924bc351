"""The engine's tables, cleaned from the raw ones: one current row per key.

Each is written once (see ``store``) and clustered by what it is looked up by, so a lookup reads a
few pages of a few files. ``latest`` keeps, per key, the row that is greatest in the order given. It is an aggregation with a
map-side combine, not a window, so a key with very many rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ascii_fold, norm_title
from .store import stored
from .tables import table


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the greatest row by ``order``, then by all other columns; nulls are least."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def articles(s: SparkSession, d: str) -> DataFrame:
    """Pages that are still there: page_id, title (normalised), tier, pinned, ... ; one row a page. By title."""

    def build() -> DataFrame:
        a = table(s, d, "articles").where("page_id is not null and deleted_at is null").withColumn("title", norm_title("title")).where("title <> ''").drop("deleted_at")
        return latest(a, ["page_id"], ["updated_at", "created_at", "revision_id"])

    return stored(s, d, "articles", ["articles"], build, ["title"])


def folded_titles(s: SparkSession, d: str) -> DataFrame:
    """page_id, title, tier and the title with ASCII case folded. By that."""
    return stored(s, d, "folded_titles", ["articles"], lambda: articles(s, d).select("page_id", "title", "tier", ascii_fold("title").alias("fold")), ["fold"])


def hot_content(s: SparkSession, d: str) -> DataFrame:
    """page_id, wikitext. By page."""

    def build() -> DataFrame:
        h = table(s, d, "hot_content").where("page_id is not null and wikitext is not null")
        return latest(h, ["page_id"], ["loaded_at", "revision_id"]).select("page_id", "wikitext")

    return stored(s, d, "hot_content", ["hot_content"], build, ["page_id"])


def geotag_rows(s: SparkSession, d: str) -> DataFrame:
    """The usable rows, repeated and older ones included."""
    g = table(s, d, "geotags").where("page_id is not null and lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)")
    return g.select("page_id", "lat", "lon", F.coalesce("primary_", F.lit(False)).alias("primary_"), "kind", "loaded_at")


def geotags(s: SparkSession, d: str) -> DataFrame:
    """By page and place."""
    keys = ["page_id", "lat", "lon"]
    return stored(s, d, "geotags", ["geotags"], lambda: latest(geotag_rows(s, d), keys, ["loaded_at", "primary_", "kind"]).drop("loaded_at"), keys)


def categorylink_rows(s: SparkSession, d: str) -> DataFrame:
    """The usable rows, repeated and older ones included."""
    c = table(s, d, "categorylinks").where("cl_from is not null and cl_type in ('page', 'subcat', 'file')")
    return c.withColumn("cl_to", F.translate(norm_title("cl_to"), " ", "_")).where("cl_to <> ''")


def categorylinks(s: SparkSession, d: str) -> DataFrame:
    """cl_from, cl_to, cl_type. By category."""

    def build() -> DataFrame:
        return latest(categorylink_rows(s, d), ["cl_from", "cl_to"], ["loaded_at", "cl_timestamp", "cl_type"]).select("cl_from", "cl_to", "cl_type")

    return stored(s, d, "categorylinks", ["categorylinks"], build, ["cl_to", "cl_from"])


def page_categories(s: SparkSession, d: str) -> DataFrame:
    """The same links by page."""
    return stored(s, d, "page_categories", ["categorylinks"], lambda: categorylinks(s, d), ["cl_from", "cl_to"])


def category_names(s: SparkSession, d: str) -> DataFrame:
    """The distinct names, and with ASCII case folded. By that."""
    return stored(s, d, "category_names", ["categorylinks"], lambda: categorylinks(s, d).select("cl_to").distinct().withColumn("fold", ascii_fold("cl_to")), ["fold"])


def redirect_rows(s: SparkSession, d: str) -> DataFrame:
    """The usable rows, repeated and older ones included."""
    return table(s, d, "redirects").where("from_page_id is not null").withColumn("target_title", norm_title("target_title")).where("target_title <> ''")


def redirects(s: SparkSession, d: str) -> DataFrame:
    """from_page_id, target_title. By page."""
    return stored(s, d, "redirects", ["redirects"], lambda: latest(redirect_rows(s, d), ["from_page_id"], ["loaded_at"]).select("from_page_id", "target_title"), ["from_page_id"])


def embeddings(s: SparkSession, d: str) -> DataFrame:
    """One row a page; the model is told by the label."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("page_id"), "embedding", F.concat(F.lit("m"), F.col("label") % 2).alias("model"))


def folders(s: SparkSession, d: str) -> DataFrame:
    """Order priorities stand for folders: id, name, parent_id (every other one nested in the one before), created_at."""
    o = table(s, d, "orders").where("o_orderpriority is not null").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("t"))
    o = o.select("name", F.substring("name", 1, 1).cast("bigint").alias("id"), F.unix_seconds(F.col("t").cast("timestamp")).alias("created_at"))
    return o.select("id", "name", F.when(F.col("id") % 2 == 0, F.col("id") - 1).alias("parent_id"), "created_at")


def bookmarks(s: SparkSession, d: str) -> DataFrame:
    """Orders stand for bookmarks; those of status P are unfiled."""
    o = table(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Article "), F.col("o_orderkey") % 5000).alias("article_title"),
        F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("folder_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )


def saved_revisions(s: SparkSession, d: str) -> DataFrame:
    """Stored revisions: id, title, revision_id, fetched_at, wikitext, user_note."""
    h = table(s, d, "hot_content").where("page_id is not null and revision_id is not null and wikitext is not null")
    h = h.select(F.concat(F.lit("Page "), "page_id").alias("title"), "revision_id", F.unix_seconds(F.col("loaded_at").cast("timestamp")).alias("fetched_at"), "wikitext", F.col("page_id").alias("id"))
    h = latest(h, ["title", "revision_id"], ["fetched_at"])
    return h.withColumn("id", F.col("id") * 1_000_000 + F.col("revision_id") % 1_000_000).withColumn("user_note", F.when(F.col("id") % 4 == 0, F.lit("Keep for later")))


def modules(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "region")
    return r.select(F.lower(F.translate("r_name", " ", "-")).alias("id"), F.col("r_name").alias("name"), F.lit("warm").alias("default_tier"), F.col("r_regionkey").cast("bigint").alias("installed_at"))


def module_members(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lower(F.translate("r_name", " ", "-")).alias("module_id"), F.col("n_name").alias("title"))


def access_log(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", F.col("user_id").alias("page_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "ts", "event_type", "value")
