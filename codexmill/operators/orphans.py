"""References to records that do not exist (problem 1).

A *reference* is a row that names an article by page id or by title at the moment it was
loaded. It is a **direct** orphan if no article row with that id or title holds at that second.
Orphanhood then cascades down the foreign-key graph: a page whose newest redirect row is orphaned
leads nowhere, so references that resolve to this page are **inherited** orphans, and where such
a reference is again the newest redirect row of its page, that page is dead one level further
down. The cascade iterates semi-joins from the small frontier of newly dead pages until no page
is added; every round is cut into the checkpoint folder.

Scale: references are reduced to distinct (key, second) rows with a map-side combine before any
join, so hot keys arrive once per second and partition at most; each kind of reference meets the
articles in one equi-join with a range residue, whose reference side adaptive execution may split.
Nothing is collected: the driver only sees whether a round found anything.

Defined cases: null keys and titles empty after normalising are no references; rows with a null
load time are no cases (nothing says when they should hold); null ``created_at`` never holds;
repeated rows count in ``n_rows`` but give one case; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..session import cut, union_of


def _second(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _period(c: str):
    return F.date_format(F.col(c), "yyyy-MM")


def article_spans(articles: DataFrame) -> DataFrame:
    """Distinct (page, title, lo, hi): the article holds for lo <= second < hi."""
    return (
        articles.select(
            F.col("page_id").alias("page"),
            norm_title("title").alias("title"),
            F.col("created_at").alias("lo"),
            F.coalesce("deleted_at", F.lit(2**63 - 1)).alias("hi"),
        )
        .where("lo is not null and lo < hi")
        .distinct()
    )


def reference_rows(redirects: DataFrame, geotags: DataFrame, categorylinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references by page id, references by title), each distinct with its row count."""

    def by_page(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("table_name"), F.col(key).alias("page"), _second("loaded_at").alias("sec"), _period("loaded_at").alias("period")
        ).where("page is not null and sec is not null")

    pages = by_page(geotags, "geotags", "page_id").unionByName(by_page(categorylinks, "categorylinks", "cl_from"))
    pages = pages.groupBy("table_name", "page", "sec", "period").agg(F.count("*").alias("n_rows"))
    titles = (
        redirects.select(
            norm_title("target_title").alias("title"), F.col("from_page_id").alias("owner"), _second("loaded_at").alias("sec"), _period("loaded_at").alias("period")
        )
        .where("title <> '' and sec is not null")
        .groupBy("title", "owner", "sec", "period")
        .agg(F.count("*").alias("n_rows"))
    )
    return pages, titles


def _dangling(refs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The rows of refs whose key no span holds at their second: one range join on the key."""
    held = spans.select(F.col(key).alias("_k"), "lo", "hi").where("_k is not null").distinct()
    return refs.join(held, (refs[key] == held["_k"]) & (refs["sec"] >= held["lo"]) & (refs["sec"] < held["hi"]), "left_anti")


def find_orphans(articles: DataFrame, redirects: DataFrame, geotags: DataFrame, categorylinks: DataFrame) -> DataFrame:
    """Every orphan reference: table_name, ref_key, period, kind, level, n_rows.

    ``kind`` is ``direct`` (level 0) or ``inherited`` (level = number of dead redirects between
    the reference and the direct orphan at the top of its chain).
    """
    spans = article_spans(articles)
    pages, titles = reference_rows(redirects, geotags, categorylinks)
    direct_p = cut(_dangling(pages, spans, "page"))
    titles = cut(titles)
    direct_t = cut(_dangling(titles, spans, "title"))

    # The newest redirect row of every page, and the page its title belongs to.
    newest = titles.where("owner is not null").groupBy("owner").agg(F.max(F.struct("sec", "title")).alias("r")).select("owner", "r.sec", "r.title")
    page_of = spans.where("title is not null and page is not null").groupBy("title").agg(F.min("page").alias("page"))
    state = newest.join(direct_t.select("owner", "sec", "title", F.lit(True).alias("d")).distinct(), ["owner", "sec", "title"], "left")
    # A reference that is already a direct orphan inherits nothing; only the others can be killed from above.
    chain = cut(state.join(page_of, "title", "left").select("owner", "page", F.coalesce("d", F.lit(False)).alias("d")))

    frontier = cut(chain.where("d").select(F.col("owner").alias("page"), F.lit(1).alias("level")).distinct())
    open_links = chain.where("not d and page is not null").select("owner", "page")
    parts, level = [frontier], 1
    while not frontier.isEmpty():
        dead = union_of(parts)
        if len(parts) > 6:  # the plan stays short however long a chain is
            dead = cut(dead)
            parts = [dead]
        nxt = (
            open_links.join(frontier.select("page"), "page", "left_semi")
            .select(F.col("owner").alias("page"))
            .distinct()
            .join(dead.select("page"), "page", "left_anti")
            .withColumn("level", F.lit(level + 1))
        )
        frontier = cut(nxt)
        level += 1
        parts.append(frontier)
    dead = cut(union_of(parts)) if level > 2 else union_of(parts)

    inherited_p = pages.join(dead, "page").join(direct_p.select("table_name", "page", "sec", "period"), ["table_name", "page", "sec", "period"], "left_anti")
    inherited_t = (
        titles.join(direct_t.select("title", "sec").distinct(), ["title", "sec"], "left_anti").join(page_of, "title").join(dead, "page")
    )

    def shape(df: DataFrame, name, key, kind: str, lv) -> DataFrame:
        return df.select(name.alias("table_name"), key.alias("ref_key"), "period", F.lit(kind).alias("kind"), lv.alias("level"), "n_rows")

    page_key, title_name = F.col("page").cast("string"), F.lit("redirects")
    rows = (
        shape(direct_p, F.col("table_name"), page_key, "direct", F.lit(0))
        .unionByName(shape(direct_t, title_name, F.col("title"), "direct", F.lit(0)))
        .unionByName(shape(inherited_p, F.col("table_name"), page_key, "inherited", F.col("level")))
        .unionByName(shape(inherited_t, title_name, F.col("title"), "inherited", F.col("level")))
    )
    return rows.groupBy("table_name", "ref_key", "period", "kind").agg(F.min("level").alias("level"), F.sum("n_rows").alias("n_rows"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per table, month and kind: how many keys and rows are orphaned, and the deepest level."""
    return orphans.groupBy("table_name", "period", "kind").agg(
        F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"), F.max("level").alias("max_level")
    )
