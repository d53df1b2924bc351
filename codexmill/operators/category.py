"""Category browsing and related articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from ..session import cut
from .lookup import clamp, normalise


#: Categories of a page that are looked up by name; more are joined, with the same result.
NAMES = 500


def category_members(links: DataFrame, articles: DataFrame, category: str, kind: str | None = None, repaired: bool = False) -> DataFrame:
    """Members of a category with their titles, by title.

    A member without article shows the name of the queried category, as the catalogue always did;
    ``repaired`` shows its page id instead.
    """
    c = links.where(F.col("cl_to") == normalise(category).replace(" ", "_"))
    if kind is not None:
        c = c.where(F.col("cl_type") == kind)
    other = F.concat(F.lit("#"), "cl_from") if repaired else F.translate("cl_to", "_", " ")
    m = c.join(articles.select("page_id", "title"), c["cl_from"] == articles["page_id"], "left")
    return m.select(F.col("cl_from").alias("page_id"), F.coalesce("title", other).alias("title"), "cl_type").orderBy("title", "page_id")


def categories_of(links: DataFrame, page_id: int | None) -> DataFrame:
    """Q5: the categories of a page, as page only, in name order."""
    return links.where((F.col("cl_from") == page_id) & (F.col("cl_type") == "page")).orderBy("cl_to").select(F.translate("cl_to", "_", " ").alias("category"))


def categories_of_title(links: DataFrame, articles: DataFrame, title: str) -> DataFrame:
    """Q16: as categories_of by title; an unknown title has none."""
    return categories_of(links, page_of_title(articles, title))


def page_of_title(articles: DataFrame, title: str) -> int | None:
    """The page id of a title, which one page has at most: a lookup, so that what follows filters by a literal."""
    a = articles.where(F.col("title") == normalise(title)).select("page_id").first()
    return a["page_id"] if a else None


def search_categories(links: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Q6: distinct names with an ASCII-folded prefix, in raw name order; an empty prefix matches all.

    A column ``fold`` with the folded name, where there is one, is used.
    """
    fold = prefix.replace(" ", "_").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    folded = F.col("fold") if "fold" in links.columns else ascii_fold("cl_to")
    return links.where(folded.startswith(fold)).select("cl_to").distinct().orderBy("cl_to").limit(clamp(limit, 1, 1000)).select(F.translate("cl_to", "_", " ").alias("category"))


def related_to(links: DataFrame, articles: DataFrame, title: str, limit: int = 20, by_page: DataFrame | None = None) -> DataFrame:
    """Articles sharing most categories with the one of that title.

    ``by_page`` are the same links clustered by page, if there are such. The categories of one page
    are few, so their names become literals that prune the scan of the links (up to ``NAMES`` of
    them; a page in more is joined). Their members are counted with a map-side combine.
    """
    me = page_of_title(articles, title)
    by_page = links if by_page is None else by_page
    pages = links.where("cl_type = 'page'").select("cl_from", "cl_to")
    mine = by_page.where((F.col("cl_from") == me) & (F.col("cl_type") == "page")).select("cl_to")
    names = [r["cl_to"] for r in mine.limit(NAMES + 1).collect()]
    members = pages.where(F.col("cl_to").isin(names)) if len(names) <= NAMES else pages.join(mine, "cl_to", "left_semi")
    shared = members.where(F.col("cl_from") != me).groupBy("cl_from").agg(F.count("*").alias("shared"))
    hits = shared.join(articles.select("page_id", "title"), shared["cl_from"] == F.col("page_id"))
    return hits.select("page_id", "title", "shared").orderBy(F.desc("shared"), "title", "page_id").limit(clamp(limit, 1, 100))


def closure_to_depth(links: DataFrame, articles: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, page_id, level): member pages of a category and its subcategories down to a depth.

    ``roots`` has ``root`` (a name). Level 0 are the root's own members; depth is at most 10. Each
    level expands the categories new at that level by one join, so cycles end by themselves.
    """
    depth = clamp(depth, 0, 10)
    name_of = articles.where(F.col("title").startswith("Category:")).select("page_id", F.translate(F.expr("substring(title, 10)"), " ", "_").alias("name"))
    sub = links.where("cl_type = 'subcat'").join(name_of, links["cl_from"] == name_of["page_id"]).select("cl_to", F.col("name").alias("child")).distinct()
    sub = cut(sub)  # the small part of the links that every level joins
    seen = roots.select("root", F.translate("root", " ", "_").alias("cl_to"), F.lit(0).alias("level")).distinct()
    new = seen = cut(seen)
    for level in range(1, depth + 1):
        new = cut(new.select("root", "cl_to").join(sub, "cl_to").select("root", F.col("child").alias("cl_to")).distinct().join(seen.select("root", "cl_to"), ["root", "cl_to"], "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    pages = links.where("cl_type = 'page'").select("cl_to", F.col("cl_from").alias("page_id"))
    return seen.join(pages, "cl_to").groupBy("root", "page_id").agg(F.min("level").alias("level"))
