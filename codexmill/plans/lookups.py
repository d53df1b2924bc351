"""Queries of lookups, categories, geotags and scalar functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import curated as C
from ..functions import scalars as S
from ..functions.text import ascii_fold
from ..operators import category, geo, lookup
from ..store import stored
from ..tables import table
from .curated_sql import sql

_PREFIX, _CATEGORY, _TITLE, _PAGE = "treaty of s", "Former_canal_towns", "Padani Dekuth Bridge", 3130
_NOW = 1_720_000_000




def _busiest(s, d):
    """The title of the article in most categories (ties: least title)."""


    def build():
        links = C.page_categories(s, d).where("cl_type = 'page'").groupBy("cl_from").agg(F.count("*").alias("n"))
        return links.join(C.articles(s, d).where("tier <> 'evicted'").select(F.col("page_id").alias("cl_from"), "title"), "cl_from").orderBy(F.desc("n"), "title").limit(1)

    best = stored(s, d, "busiest", ["articles", "categorylinks"], build, ["title"]).first()
    return best["title"] if best else ""


def _with_last_evicted(s, d):
    """The articles, and an evicted one far behind them all, on which the probe of seed -1 then falls short of."""
    a = C.articles(s, d).select("page_id", "title", "tier")
    return a.unionByName(a.agg((F.max("page_id") + 10_000_000_000_000).alias("page_id")).select("page_id", F.lit("Last").alias("title"), F.lit("evicted").alias("tier")))


_BUSY = "busy AS (SELECT title, page_id FROM (SELECT cl_from, count(*) AS n FROM cl WHERE cl_type = 'page' GROUP BY 1) JOIN art ON page_id = cl_from WHERE tier <> 'evicted' ORDER BY n DESC, title LIMIT 1)"

QUERIES = {
    "q1_lookup": lambda s, d: lookup.lookup(C.articles(s, d), _busiest(s, d)).select("page_id", "title", "tier"),
    "q2_content": lambda s, d: lookup.article_content(C.articles(s, d), C.hot_content(s, d)).select("page_id", "kind", F.md5("text").alias("text_md5"), "stream_offset", "stream_length"),
    "q3_geotag_per_page": lambda s, d: geo.geotag_per_page(C.geotags(s, d)),
    "q4_redirects": lambda s, d: lookup.resolve_redirects(C.articles(s, d), C.redirects(s, d)),
    "q5_categories_of_page": lambda s, d: category.categories_of(C.page_categories(s, d), _PAGE),
    "q6_category_prefix": lambda s, d: category.search_categories(C.category_names(s, d), "f", 15),
    "q7_prefix_as_given": lambda s, d: lookup.titles_with_prefix(C.folded_titles(s, d), "treaty ", 50).unionByName(lookup.titles_with_prefix(C.folded_titles(s, d), "Treaty_", 50)).unionByName(lookup.titles_with_prefix(C.folded_titles(s, d), " \t", 50)),
    "q7_title_prefix": lambda s, d: lookup.titles_with_prefix(C.folded_titles(s, d), _PREFIX, 20),
    "q8_without_embedding": lambda s, d: lookup.without_embedding(C.articles(s, d), C.embeddings(s, d), "m1"),
    "q13_recent": lambda s, d: lookup.recent_articles(C.articles(s, d), 100),
    "q16_categories_of_title": lambda s, d: category.categories_of_title(C.page_categories(s, d), C.articles(s, d), _busiest(s, d)),
    "q17_resolve": lambda s, d: lookup.resolve_articles(table(s, d, "redirects").select(F.col("target_title").alias("title")), C.articles(s, d), C.redirects(s, d), C.hot_content(s, d)),
    "q18_timeline": lambda s, d: lookup.revision_timeline(
        table(s, d, "hot_content").where("page_id is not null and revision_id is not null").select(F.col("page_id").alias("key"), F.col("revision_id").alias("revid"), F.unix_seconds(F.col("loaded_at").cast("timestamp")).alias("ts"), F.coalesce(F.length("wikitext"), F.lit(0)).alias("size")).distinct()
    ).select("key", "revid", "ts", F.round("x", 6).alias("x"), F.round("h", 6).alias("h")),
    "q21_coordinate_labels": lambda s, d: C.geotags(s, d).select("page_id", "lat", "lon", S.coordinate_label(F.round("lat", 1), F.round("lon", 1)).alias("label")),
    "q22_relative_time": lambda s, d: C.articles(s, d).select("page_id", S.relative_time("last_accessed", F.lit(_NOW)).alias("ago")),
    "j1_primary_geotags": lambda s, d: geo.primary_geotags(C.geotags(s, d), C.articles(s, d)),
    "j2_category_members": lambda s, d: category.category_members(C.categorylinks(s, d), C.articles(s, d), _CATEGORY),
    "j2_subcategories_repaired": lambda s, d: category.category_members(C.categorylinks(s, d), C.articles(s, d), _CATEGORY, "file", repaired=True),
    "j3_related": lambda s, d: category.related_to(C.categorylinks(s, d), C.articles(s, d), _busiest(s, d), 50, C.page_categories(s, d)),
    "j5_links_available": lambda s, d: lookup.links_available(C.redirects(s, d).select("from_page_id", F.col("target_title").alias("target")), C.articles(s, d)),
    "j13_closure": lambda s, d: category.closure_to_depth(C.categorylinks(s, d), C.articles(s, d), C.categorylinks(s, d).where("cl_type = 'subcat'").select(F.translate("cl_to", "_", " ").alias("root")).distinct(), 3),
    "a1_tier_counts": lambda s, d: lookup.tier_counts(C.articles(s, d)),
    "a2_table_counts": lambda s, d: lookup.table_counts(geotags=C.geotags(s, d), categorylinks=C.categorylinks(s, d), redirects=C.redirects(s, d), bookmarks=C.bookmarks(s, d), revisions=C.saved_revisions(s, d), embeddings=C.embeddings(s, d).where("model = 'm0'"), articles=C.articles(s, d)),
    "a3_count_primary": lambda s, d: geo.count_primary(C.geotags(s, d), C.articles(s, d)),
    "a5_distinct_categories": lambda s, d: C.category_names(s, d).select("cl_to"),
    "a6_key_range": lambda s, d: lookup.key_range(C.articles(s, d)),
    "t1_geotag_page": lambda s, d: geo.primary_geotags_page(C.geotags(s, d), C.articles(s, d), 300, 200),
    "t3_lru": lambda s, d: lookup.lru_candidates(C.articles(s, d), 50),
    "t4_random": lambda s, d: lookup.random_article(C.articles(s, d), 42),
    "t4_wrapped": lambda s, d: lookup.random_article(_with_last_evicted(s, d), -1),
    "t7_ring": lambda s, d: lookup.ring_buffer(C.access_log(s, d).select("event_id", "page_id", "at"), "at", "event_id", 1000),
    "f1_normalised_titles": lambda s, d: table(s, d, "articles").select("title", F.btrim(F.translate("title", "_", " "), F.lit(lookup.WHITE_SPACE)).alias("norm")).distinct(),
    "f2_ascii_fold": lambda s, d: C.articles(s, d).select("page_id", ascii_fold("title").alias("fold")),
    "f4_html_escape": lambda s, d: C.articles(s, d).select("page_id", S.html_escape("title").alias("html")),
    "f5_slug": lambda s, d: C.articles(s, d).select("page_id", S.slugify("title").alias("slug")),
    "f7_url_title": lambda s, d: C.articles(s, d).select("page_id", S.url_encode_title("title").alias("url")),
    "f8_template_names": lambda s, d: C.category_names(s, d).select("cl_to", S.prettify_template("cl_to").alias("pretty")),
    "f9_snippets": lambda s, d: C.hot_content(s, d).select("page_id", S.truncate_snippet("wikitext", 600).alias("snippet")).select("page_id", F.length("snippet").cast("bigint").alias("n"), F.octet_length("snippet").cast("bigint").alias("b")),
    "f15_disk": lambda s, d: table(s, d, "part").select("p_partkey", S.disk_projection(F.col("p_size") * 1000, F.lit(60_000), F.col("p_partkey") % 40_000).alias("x")).select("p_partkey", F.round("x.free_after_pct", 6).alias("pct"), "x.warn"),
    "f16_retry": lambda s, d: C.access_log(s, d).select("event_id", (400 + F.col("page_id") % 130).alias("status")).select("event_id", "status", S.is_retryable("status").alias("again")),
    "f17_backoff": lambda s, d: C.access_log(s, d).select("event_id", S.backoff_seconds(F.col("event_id") % 10, F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 500)).cast("bigint").alias("wait")),
    "q19_href_titles": lambda s, d: C.articles(s, d).select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ("#/article/", "./", "https://en.wikipedia.org/wiki/", "//de.m.wikipedia.org/wiki/", "/wiki/", "ftp://x/"))), (F.col("page_id") % 6 + 1).cast("int")), S.url_encode_title("title")).alias("href")).select("page_id", S.title_from_href("href").alias("target")),
}

_CONTENT = "SELECT a.page_id, CASE WHEN tier IN ('hot', 'warm') THEN CASE WHEN wikitext IS NULL THEN 'missing' ELSE tier END WHEN tier = 'cold' THEN CASE WHEN stream_offset IS NULL THEN 'error' ELSE 'cold' END ELSE 'evicted' END AS kind, CASE WHEN tier IN ('hot', 'warm') THEN md5(wikitext) END AS text_md5, CASE WHEN tier = 'cold' THEN stream_offset END AS stream_offset, CASE WHEN tier = 'cold' THEN stream_length END AS stream_length FROM art a LEFT JOIN hot h ON h.page_id = a.page_id"
_TREE = "SELECT DISTINCT l.cl_to, replace(a.title[10:], ' ', '_') AS child FROM cl l JOIN art a ON a.page_id = l.cl_from WHERE l.cl_type = 'subcat' AND starts_with(a.title, 'Category:')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_URL = "replace(title, ' ', '_')"
for _x in S.URL_RESERVED:
    _URL = f"replace({_URL}, '{_x}', '%{ord(_x):02X}')"

ORACLES = {
    "q1_lookup": sql("SELECT page_id, title, tier FROM art WHERE title = (SELECT title FROM busy)", _BUSY),
    "q2_content": sql(_CONTENT),
    "q3_geotag_per_page": sql("SELECT * FROM geo QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY primary_ DESC, lat, lon) = 1"),
    "q4_redirects": sql("SELECT a.title, r.target_title FROM art a JOIN red r ON r.from_page_id = a.page_id"),
    "q5_categories_of_page": sql(f"SELECT replace(cl_to, '_', ' ') AS category FROM cl WHERE cl_from = {_PAGE} AND cl_type = 'page'"),
    "q6_category_prefix": sql(f"SELECT replace(cl_to, '_', ' ') AS category FROM (SELECT DISTINCT cl_to FROM cl WHERE starts_with({_FOLD.format('cl_to')}, 'f') ORDER BY cl_to LIMIT 15)"),
    "q7_title_prefix": sql(f"SELECT page_id, title FROM art WHERE tier <> 'evicted' AND starts_with({_FOLD.format('title')}, '{_PREFIX}') ORDER BY length(title), title, page_id LIMIT 20"),
    "q7_prefix_as_given": sql(f"SELECT page_id, title FROM art WHERE tier <> 'evicted' AND starts_with({_FOLD.format('title')}, 'treaty ') ORDER BY length(title), title, page_id LIMIT 50"),
    "q8_without_embedding": sql("SELECT page_id, title FROM art WHERE page_id NOT IN (SELECT page_id FROM emb WHERE model = 'm1')"),
    "q13_recent": sql("SELECT page_id, title, last_accessed, access_count FROM art WHERE last_accessed > 0 ORDER BY last_accessed DESC, page_id LIMIT 100"),
    "q16_categories_of_title": sql("SELECT replace(cl_to, '_', ' ') AS category FROM cl JOIN busy ON page_id = cl_from WHERE cl_type = 'page'", _BUSY),
    "q17_resolve": sql(
        "SELECT asked, t.title, c.page_id, coalesce(c.kind, 'not_found') AS served FROM (SELECT q.asked, coalesce(r.target_title, q.asked) AS title FROM asked q LEFT JOIN (SELECT a.title, r.target_title FROM art a JOIN red r ON r.from_page_id = a.page_id) r ON r.title = q.asked) t "
        f"LEFT JOIN (SELECT art.title, c.* FROM art JOIN ({_CONTENT}) c ON c.page_id = art.page_id) c ON c.title = t.title",
        f"asked AS (SELECT DISTINCT trim(replace(target_title, '_', ' '), '{lookup.WHITE_SPACE}') AS asked FROM redirects WHERE trim(replace(target_title, '_', ' '), '{lookup.WHITE_SPACE}') <> '')",
    ),
    "q18_timeline": "WITH r AS (SELECT DISTINCT page_id AS key, revision_id AS revid, cast(floor(epoch(loaded_at)) AS BIGINT) AS ts, coalesce(length(wikitext), 0) AS size FROM hot_content WHERE page_id IS NOT NULL AND revision_id IS NOT NULL) SELECT key, revid, ts, round((ts - min(ts) OVER w) * 1000.0::DOUBLE / greatest(1, (max(ts) OVER w - min(ts) OVER w) * 1000) * 1000, 6) AS x, round(size::DOUBLE / greatest(1, max(size) OVER w) * 60 + 2, 6) AS h FROM r WINDOW w AS (PARTITION BY key)",
    "q21_coordinate_labels": sql("SELECT page_id, lat, lon, printf('%.2f° %s · %.2f° %s', abs(round(lat, 1)), CASE WHEN round(lat, 1) >= 0 THEN 'N' ELSE 'S' END, abs(round(lon, 1)), CASE WHEN round(lon, 1) >= 0 THEN 'E' ELSE 'W' END) AS label FROM geo"),
    "q22_relative_time": sql(f"SELECT page_id, CASE WHEN last_accessed IS NULL OR last_accessed = 0 THEN 'never' WHEN {_NOW} - last_accessed < 60 THEN 'just now' WHEN {_NOW} - last_accessed < 3600 THEN (({_NOW} - last_accessed) // 60) || ' min ago' WHEN {_NOW} - last_accessed < 86400 THEN (({_NOW} - last_accessed) // 3600) || ' hr ago' WHEN {_NOW} - last_accessed < 604800 THEN (({_NOW} - last_accessed) // 86400) || ' days ago' ELSE strftime(make_timestamp(last_accessed * 1000000), '%Y-%m-%d') END AS ago FROM art"),
    "j1_primary_geotags": sql("SELECT g.page_id, a.title, lat, lon, kind FROM geo g JOIN art a ON a.page_id = g.page_id WHERE primary_"),
    "j2_category_members": sql(f"SELECT cl_from AS page_id, coalesce(title, replace(cl_to, '_', ' ')) AS title, cl_type FROM cl LEFT JOIN art ON page_id = cl_from WHERE cl_to = '{_CATEGORY}'"),
    "j2_subcategories_repaired": sql(f"SELECT cl_from AS page_id, coalesce(title, '#' || cl_from) AS title, cl_type FROM cl LEFT JOIN art ON page_id = cl_from WHERE cl_to = '{_CATEGORY}' AND cl_type = 'file'"),
    "j3_related": sql("SELECT a.page_id, a.title, count(*) AS shared FROM cl m JOIN cl o ON o.cl_to = m.cl_to AND o.cl_type = 'page' JOIN art a ON a.page_id = o.cl_from WHERE m.cl_type = 'page' AND m.cl_from = (SELECT page_id FROM busy) AND o.cl_from <> m.cl_from GROUP BY 1, 2 ORDER BY shared DESC, a.title, a.page_id LIMIT 50", _BUSY),
    "j5_links_available": sql("SELECT from_page_id, target_title AS target, EXISTS (SELECT 1 FROM art WHERE title = target_title) AS available FROM red"),
    "j13_closure": sql("SELECT root, c.cl_from AS page_id, cast(min(level) AS INTEGER) AS level FROM walk w JOIN cl c ON c.cl_to = w.cl_to AND c.cl_type = 'page' GROUP BY 1, 2", f"tree AS ({_TREE})", "walk AS (SELECT DISTINCT replace(cl_to, '_', ' ') AS root, cl_to, 0 AS level FROM cl WHERE cl_type = 'subcat' UNION SELECT w.root, t.child, w.level + 1 FROM walk w JOIN tree t ON t.cl_to = w.cl_to WHERE w.level < 3)"),
    "a1_tier_counts": sql("SELECT " + ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in lookup.TIERS) + " FROM art"),
    "a2_table_counts": sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {t}" for n, t in (("geotags", "geo"), ("categorylinks", "cl"), ("redirects", "red"), ("bookmarks", "book"), ("revisions", "rev"), ("embeddings", "emb WHERE model = 'm0'"), ("articles", "art")))),
    "a3_count_primary": sql("SELECT count(*) AS n FROM geo g JOIN art a ON a.page_id = g.page_id WHERE primary_"),
    "a5_distinct_categories": sql("SELECT DISTINCT cl_to FROM cl"),
    "a6_key_range": sql("SELECT min(page_id) AS lo, max(page_id) AS hi FROM art"),
    "t1_geotag_page": sql("SELECT g.page_id, a.title, lat, lon, kind FROM geo g JOIN art a ON a.page_id = g.page_id WHERE primary_ ORDER BY g.page_id, lat, lon LIMIT 200 OFFSET 300"),
    "t3_lru": sql("SELECT page_id, title, tier, last_accessed, access_count FROM art WHERE tier IN ('hot', 'warm') AND NOT coalesce(pinned, false) ORDER BY last_accessed NULLS FIRST, access_count NULLS FIRST, page_id LIMIT 50"),
    "t4_random": sql(f"SELECT page_id, title FROM (SELECT page_id, title, 0 AS o FROM art WHERE tier <> 'evicted' AND page_id >= (SELECT min(page_id) + (42 * {lookup.SPREAD}) % (max(page_id) - min(page_id) + 1) FROM art) UNION ALL SELECT page_id, title, 1 FROM art WHERE tier <> 'evicted') ORDER BY o, page_id LIMIT 1"),
    "t4_wrapped": sql("SELECT page_id, title FROM art WHERE tier <> 'evicted' ORDER BY page_id LIMIT 1"),
    "t7_ring": sql('SELECT event_id, page_id, "at" FROM log ORDER BY "at" DESC, event_id DESC LIMIT 1000'),
    "f1_normalised_titles": f"SELECT DISTINCT title, trim(replace(title, '_', ' '), '{lookup.WHITE_SPACE}') AS norm FROM articles",
    "f2_ascii_fold": sql(f"SELECT page_id, {_FOLD.format('title')} AS fold FROM art"),
    "f4_html_escape": sql("SELECT page_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM art"),
    "f5_slug": sql("SELECT page_id, coalesce(nullif(trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'section') AS slug FROM art"),
    "f7_url_title": sql(f"SELECT page_id, {_URL} AS url FROM art"),
    "f8_template_names": sql("SELECT DISTINCT cl_to, upper(replace(cl_to, '_', ' ')[1:1]) || replace(cl_to, '_', ' ')[2:] AS pretty FROM cl"),
    "f9_snippets": sql("SELECT page_id, CASE WHEN strlen(wikitext) <= 600 THEN length(wikitext) ELSE len(list_filter([strlen(wikitext[1:k]) for k in range(1, 601)], lambda b: b <= 600)) + 1 END AS n, CASE WHEN strlen(wikitext) <= 600 THEN strlen(wikitext) ELSE list_max(list_filter([strlen(wikitext[1:k]) for k in range(1, 601)], lambda b: b <= 600)) + 3 END AS b FROM hot"),
    "f15_disk": "WITH x AS (SELECT p_partkey, p_size * 1000 AS f, p_partkey % 40000 AS n FROM part) SELECT p_partkey, round(greatest(0, f - n)::DOUBLE / 60000 * 100, 6) AS pct, f < n OR floor(greatest(0, f - n)::DOUBLE / 60000 * 100) < 15 AS warn FROM x",
    "f16_retry": sql("SELECT event_id, 400 + page_id % 130 AS status, (400 + page_id % 130) IN (408, 425, 429) OR 400 + page_id % 130 >= 500 AS again FROM log"),
    "f17_backoff": sql("SELECT event_id, cast(CASE WHEN event_id % 4 = 0 THEN least(event_id % 500, 300) ELSE [1, 1, 2, 4, 8, 16, 32, 60][least(event_id % 10, 7) + 1] END AS BIGINT) AS wait FROM log"),
    "q19_href_titles": sql("SELECT page_id, CASE WHEN page_id % 6 <> 5 THEN title END AS target FROM art"),
}
