"""Queries of sources, wikitext and streaming folds, with their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import curated as C
from ..functions import scalars as S
from ..functions import wikitext as W
from ..functions.text import WHITE_SPACE
from ..operators import ingest as I
from ..sources import dumps as D
from ..sources import files as X
from ..streaming import governance as G
from ..tables import table
from . import dumpfiles as E
from .curated_sql import sql


def _xml(s, d):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    a = C.articles(s, d)
    return a.select(F.concat(F.lit("\n<page>\n<title>"), esc("title"), F.lit("</title><id>"), "page_id", F.lit("</id><revision><contributor><id>77</id></contributor><id>"), F.coalesce(F.col("revision_id").cast("string"), F.lit("")), F.lit("</id><text xml:space=\"preserve\">See ["), esc("title"), F.lit("]</text></revision>")).alias("value"))


def _responses(s, d):
    e = C.access_log(s, d)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("event_id").alias("revid"), F.col("page_id").alias("user"), F.col("at").alias("size"))).alias("revisions"))).alias("pages")).alias("query")))
    return e.select("event_id", body.alias("body"))


def _log(s, d):
    e = C.access_log(s, d)
    return e.select((F.col("page_id") % 20).alias("client"), F.concat(F.lit("u"), F.col("event_id") % 700).alias("url"), F.floor(F.col("at") / 40).alias("at"), "event_id", (F.col("event_type") == "error").alias("is_error"))


QUERIES = {
    "src1_index_file": lambda s, d: D.read_index(s, E.index_file(s, d)),
    "src2_index": lambda s, d: D.parse_index_lines(E.index_lines(s, d)),
    "src3_streams": lambda s, d: D.read_streams(*E.multistream(s, d)),
    "src5_table_file": lambda s, d: D.read_table_dump(s, E.table_file(s, d, "geo", "geotags", E.geo_statements(s, d)), "geo_tags").select(F.size("fields").alias("n"), F.element_at("fields", 2).alias("second")).groupBy("n", "second").agg(F.count("*").alias("rows")),
    "src6_tuples": lambda s, d: D.insert_tuples(E.link_statements(s, d), "categorylinks").select(F.array_join("fields", "|").alias("fields")),
    "src4_pages": lambda s, d: D.parse_page_xml(_xml(s, d)),
    "src7_geotags": lambda s, d: D.geotags_from(D.insert_tuples(E.geo_statements(s, d), "geo_tags")),
    "src8_links": lambda s, d: D.categorylinks_from(D.insert_tuples(E.link_statements(s, d), "categorylinks")),
    "src9_redirects": lambda s, d: D.redirects_from(D.insert_tuples(E.redirect_statements(s, d), "redirect")),
    "src12_revisions": lambda s, d: X.parse_revisions(_responses(s, d), "body", ["event_id"]),
    "src14_ranges": lambda s, d: C.access_log(s, d).select("event_id", F.concat(F.lit("bytes="), F.col("event_id") % 130, F.lit("-"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 210).cast("string")).otherwise("")).alias("h")).select("event_id", S.byte_range("h", F.lit(100)).alias("r")).select("event_id", "r.first", "r.last"),
    "snk22_index": lambda s, d: I.ingest_index(C.articles(s, d).where("tier = 'hot'"), D.read_index(s, E.index_file(s, d)), 1_720_000_000).select("page_id", "title", "tier", "stream_offset", "access_count"),
    "snk23_geotags": lambda s, d: I.ingest_table(s, E.table_file(s, d, "geo-changed", "geotags", E.geo_statements(s, d, F.lit("dump"))), "geo_tags", C.geotags(s, d).where("primary_"))[0],
    "snk23_links": lambda s, d: I.ingest_table(s, E.table_file(s, d, "links-changed", "categorylinks", E.link_statements(s, d, F.lit("file"))), "categorylinks", C.categorylinks(s, d).where("cl_type = 'page'"))[0],
    "snk23_redirects": lambda s, d: I.ingest_table(s, E.table_file(s, d, "redirects-changed", "redirects", E.redirect_statements(s, d, F.concat("target_title", F.lit(" II")))), "redirect", C.redirects(s, d))[0],
    "snk23_processed": lambda s, d: I.ingest_table(s, E.table_file(s, d, "redirects", "redirects", E.redirect_statements(s, d)), "redirect", C.redirects(s, d))[1],
    "snk25_zstd": lambda s, d: C.hot_content(s, d).select("page_id", "wikitext", X.zstd_compress("wikitext").alias("z")).select("page_id", (X.zstd_decompress("z") == F.col("wikitext")).alias("same")),
    "w1_html": lambda s, d: C.hot_content(s, d).select("page_id", W.render("wikitext").alias("html")).select("page_id", F.md5("html").alias("html_md5")),
    "w3_plain": lambda s, d: C.hot_content(s, d).select("page_id", F.md5(W.plain_text("wikitext")).alias("text_md5")),
    "w4_infobox": lambda s, d: C.hot_content(s, d).select("page_id", F.explode(W.infoboxes("wikitext")).alias("x")).select("page_id", "x.name", "x.key", "x.value"),
    "w7_references": lambda s, d: C.hot_content(s, d).select("page_id", F.posexplode(W.references("wikitext")).alias("pos", "text")),
    "w8_links": lambda s, d: W.with_availability(W.internal_links(C.hot_content(s, d), "page_id", "wikitext"), C.articles(s, d)),
    "f6_heading_ids": lambda s, d: W.headings(C.hot_content(s, d), "page_id", "wikitext"),
    "q20_toc": lambda s, d: C.hot_content(s, d).select("page_id", F.posexplode(S.table_of_contents(W.render("wikitext"))).alias("pos", "t")).select("page_id", "pos", "t.level", "t.id", "t.text"),
    "a10_rolling_errors": lambda s, d: G.rolling_errors(C.access_log(s, d), 3600),
    "st2_token_bucket": lambda s, d: G.fold_sorted(_log(s, d).withColumn("at", F.floor(F.col("at") / 100)), "client", "at", "event_id", "is_error", G.bucket_fold(2), "wait", "double").select(F.col("tie").alias("event_id"), F.round("wait", 6).alias("wait")),
    "st3_breaker": lambda s, d: G.fold_sorted(_log(s, d), "client", "at", "event_id", "is_error", G.breaker_fold(5, 600, 3000), "is_open", "boolean").select(F.col("tie").alias("event_id"), "is_open"),
    "st4_history": lambda s, d: G.access_history(C.access_log(s, d)).select("page_id", F.col("day").cast("date").alias("day"), "access_count"),
    "st6_first_urls": lambda s, d: G.first_responses(C.access_log(s, d).select("ts", F.concat(F.lit("u"), "page_id").alias("url"))).select("url"),
}

_EVENTS = "ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t_at, event_id) AS n FROM (SELECT page_id % 20 AS client, floor(\"at\" / 40)::DOUBLE AS t_at, event_id, event_type = 'error' AS is_error FROM log))"

ORACLES = {
    "src1_index_file": sql("SELECT stream_offset, page_id, title FROM art WHERE stream_offset IS NOT NULL"),
    "src3_streams": sql("SELECT page_id, title, revision_id, 'See [' || title || '] & <more>' AS wikitext FROM art"),
    "src5_table_file": sql("SELECT n, second, count(*) AS rows FROM (SELECT 11 AS n, cast(page_id AS VARCHAR) AS second FROM geo UNION ALL SELECT 11, '2' FROM geo UNION ALL SELECT 3, '2' FROM geo) GROUP BY ALL"),
    "src6_tuples": sql("SELECT cl_from || '|' || cl_to || '|KEY; (x)|2024-01-01 00:00:00||uca-default|' || cl_type AS fields FROM cl UNION ALL SELECT cl_from || '|Other|||||portal' FROM cl UNION ALL SELECT cl_from || '||||||page' FROM cl"),
    "src7_geotags": sql("SELECT page_id, lat, lon, primary_, nullif(nullif(trim(kind), ''), 'NULL') AS kind FROM geo"),
    "src8_links": sql("SELECT cl_from, cl_to, cl_type FROM cl"),
    "src9_redirects": sql("SELECT from_page_id, target_title FROM red"),
    "snk22_index": sql("SELECT page_id, title, CASE WHEN tier = 'hot' THEN 'hot' ELSE 'cold' END AS tier, stream_offset, CASE WHEN tier = 'hot' THEN access_count ELSE 0 END AS access_count FROM art WHERE tier = 'hot' OR stream_offset IS NOT NULL"),
    "snk23_geotags": sql("SELECT page_id, lat, lon, primary_, 'dump' AS kind FROM geo"),
    "snk23_links": sql("SELECT cl_from, cl_to, 'file' AS cl_type FROM cl"),
    "snk23_redirects": sql("SELECT from_page_id, target_title || ' II' AS target_title FROM red"),
    "snk23_processed": sql("SELECT count(*) AS processed FROM red"),
    "src2_index": sql("SELECT stream_offset, page_id, title FROM art WHERE stream_offset IS NOT NULL"),
    "src4_pages": sql("SELECT page_id, title, revision_id, 'See [' || title || ']' AS wikitext FROM art"),
    "src12_revisions": sql("SELECT event_id, event_id AS revid, 0::BIGINT AS parentid, false AS minor, cast(page_id AS VARCHAR) AS \"user\", '' AS timestamp, \"at\" AS size, '' AS comment FROM log"),
    "src14_ranges": sql("WITH x AS (SELECT event_id, event_id % 130 AS a, CASE WHEN event_id % 3 > 0 THEN least(event_id % 210, 99) ELSE 99 END AS b FROM log) SELECT event_id, CASE WHEN a <= b AND a < 100 THEN a END AS first, CASE WHEN a <= b AND a < 100 THEN b END AS last FROM x").replace(") WITH x AS", "), x AS"),
    "snk25_zstd": sql("SELECT page_id, true AS same FROM hot"),
    "w8_links": sql("SELECT page_id, cast(pos AS INTEGER) AS pos, target, trim(replace(target, '_', ' '), '{WS}') IN (SELECT title FROM art) AS available FROM (SELECT page_id, i - 1 AS pos, trim(f[i]) AS target FROM (SELECT page_id, regexp_extract_all(wikitext, '\\[\\[([^\\[\\]|{}<>\\n]+)(?:\\|[^\\[\\]]*)?\\]\\]', 1) AS f FROM hot), unnest(range(1, len(f) + 1)) u(i)) WHERE NOT regexp_matches(lower(target), '^(file|image|category):') AND target <> ''".replace("{WS}", WHITE_SPACE)),
    "w7_references": sql("SELECT page_id, cast(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\[\\[[^\\[\\]|]*\\|([^\\[\\]]*)\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]]*)\\]\\]', '\\1', 'g'), '\\{\\{([^{}|]*)(\\|[^{}]*)?\\}\\}', '{\\1}', 'g'), '''{2,3}', '', 'g')) AS text FROM (SELECT page_id, i - 1 AS pos, f[i] AS t FROM (SELECT page_id, regexp_extract_all(wikitext, '(?s)<ref(?:\\s[^<>]*[^<>/]|\\s*)>(.*?)</ref>', 1) AS f FROM hot), unnest(range(1, len(f) + 1)) u(i))"),
    "w4_infobox": sql("SELECT page_id, trim(name, chr(10) || ' ') AS name, trim(replace(p[1:k - 1], '_', ' '), chr(10) || ' ') AS key, trim(p[k + 1:], chr(10) || ' ') AS value FROM (SELECT page_id, name, p, strpos(p, '=') AS k FROM (SELECT page_id, regexp_extract(b, '^([^|]*)', 1) AS name, unnest(string_split(b, '|')[2:]) AS p FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '\\{\\{([^{}|]*)(\\|[^{}]*)?\\}\\}', '{\\1}', 'g'), '\\[\\[[^\\[\\]|]*\\|([^\\[\\]]*)\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]]*)\\]\\]', '\\1', 'g') AS b FROM (SELECT page_id, unnest(regexp_extract_all(wikitext, '\\{\\{([Ii]nfobox(?:[^{}]|\\{\\{[^{}]*\\}\\})*)\\}\\}', 1)) AS b FROM hot)))) WHERE k > 0 AND trim(p[k + 1:], chr(10) || ' ') <> ''"),
    "q20_toc": sql("SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, level, id, text FROM (SELECT page_id, pos, cast(level AS INTEGER) AS level, 's-' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;') AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) AS n FROM (SELECT *, coalesce(nullif(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'section') AS slug FROM (SELECT page_id, i - 1 AS pos, length(regexp_extract(f[i], '^(=+)', 1)) AS level, trim(trim(f[i], '=')) AS text FROM (SELECT page_id, regexp_extract_all(wikitext, '(?m)^(={2,6}[^=\\n][^\\n]*?={2,6})[ \\t]*$', 1) AS f FROM hot), unnest(range(1, len(f) + 1)) u(i) UNION ALL SELECT page_id, 1000000, 2, 'References' FROM hot WHERE regexp_matches(wikitext, '(?s)<ref(?:\\s[^<>]*[^<>/]|\\s*)>.*?</ref>')))) WHERE level <= 3)"),
    "f6_heading_ids": sql("SELECT page_id, cast(pos AS INTEGER) AS pos, cast(level AS INTEGER) AS level, text, 's-' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) AS n FROM (SELECT *, coalesce(nullif(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'section') AS slug FROM (SELECT page_id, i - 1 AS pos, length(regexp_extract(f[i], '^(=+)', 1)) AS level, trim(trim(f[i], '=')) AS text FROM (SELECT page_id, regexp_extract_all(wikitext, '(?m)^(={2,6}[^=\\n][^\\n]*?={2,6})[ \\t]*$', 1) AS f FROM hot), unnest(range(1, len(f) + 1)) u(i))))"),
    "a10_rolling_errors": sql("SELECT event_id, page_id, \"at\", count(*) OVER (PARTITION BY page_id ORDER BY \"at\" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM log WHERE event_type = 'error'"),
    "st2_token_bucket": sql(
        "SELECT event_id, round(wait, 6) AS wait FROM rec WHERE n > 0", _EVENTS.replace("floor(\"at\" / 40)", "floor(floor(\"at\" / 40) / 100)"),
        "rec AS (SELECT DISTINCT client, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::DOUBLE AS tokens, NULL::DOUBLE AS last, 0::DOUBLE AS wait FROM ev UNION ALL "
        "SELECT client, n, event_id, t - 1, greatest(t_at, coalesce(last, t_at)), CASE WHEN t >= 1 THEN 0 ELSE (1 - t) / 2::DOUBLE END FROM (SELECT e.client, e.n, e.event_id, e.t_at, r.last, CASE WHEN r.n = 0 THEN 2::DOUBLE ELSE least(2::DOUBLE, r.tokens + greatest(0, e.t_at - r.last) * 2::DOUBLE) END AS t FROM rec r JOIN ev e ON e.client = r.client AND e.n = r.n + 1))",
    ),
    "st3_breaker": sql(
        "SELECT event_id, until IS NOT NULL AS is_open FROM rec WHERE n > 0", _EVENTS,
        "rec AS (SELECT DISTINCT client, 0::BIGINT AS n, 0::BIGINT AS event_id, []::DOUBLE[] AS recent, NULL::DOUBLE AS until FROM ev UNION ALL "
        "SELECT client, n, event_id, CASE WHEN len(r1) >= 5 THEN [] ELSE r1 END, CASE WHEN len(r1) >= 5 THEN t_at + 3000 ELSE u0 END FROM ("
        "SELECT *, CASE WHEN u0 IS NULL AND is_error THEN list_append(list_filter(r0, lambda t: t_at - t <= 600), t_at) ELSE r0 END AS r1 FROM ("
        "SELECT e.client, e.n, e.event_id, e.t_at, e.is_error, CASE WHEN r.until IS NOT NULL AND e.t_at >= r.until THEN NULL ELSE r.until END AS u0, CASE WHEN r.until IS NOT NULL AND e.t_at >= r.until THEN [] ELSE r.recent END AS r0 FROM rec r JOIN ev e ON e.client = r.client AND e.n = r.n + 1)))",
    ),
    "st4_history": sql("SELECT page_id, cast(ts AS DATE) AS day, count(*) AS access_count FROM log GROUP BY 1, 2"),
    "st6_first_urls": sql("SELECT DISTINCT 'u' || page_id AS url FROM log"),
}
