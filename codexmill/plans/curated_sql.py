"""The cleaned tables in DuckDB's SQL, as common table expressions for the oracles."""

from __future__ import annotations

import re

from ..functions.text import WHITE_SPACE


def norm(c: str) -> str:
    return f"trim(replace({c}, '_', ' '), '{WHITE_SPACE}')"


def _latest(source: str, keys: str, order: str) -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order.split(", "))
    return f"SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {by}) = 1"


_A = "page_id, tier, pinned, stream_offset, stream_length, revision_id, last_accessed, access_count, created_at, updated_at"
_SECONDS = "cast(floor(epoch({})) AS BIGINT)"
TABLES = {
    "art": _latest(
        f"SELECT {_A}, {norm('title')} AS title FROM articles WHERE page_id IS NOT NULL AND deleted_at IS NULL AND {norm('title')} <> ''",
        "page_id", "updated_at, created_at, revision_id, title, tier, pinned, stream_offset, stream_length, last_accessed, access_count",
    ),
    "hot": _latest("SELECT page_id, wikitext, loaded_at, revision_id FROM hot_content WHERE page_id IS NOT NULL AND wikitext IS NOT NULL", "page_id", "loaded_at, revision_id, wikitext"),
    "geo": "SELECT page_id, lat, lon, primary_, kind FROM ("
    + _latest("SELECT page_id, lat, lon, coalesce(primary_, false) AS primary_, kind, loaded_at FROM geotags WHERE page_id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180", "page_id, lat, lon", "loaded_at, primary_, kind") + ")",
    "cl": "SELECT cl_from, cl_to, cl_type FROM ("
    + _latest(f"SELECT cl_from, replace({norm('cl_to')}, ' ', '_') AS cl_to, cl_type, cl_timestamp, loaded_at FROM categorylinks WHERE cl_from IS NOT NULL AND cl_type IN ('page', 'subcat', 'file') AND {norm('cl_to')} <> ''", "cl_from, cl_to", "loaded_at, cl_timestamp, cl_type") + ")",
    "red": _latest(f"SELECT from_page_id, {norm('target_title')} AS target_title, loaded_at FROM redirects WHERE from_page_id IS NOT NULL AND {norm('target_title')} <> ''", "from_page_id", "loaded_at, target_title"),
    "emb": "SELECT vec_id AS page_id, embedding, 'm' || (label % 2) AS model FROM embeddings",
    "fold": f"SELECT name, id, CASE WHEN id % 2 = 0 THEN id - 1 END AS parent_id, created_at FROM (SELECT o_orderpriority AS name, cast(o_orderpriority[1:1] AS BIGINT) AS id, {_SECONDS.format('min(o_orderdate)')} AS created_at FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)",
    "book": f"SELECT o_orderkey AS id, 'Article ' || (o_orderkey % 5000) AS article_title, CASE WHEN o_orderstatus <> 'P' THEN cast(o_orderpriority[1:1] AS BIGINT) END AS folder_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note, {_SECONDS.format('o_orderdate')} AS created_at FROM orders",
    "rev": "SELECT title, revision_id, fetched_at, wikitext, id * 1000000 + revision_id % 1000000 AS id, CASE WHEN (id * 1000000 + revision_id % 1000000) % 4 = 0 THEN 'Keep for later' END AS user_note FROM ("
    + _latest(f"SELECT 'Page ' || page_id AS title, revision_id, {_SECONDS.format('loaded_at')} AS fetched_at, wikitext, page_id AS id FROM hot_content WHERE page_id IS NOT NULL AND revision_id IS NOT NULL AND wikitext IS NOT NULL", "title, revision_id", "fetched_at, wikitext, id") + ")",
    "mod": "SELECT lower(replace(r_name, ' ', '-')) AS id, r_name AS name, 'warm' AS default_tier, cast(r_regionkey AS BIGINT) AS installed_at FROM region",
    "mem": "SELECT lower(replace(r_name, ' ', '-')) AS module_id, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey",
    "log": f"SELECT event_id, user_id AS page_id, {_SECONDS.format('ts')} AS \"at\", ts, event_type, value FROM events",
}


def sql(body: str, *more: str) -> str:
    """``body`` behind the expressions it names; ``more``: further ones as 'name AS (...)'."""
    text = " ".join([body, *more])
    used = [f"{k} AS MATERIALIZED ({q})" for k, q in TABLES.items() if re.search(rf"\b{k}\b", text)]
    return "WITH RECURSIVE " + ", ".join([*used, *more]) + " " + body if used or more else body
