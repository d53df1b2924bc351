"""Queries pN_ of the core operators for data integrity and graphs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators import heavy_keys, hierarchy, near, orphans, row_parser
from ..tables import table
from . import rows_sql


def _orphans(s, d):
    return orphans.find_orphans(*(table(s, d, t) for t in ("articles", "redirects", "geotags", "categorylinks")))


def _tree(s, d):
    return hierarchy.Hierarchy(table(s, d, "categorylinks"), table(s, d, "articles"))


def _cells(s):
    """A grid of regions: 15 by 20 degrees at the corners, with great circles for edges."""
    la, lo = "-60.0D + 15 * (id div 18)", "-180.0D + 20 * (id % 18)"
    v = ", ".join(f"struct({a} as lat, {o} as lon)" for a, o in ((la, lo), (la, f"{lo} + 20"), (f"{la} + 15", f"{lo} + 20"), (f"{la} + 15", lo)))
    return s.range(144).selectExpr("id + 1 as region_id", f"array({v}) as vertices")


def _places(s, d):
    """The geotags, and places exactly on corners and edges that regions share."""
    c = _cells(s).selectExpr("region_id", "vertices[0].lat as lat", "vertices[0].lon as lon")
    edge = c.selectExpr("-region_id as page_id", "lat", "lon").unionByName(c.selectExpr("-1000 - region_id as page_id", "lat + 7.5D as lat", "lon"))
    return table(s, d, "geotags").select("page_id", "lat", "lon").unionByName(edge)


QUERIES = {
    "p1_found": lambda s, d: _orphans(s, d).where("kind = 'direct'").select("table_name", "ref_key", "period"),
    "p1_report": lambda s, d: orphans.orphan_report(_orphans(s, d)),
    "p3_found": lambda s, d: near.near_pages(table(s, d, "geotags"), 200.0),
    "p4_found": lambda s, d: row_parser.failed_rows(table(s, d, "raw_rows")).select("raw_id", "reason"),
    "p4_loaded": lambda s, d: row_parser.loaded_rows(table(s, d, "raw_rows")),
    "p5_found": lambda s, d: _tree(s, d).roots(),
    "p3_regions": lambda s, d: near.pages_in_regions(_places(s, d), _cells(s)),
    "p5_paths": lambda s, d: _tree(s, d).paths().withColumn("path", F.array_join("path", " / ")),
    "p5_descendants": lambda s, d: _tree(s, d).descendants(),
    "p6_found": lambda s, d: heavy_keys.category_members(table(s, d, "categorylinks"), 0.02).where("is_heavy").select("category"),
    "p6_members": lambda s, d: heavy_keys.category_profile(table(s, d, "categorylinks"), 0.02),
}


def _norm(c: str) -> str:
    return f"trim(replace({c}, '_', ' '), '{WHITE_SPACE}')"


_LINKS = f"""
  raw AS (SELECT DISTINCT cl_from AS child, {_norm('cl_to')} AS pname FROM categorylinks
          WHERE cl_type = 'subcat' AND cl_from IS NOT NULL AND {_norm('cl_to')} <> ''),
  pages AS (SELECT {_norm('title')}[10:] AS name, min(page_id) AS page FROM articles
            WHERE starts_with({_norm('title')}, 'Category:') AND page_id IS NOT NULL GROUP BY 1),
  links AS (SELECT r.child, r.pname, p.page AS parent FROM raw r
            LEFT JOIN (SELECT * FROM pages WHERE page IN (SELECT child FROM raw)) p ON p.name = r.pname),
  up AS (SELECT child, pname, parent FROM links
         UNION SELECT u.child, l.pname, l.parent FROM up u JOIN links l ON l.child = u.parent)"""

_MEMBERS = f"""
  w AS (SELECT {_norm('cl_to')} AS category, cl_from, cl_type, cast(floor(epoch(cl_timestamp)) AS BIGINT) AS ts
        FROM categorylinks WHERE cl_to IS NOT NULL),
  c AS (SELECT category, cast(count(*) AS BIGINT) AS n_rows, count(DISTINCT cl_from) AS n_members FROM w WHERE category <> '' GROUP BY 1)"""

ORACLES = rows_sql.ORACLES | {
    "p1_found": f"""
      WITH a AS (SELECT page_id, {_norm('title')} AS t, created_at AS lo, coalesce(deleted_at, 9223372036854775807) AS hi FROM articles),
      r AS (SELECT 'geotags' AS table_name, page_id AS page, NULL AS t, loaded_at FROM geotags WHERE page_id IS NOT NULL
            UNION ALL SELECT 'categorylinks', cl_from, NULL, loaded_at FROM categorylinks WHERE cl_from IS NOT NULL
            UNION ALL SELECT 'redirects', NULL, {_norm('target_title')}, loaded_at FROM redirects WHERE {_norm('target_title')} <> ''),
      q AS (SELECT DISTINCT table_name, page, t, cast(floor(epoch(loaded_at)) AS BIGINT) AS sec, strftime(loaded_at, '%Y-%m') AS period FROM r WHERE loaded_at IS NOT NULL)
      SELECT DISTINCT table_name, coalesce(t, cast(page AS VARCHAR)) AS ref_key, period FROM q
      WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = q.page AND a.lo <= q.sec AND q.sec < a.hi)
        AND NOT EXISTS (SELECT 1 FROM a WHERE a.t = q.t AND a.lo <= q.sec AND q.sec < a.hi)""",
    "p1_report": f"""
      WITH RECURSIVE a AS (SELECT DISTINCT page_id AS page, {_norm('title')} AS t, created_at AS lo, coalesce(deleted_at, 9223372036854775807) AS hi FROM articles WHERE created_at < coalesce(deleted_at, 9223372036854775807)),
      r AS (SELECT 'geotags' AS table_name, page_id AS page, loaded_at FROM geotags WHERE page_id IS NOT NULL
            UNION ALL SELECT 'categorylinks', cl_from, loaded_at FROM categorylinks WHERE cl_from IS NOT NULL),
      p AS (SELECT table_name, page, cast(floor(epoch(loaded_at)) AS BIGINT) AS sec, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n FROM r WHERE loaded_at IS NOT NULL GROUP BY ALL),
      pd AS (SELECT *, NOT EXISTS (SELECT 1 FROM a WHERE a.page = p.page AND a.lo <= p.sec AND p.sec < a.hi) AS d FROM p),
      q AS (SELECT {_norm('target_title')} AS t, from_page_id AS owner, cast(floor(epoch(loaded_at)) AS BIGINT) AS sec, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n
            FROM redirects WHERE loaded_at IS NOT NULL AND {_norm('target_title')} <> '' GROUP BY ALL),
      qd AS (SELECT *, NOT EXISTS (SELECT 1 FROM a WHERE a.t = q.t AND a.lo <= q.sec AND q.sec < a.hi) AS d FROM q),
      page_of AS (SELECT t, min(page) AS page FROM a WHERE t IS NOT NULL AND page IS NOT NULL GROUP BY t),
      chain AS (SELECT owner, page, d FROM (SELECT * FROM qd WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner ORDER BY sec DESC, t DESC) = 1) n LEFT JOIN page_of ON page_of.t = n.t),
      dead AS (SELECT owner AS page, 1 AS level FROM chain WHERE d
               UNION SELECT c.owner, dead.level + 1 FROM dead JOIN chain c ON c.page = dead.page AND NOT c.d),
      o AS (SELECT table_name, cast(page AS VARCHAR) AS k, period, 'direct' AS kind, 0 AS level, n FROM pd WHERE d
            UNION ALL SELECT 'redirects', t, period, 'direct', 0, n FROM qd WHERE d
            UNION ALL SELECT table_name, cast(pd.page AS VARCHAR), period, 'inherited', level, n FROM pd JOIN dead ON dead.page = pd.page WHERE NOT d
            UNION ALL SELECT 'redirects', qd.t, period, 'inherited', level, n FROM qd JOIN page_of ON page_of.t = qd.t JOIN dead ON dead.page = page_of.page WHERE NOT d),
      g AS (SELECT table_name, k, period, kind, min(level) AS level, sum(n) AS n FROM o GROUP BY ALL)
      SELECT table_name, period, kind, count(*) AS n_keys, cast(sum(n) AS BIGINT) AS n_rows, cast(max(level) AS INTEGER) AS max_level FROM g GROUP BY ALL""",
    "p3_regions": """
      WITH c AS (SELECT i * 18 + j + 1 AS rid, (-60 + 15 * i)::DOUBLE AS la, (-180 + 20 * j)::DOUBLE AS lo FROM range(8) a(i), range(18) b(j)),
      p AS (SELECT DISTINCT page_id, lat, lon FROM geotags WHERE page_id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
            AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
            UNION ALL SELECT -rid, la, lo FROM c WHERE NOT (la = 0 AND lo = 0) UNION ALL SELECT -1000 - rid, la + 7.5::DOUBLE, lo FROM c),
      v AS (SELECT rid, unnest([0, 1, 2, 3]) AS k, la, lo FROM c),
      e AS (SELECT rid, la, lo, la + CASE WHEN k >= 2 THEN 15 ELSE 0 END AS a1, lo + CASE WHEN k IN (1, 2) THEN 20 ELSE 0 END AS o1, la + CASE WHEN k IN (1, 2) THEN 15 ELSE 0 END AS a2, lo + CASE WHEN k < 2 THEN 20 ELSE 0 END AS o2 FROM v),
      f AS (SELECT rid, la, lo, cos(radians(a1)) * cos(radians(o1)) AS x1, cos(radians(a1)) * sin(radians(o1)) AS y1, sin(radians(a1)) AS z1,
                   cos(radians(a2)) * cos(radians(o2)) AS x2, cos(radians(a2)) * sin(radians(o2)) AS y2, sin(radians(a2)) AS z2 FROM e),
      n AS (SELECT rid, la, lo, y1 * z2 - z1 * y2 AS nx, z1 * x2 - x1 * z2 AS ny, x1 * y2 - y1 * x2 AS nz FROM f),
      h AS (SELECT page_id, lat, lon, rid FROM p JOIN n ON lat BETWEEN la - 3 AND la + 18 AND (lon BETWEEN lo - 0.001 AND lo + 20.001 OR lon + 360 BETWEEN lo - 0.001 AND lo + 20.001 OR lon - 360 BETWEEN lo - 0.001 AND lo + 20.001)
            GROUP BY ALL HAVING bool_and((nx * cos(radians(lat)) * cos(radians(lon)) + ny * cos(radians(lat)) * sin(radians(lon)) + nz * sin(radians(lat))) / sqrt(nx * nx + ny * ny + nz * nz) >= -1e-12))
      SELECT page_id, lat, lon, min(rid) AS region_id FROM h GROUP BY ALL""",
    "p3_found": """
      WITH p AS (SELECT DISTINCT page_id, lat, lon FROM geotags WHERE page_id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
                 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
      q AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) * 6371008.8 AS x, cos(radians(lat)) * sin(radians(lon)) * 6371008.8 AS y,
                   sin(radians(lat)) * 6371008.8 AS z FROM p),
      g AS (SELECT *, cast(floor(x / 250) AS BIGINT) AS i, cast(floor(y / 250) AS BIGINT) AS j, cast(floor(z / 250) AS BIGINT) AS k FROM q),
      o AS (SELECT g.*, i + di AS i2, j + dj AS j2, k + dk AS k2 FROM g, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj), (VALUES (-1), (0), (1)) c(dk))
      SELECT DISTINCT o.page_id AS page_a, g.page_id AS page_b FROM o JOIN g ON o.i2 = g.i AND o.j2 = g.j AND o.k2 = g.k AND o.page_id < g.page_id
      WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(g.lat - o.lat) / 2), 2)
            + cos(radians(o.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - o.lon) / 2), 2)))) <= 200""",
    "p5_found": f"""
      WITH RECURSIVE {_LINKS},
      loops AS (SELECT DISTINCT child FROM up WHERE parent = child)
      SELECT DISTINCT child AS cl_from, pname AS root FROM up WHERE parent IS NULL
      UNION SELECT child, '' FROM up WHERE parent IN (SELECT child FROM loops)""",
    "p5_paths": f"""
      WITH RECURSIVE {_LINKS.split(",\n  up AS")[0]},
      named AS (SELECT page, min(name) AS name FROM pages GROUP BY page),
      l AS (SELECT DISTINCT child, pname, parent, coalesce(name, '') AS name FROM links LEFT JOIN named ON page = child),
      walk AS (SELECT child AS node, pname AS root, 1 AS depth, pname || ' / ' || name AS path, [child] AS seen FROM l WHERE parent IS NULL
               UNION ALL SELECT l.child, root, depth + 1, path || ' / ' || name, list_append(seen, l.child) FROM walk JOIN l ON l.parent = walk.node WHERE NOT list_contains(seen, l.child))
      SELECT node AS cl_from, root, cast(depth AS INTEGER) AS depth, path FROM walk""",
    "p5_descendants": f"""
      WITH RECURSIVE {_LINKS}
      SELECT DISTINCT parent AS ancestor, child AS descendant FROM up WHERE parent IS NOT NULL""",
    "p6_found": f"""
      WITH {_MEMBERS}
      SELECT category FROM c WHERE n_rows >= 0.02 * (SELECT count(*) FROM w)""",
    "p6_members": f"""
      WITH {_MEMBERS},
      m AS (SELECT category, cl_type, count(*) AS k FROM w WHERE category <> '' AND cl_type IS NOT NULL GROUP BY 1, 2),
      best AS (SELECT category, cl_type AS main_type, cast(k AS BIGINT) AS mode_rows FROM m QUALIFY row_number() OVER (PARTITION BY category ORDER BY k DESC, cl_type) = 1),
      med AS (SELECT category, quantile_disc(ts, 0.5) AS median_ts FROM w WHERE ts IS NOT NULL AND category <> '' GROUP BY 1)
      SELECT c.category, n_rows, n_members, n_rows / (SELECT count(*) FROM w) AS share,
             n_rows >= 0.02 * (SELECT count(*) FROM w) AS is_heavy, main_type, mode_rows, median_ts
      FROM c LEFT JOIN best ON best.category = c.category LEFT JOIN med ON med.category = c.category""",
}
