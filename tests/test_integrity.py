"""Problems 1, 3, 4, 5 and 6 against brute force on small tables with all the odd cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from codexmill.operators import heavy_keys, near, orphans, row_parser
from codexmill.operators.hierarchy import Hierarchy

T0 = datetime(2024, 1, 1)


def sec(t):
    return int(t.replace(tzinfo=timezone.utc).timestamp())


# ---- problem 1 ----


def test_orphans(spark):
    day = lambda n, us=0: T0 + timedelta(days=n, microseconds=us)
    articles = spark.createDataFrame(
        [(1, "A_one", sec(day(0)), None, "x"), (1, "A one", sec(day(0)), None, "x"), (2, "B", sec(day(10)), sec(day(20)), "x"), (3, " C ", sec(day(0)), None, "x"), (4, "D", sec(day(0)), None, "x"), (5, None, sec(day(0)), None, "x"), (6, "F", None, None, "x"), (None, "G", sec(day(0)), None, "x")],
        "page_id bigint, title string, created_at bigint, deleted_at bigint, period string",
    )
    redirects = spark.createDataFrame(
        [(3, "Nowhere", day(5)), (4, "C", day(5)), (1, "D", day(5)), (9, "A one ", day(5)), (9, None, day(6)), (9, " _ ", day(6)), (8, "B", day(5)), (8, "B", day(15)), (8, "B", day(20)), (8, "B", day(19, 999999)), (7, "G", day(3)), (7, "B", None)],
        "from_page_id bigint, target_title string, loaded_at timestamp_ntz",
    )
    geotags = spark.createDataFrame([(1, 1.0, day(1)), (2, 1.0, day(5)), (2, 1.0, day(5)), (99, 1.0, day(40)), (None, 1.0, day(1)), (5, 1.0, day(1)), (6, 1.0, day(1))], "page_id bigint, lat double, loaded_at timestamp_ntz")
    links = spark.createDataFrame([(3, "x", day(1)), (4, "x", day(1)), (98, None, day(1)), (1, "y", day(1)), (99, "z", day(32))], "cl_from bigint, cl_to string, loaded_at timestamp_ntz")
    got = {(r.table_name, r.ref_key, r.period, r.kind): (r.level, r.n_rows) for r in orphans.find_orphans(articles, redirects, geotags, links).collect()}
    assert {k[:3] for k in got if k[3] == "direct"} == {
        ("redirects", "Nowhere", "2024-01"), ("redirects", "B", "2024-01"), ("geotags", "2", "2024-01"), ("geotags", "99", "2024-02"), ("geotags", "6", "2024-01"), ("categorylinks", "98", "2024-01"), ("categorylinks", "99", "2024-02"),
    }
    # 3 redirects nowhere, 4 to 3, 1 to 4: what refers to them is orphaned by inheritance.
    assert got[("categorylinks", "3", "2024-01", "inherited")][0] == 1
    assert got[("redirects", "C", "2024-01", "inherited")][0] == 1 and got[("categorylinks", "4", "2024-01", "inherited")][0] == 2
    assert got[("redirects", "D", "2024-01", "inherited")][0] == 2 and got[("geotags", "1", "2024-01", "inherited")][0] == 3
    assert got[("geotags", "2", "2024-01", "direct")] == (0, 2) and got[("redirects", "B", "2024-01", "direct")] == (0, 2)
    empty = [t.limit(0) for t in (articles, redirects, geotags, links)]
    assert orphans.find_orphans(*empty).count() == 0
    report = orphans.orphan_report(orphans.find_orphans(articles, redirects, geotags, links)).collect()
    assert sum(r.n_keys for r in report) == len(got)


# ---- problem 3 ----


def places():
    r = random.Random(2)
    rows = [(i, 52 + r.gauss(0, 0.01), 13 + r.gauss(0, 0.01)) for i in range(300)]
    rows += [(1000 + i, 89.9995 + r.random() * 0.0004, r.uniform(-180, 180)) for i in range(12)]
    rows += [(1100 + i, r.gauss(0, 0.001), r.choice([179.9995, -179.9995]) + r.gauss(0, 0.0003)) for i in range(20)]
    rows += [(1200 + i, -35.26 + r.gauss(0, 0.001), 45 + r.gauss(0, 0.001)) for i in range(20)]  # a corner of the cube
    rows += [(5, rows[0][1], rows[0][2]), (6, rows[0][1], rows[0][2]), (6, rows[0][1], rows[0][2])]
    rows += [(None, 1.0, 1.0), (2000, None, 1.0), (2001, float("nan"), 1.0), (2002, 90.1, 0.0), (2003, 0.0, -0.0), (2004, 1e-9, 0.0), (2005, 0.0, 1e-9), (2006, 0.0, 181.0), (2007, float("inf"), 0.0)]
    return rows


@pytest.mark.parametrize("leaf", [4096, 20])
def test_near_pages(spark, monkeypatch, leaf):
    monkeypatch.setattr(near, "LEAF_POINTS", leaf)
    rows = places()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, lat double, lon double, leaf string")
    ok = [(p, a, o) for p, a, o in rows if p is not None and a is not None and abs(a) <= 90 and abs(o) <= 180 and not (a == 0 and o == 0)]
    lat, lon = np.array([x[1] for x in ok]), np.array([x[2] for x in ok])
    want = set()
    for i, (p, _, _) in enumerate(ok):
        for j in np.flatnonzero(near.distance(lat[i], lon[i], lat, lon) <= 200):
            if p < ok[j][0]:
                want.add((p, ok[j][0]))
    assert {tuple(r) for r in near.near_pages(df).collect()} == want and len(want) > 500
    assert near.near_pages(df.limit(0)).count() == 0


def test_ear_clipping():
    r = random.Random(1)
    for n in (3, 4, 9, 40):
        for turn in (1, -1):
            poly = np.array([[np.cos(a) * k, np.sin(a) * k] for a in np.linspace(0, turn * 2 * np.pi, n, endpoint=False) for k in [r.uniform(0.2, 1)]])
            tri = poly[near.ear_clip(poly)]
            x, y = poly.T
            area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
            a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
            parts = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
            assert len(tri) == n - 2 and np.isclose(parts.sum(), area)
    with pytest.raises(ValueError):
        near.ear_clip(np.array([[0, 0], [1, 1], [0, 0]]))


def test_large_polygon():
    """A coast of very many vertices is triangulated in a moment, and its parts make up its area."""
    import time

    r = random.Random(4)
    angle = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    poly = np.stack([np.cos(angle), np.sin(angle)], 1) * np.array([r.uniform(0.9, 1.1) for _ in angle])[:, None]
    began = time.process_time()
    tri = poly[near.ear_clip(poly)]
    assert time.process_time() - began < 20
    x, y = poly.T
    (a, b, c) = tri[:, 0], tri[:, 1], tri[:, 2]
    parts = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    assert (parts > 0).all() and np.isclose(parts.sum(), (np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)
    with pytest.raises(ValueError):
        near.ear_clip(np.array([[0, 0], [2, 2], [2, 0], [0, 2], [1, 3], [-1, 1.5]]))


def test_regions(spark):
    pts = [(i, -3.0137 + 0.37 * i, -2.9911 + 0.29 * j) for i in range(17) for j in range(21)]
    df = spark.createDataFrame([(*p, True) for p in pts], "page_id bigint, lat double, lon double, primary_ boolean")
    star = [(-2, -2), (0, -0.5), (2, -2), (0.5, 0), (2, 2), (0, 0.5), (-2, 2), (-0.5, 0)]
    square = [(1.0, 1.0), (1.0, 3.5), (3.5, 3.5), (3.5, 1.0)]
    regions = spark.createDataFrame([(2, [{"lat": float(a), "lon": float(o)} for a, o in star]), (1, [{"lat": a, "lon": o} for a, o in square]), (None, None), (0, [{"lat": 0.0, "lon": 0.0}, {"lat": None, "lon": 9.0}, {"lat": 9.0, "lon": float("nan")}])], "region_id bigint, vertices array<struct<lat double, lon double>>")
    got = {(r.page_id, r.lat, r.lon): r.region_id for r in near.pages_in_regions(df, regions).collect()}

    def inside(poly, lat, lon):
        odd = False
        for (a, b), (c, d) in zip(poly, poly[1:] + poly[:1]):
            if (b > lon) != (d > lon) and lat < (c - a) * (lon - b) / (d - b) + a:
                odd = not odd
        return odd

    for p in pts:
        want = [i for i, poly in ((1, square), (2, star)) if inside(poly, p[1], p[2])]
        edge = min(abs(p[1] - x) for x in (1, 3.5)) < 0.01 or min(abs(p[2] - x) for x in (1, 3.5)) < 0.01
        if not edge:  # great circles are not quite straight in degrees
            assert got.get(p) == (min(want) if want else None), p


def convex(vertices, lat, lon):
    """Whether a place is in a convex region of great-circle edges, on an edge (within some micrometres) included."""
    v, p = near.unit(*np.array(vertices, float).T), near.unit(np.array(lat), np.array(lon))
    n = np.cross(v, np.roll(v, -1, axis=0))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    return v.mean(0) @ p > 0 and ((n @ p >= -near.EDGE).all() or (n @ p <= near.EDGE).all())


def test_shared_edges_wide_regions_and_poles(spark):
    grid = [(10 * i + j, [(a, o), (a, o + 10), (a + 10, o + 10), (a + 10, o)]) for i, a in enumerate(range(30, 60, 10)) for j, o in enumerate(range(30, 70, 10))]
    wide = [(900, [(40, 20), (40, 100), (75, 100), (75, 20)]), (901, [(70.0, o) for o in range(-180, 180, 30)]), (902, [(-5, 150), (-5, -150), (5, -150), (5, 150)])]
    regions = grid + wide
    pts = [(a, o) for _, v in grid for a, o in v] + [(a + 5.0, o) for _, v in grid for a, o in v[:1]]  # corners, and on shared meridians
    r = random.Random(5)
    pts += [(r.uniform(-10, 90), r.uniform(-180, 180)) for _ in range(400)] + [(90.0, 0.0), (70.0, 30.0), (0.5, 180.0), (0.5, -180.0)]
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(pts)], "page_id bigint, lat double, lon double")
    rs = spark.createDataFrame([(i, [{"lat": float(a), "lon": float(o)} for a, o in v]) for i, v in regions], "region_id bigint, vertices array<struct<lat double, lon double>>")
    got = {x.page_id: x.region_id for x in near.pages_in_regions(df, rs).collect()}
    for i, (a, o) in enumerate(pts):
        want = [k for k, v in regions if convex(v, a, o)]
        assert got.get(i) == (min(want) if want else None), (a, o)
    assert near.pages_in_regions(df.limit(0), rs).count() == near.pages_in_regions(df, rs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near.region_triangles([(0, 0), (0, 120), (0, -120)])


# ---- problem 4 ----

LINES = [
    ("redirect", "(5,0,'Tom','','')", None), ("redirect", "  (5,0,'Tom','','') ;", None), ("redirect", "(5,0,'T''om','','x'),", None), ("redirect", r"(5,0,'T\'om','',''),", None),
    ("redirect", "('5','0','Tom','','')", None), ("redirect", "(5, -1 ,Tom,NULL,)", None), ("redirect", "(5,0,'NULL','','')", None),
    ("redirect", "(5,0,'Tom,'','')", "quoting"), ("redirect", "(5,0,'Tom'x,'','')", "quoting"), ("redirect", "(5,0,To'm,'','')", "quoting"), ("redirect", "5,0,To'm", "quoting"), ("redirect", r"(5,0,'Tom\'", "quoting"),
    ("redirect", None, "column_count"), ("redirect", "", "column_count"), ("redirect", "(5,0,'Tom','')", "column_count"), ("redirect", "5,0,'Tom','','')", "column_count"), ("redirect", "(5,0,'Tom','',''", "column_count"),
    ("redirect", "(5,0,'Tom','',''),;", "column_count"), ("redirect", "(5,0,'Tom','',''),(5,0,'Tom','','')", "column_count"), ("redirect", "(5,0,'a)b','','')x", "column_count"), (None, "(5,0,'Tom','','')", "column_count"), ("other", "(5)", "column_count"),
    ("redirect", "(0,0,'Tom','','')", "bad_value"), ("redirect", "(-5,0,'Tom','','')", "bad_value"), ("redirect", "(٥,0,'Tom','','')", "bad_value"), ("redirect", "(5,x,'Tom','','')", "bad_value"), ("redirect", "(5,0,NULL,'','')", "bad_value"),
    ("redirect", "(5,0,'_ _','','')", "bad_value"), ("redirect", "(5,0,'a|b','','')", "bad_value"), ("redirect", "(5,0,'" + "é" * 128 + "','','')", "bad_value"), ("redirect", "(5,0,'" + "é" * 127 + "','','')", None), ("redirect", "(5,0,'　','','')", "bad_value"),
    ("categorylinks", "(5,'C','s','t','','u','page')", None), ("categorylinks", "(5,'C','s','t','','u','Page')", "bad_value"), ("categorylinks", "(5,'C',' )(','t','','u','file'),", None),
    ("geo_tags", "(1,5,'earth',1,-90.0,180,500,'city','a b',NULL,NULL)", None), ("geo_tags", "(1,5,'earth',1,7E-3,+4.5e1,500,NULL,'',NULL,NULL)", None), ("geo_tags", "(1,5,'earth',1,90.01,0,500,NULL,'',NULL,NULL)", "bad_value"),
    ("geo_tags", "(1,5,'earth',1,1.,0,500,NULL,'',NULL,NULL)", "bad_value"), ("geo_tags", "(1,5,'earth',1,.5,0,500,NULL,'',NULL,NULL)", "bad_value"), ("geo_tags", "(1,5,'earth',1,nan,0,500,NULL,'',NULL,NULL)", "bad_value"), ("geo_tags", "(1,5,'earth',1,1,180.0001,500,NULL,'',NULL,NULL)", "bad_value"),
    ("redirect", "(5,0,'T','','" + r"\'" * 20_000 + "')", None), ("redirect", "(5,0,'T','','" + "''" * 20_000 + "')", None), ("redirect", "(5,0,'T','','" + "x" * 200_000, "quoting"),
]


def test_row_parser(spark):
    df = spark.createDataFrame([(i, t, i, x, "r") for i, (t, x, _) in enumerate(LINES)], "raw_id bigint, dump_table string, line_no bigint, line string, reason string")
    got = {r.raw_id: r.reason for r in row_parser.failed_rows(df).collect()}
    assert {i: got.get(i) for i in range(len(LINES))} == {i: w for i, (_, _, w) in enumerate(LINES)}
    for t, x, want in LINES:  # the patterns for whole rows accept nothing that the grammar refuses
        assert row_parser.diagnose(x, t)[0] == want, x
    rows = {r.raw_id: r for r in row_parser.loaded_rows(df).collect()}
    assert set(rows) == {i for i, (_, _, w) in enumerate(LINES) if w is None}
    assert [rows[i].title for i in (0, 2, 3, 4, 6)] == ["Tom", "T'om", "T'om", "Tom", "NULL"] and rows[4].page_id == 5
    geo = [r for r in rows.values() if r.dump_table == "geo_tags"]
    assert sorted((r.lat, r.lon, r.kind) for r in geo) == [(-90.0, 180.0, "city"), (0.007, 45.0, None)]
    assert row_parser.failed_rows(df.limit(0)).count() == 0


# ---- problem 5 ----


def hierarchy_case(seed, n, extra):
    r = random.Random(seed)
    links = [(i, f"N{r.randrange(i)}" if i and r.random() < 0.9 else f"top{r.randrange(3)}") for i in range(n)]
    links += [(r.randrange(n), f"N{r.randrange(n)}") for _ in range(extra)]
    return links


def brute_hierarchy(links, pages):
    parents = defaultdict(set)
    for c, p in links:
        parents[c].add(p)
    up = {c: {pages[p] if pages.get(p) in parents else None: p for p in ps} for c, ps in parents.items()}
    node = {c: [pages[p] for p in ps if pages.get(p) in parents] for c, ps in parents.items()}
    tops = {c: [p for p in ps if pages.get(p) not in parents] for c, ps in parents.items()}
    roots, desc, above = set(), set(), {}
    for c in parents:
        seen, todo = set(), [c]
        while todo:
            for p in node[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        above[c] = seen
        desc |= {(a, c) for a in seen}
        roots |= {(c, t) for x in seen | {c} for t in tops[x]}
    for c in parents:
        if any(x in above[x] for x in above[c] | {c}):
            roots.add((c, ""))
    del up
    return roots, desc, node, tops


@pytest.mark.parametrize("links", [hierarchy_case(1, 60, 0), hierarchy_case(2, 60, 12), [(i, f"N{i - 1}") for i in range(1, 70)], [(0, "N0"), (1, "N2"), (2, "N1"), (3, "N2"), (4, "N3"), (4, "topX"), (5, "N6"), (6, "N7"), (7, "N5"), (7, "N4")]])
def test_hierarchy(spark, links):
    pages = {f"N{i}": i for i in range(80)}
    rows = [(c, p.replace("N", " N") + "_", "subcat", "x") for c, p in links] + [(None, "N1", "subcat", "x"), (3, None, "subcat", "x"), (3, " ", "subcat", "x"), (3, "N4", "page", "x"), (3, "N5", "Subcat", "x")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "cl_from bigint, cl_to string, cl_type string, piece string")
    articles = spark.createDataFrame([(i, f"Category:N{i}_", "x") for i in range(80)] + [(None, "Category:zz", "x"), (500, "N1", "x"), (501, None, "x")], "page_id bigint, title string, parent string")
    roots, desc, node, tops = brute_hierarchy(links, pages)
    h = Hierarchy(df, articles)
    assert {tuple(r) for r in h.roots().collect()} == roots
    assert {tuple(r) for r in h.descendants().collect()} == desc
    endless = {c for c, t in roots if t == ""}

    def paths(c):
        return [(t, f"N{c}") for t in tops[c]] + [(*q, f"N{c}") for p in node[c] for q in paths(p)]

    got = sorted((r.cl_from, tuple(r.path), r.depth) for r in h.paths().collect() if r.cl_from not in endless)
    assert got == sorted((c, q, len(q) - 1) for c in node if c not in endless for q in paths(c))


def test_many_parents(spark):
    """Every node has two parents: what is met on the way stays near the size of the answer."""
    n = 20_000
    links = [(i, f"N{p}") for i in range(4, n) for p in {i // 2, i // 3}] + [(i, f"top{i}") for i in range(4)]
    df = spark.createDataFrame([(c, p, "subcat") for c, p in links], "cl_from bigint, cl_to string, cl_type string")
    articles = spark.createDataFrame([(i, f"Category:N{i}") for i in range(n)], "page_id bigint, title string")
    roots, _, _, _ = brute_hierarchy(links, {f"N{i}": i for i in range(n)})
    h = Hierarchy(df, articles)
    assert {tuple(r) for r in h.roots().collect()} == roots


def test_empty_hierarchy(spark):
    h = Hierarchy(spark.createDataFrame([], "cl_from bigint, cl_to string, cl_type string"), spark.createDataFrame([], "page_id bigint, title string"))
    assert h.roots().count() == h.descendants().count() == h.paths().count() == 0


# ---- problem 6 ----


def test_heavy_keys(spark):
    r = random.Random(3)
    rows = [("Big_one" if r.random() < 0.5 else f"k{r.randrange(40)}", r.randrange(30) if r.random() < 0.9 else None, r.choice(["page", "file", None]), T0 + timedelta(hours=r.randrange(3000)) if r.random() < 0.9 else None) for _ in range(600)]
    rows += [(None, 1, "page", T0), (" _", 1, "page", T0), (" Big one", 1, "page", T0), ("void", None, None, None)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "cl_to string, cl_from bigint, cl_type string, cl_timestamp timestamp_ntz, weight int")
    groups = defaultdict(list)
    for x in rows:
        if x[0] is not None:
            groups[x[0].replace("_", " ").strip()].append(x)
    total = sum(map(len, groups.values()))
    got = {r.category: r for r in heavy_keys.category_profile(df, 0.02).collect()}
    assert set(got) == set(groups) - {""}
    for k, g in groups.items():
        if not k:
            continue
        x = got[k]
        assert (x.n_rows, x.n_members, x.is_heavy) == (len(g), len({v[1] for v in g} - {None}), len(g) >= 0.02 * total)
        types = [v[2] for v in g if v[2]]
        assert x.main_type == (min(set(types), key=lambda t: (-types.count(t), t)) if types else None)
        stamps = sorted(sec(v[3]) for v in g if v[3])
        assert x.median_ts == (stamps[(len(stamps) + 1) // 2 - 1] if stamps else None)
    assert heavy_keys.category_profile(df.limit(0)).count() == 0
