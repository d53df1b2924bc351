"""Points near other points or inside regions (problem 3).

Regions are polygons on the sphere. Each is projected gnomonically from its own centre, where
great-circle edges are straight lines, and triangulated by ear clipping; its triangles are clipped
to the faces of a cube they reach, so a region may be as wide as a hemisphere. A disc around a
point is the circumscribed square, itself two triangles. A tree of bounding boxes over the cube faces,
fitted on a bounded sample of the points, distributes triangles (to every leaf whose box they
touch) and points (to exactly one leaf). Inside a leaf a second hierarchy of bounding boxes over
the triangles yields candidates, which are tested exactly. A point on a boundary shared by two
triangles or two leaves is found more than once and deduplicated; a point on the boundary of two
regions goes to the smaller region id if one region per point is wanted.

Scale: points that share a location are joined as one location and only expanded to pages at the
end; the number of leaves follows the number of locations, so a leaf holds a bounded number of
points however crowded a town is, up to ``MAX_LEAVES`` times ``LEAF_POINTS`` locations (268
million). The tree is the only thing broadcast: at most ``MAX_LEAVES`` leaves (some 5 MB). The
sample of at most ``SAMPLE`` rows only steers the split, every row is indexed. Results of a leaf
leave it in blocks, never as one table. The poles and the date line need no special care on the
cube. Points within ``EDGE`` of a triangle's edge (some 6 micrometres) count as on it, so rounding
opens no gap between neighbours.

Defined cases: rows with null page, null, NaN, infinite or out-of-range coordinates and those at
exactly (0, 0) are no places; repeated rows count once; -0.0 equals 0.0; empty tables give no
rows; extra columns are ignored. Regions need three distinct vertices, no edge that crosses
another, and must lie within a hemisphere; others raise ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the radius in metres of the sphere on which distances are measured.
EARTH_RADIUS = 6_371_008.8
#: Rows on which the tree of boxes is fitted at most, most leaves it may have, points wanted in a leaf.
SAMPLE, MAX_LEAVES, LEAF_POINTS = 1_000_000, 65_536, 4_096
#: Distance from an edge, in radii, within which a point is on it.
EDGE = 1e-12
_NEAREST = 0.1  # a face's plane takes vertices whose component along its axis is at least this


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1)


def face_of(p: np.ndarray) -> np.ndarray:
    """0..5: twice the axis with the largest component, plus one if it is negative."""
    axis = np.abs(p).argmax(-1)
    return 2 * axis + (np.take_along_axis(p, axis[..., None], -1)[..., 0] < 0)


def project(p: np.ndarray, face: int) -> tuple[np.ndarray, np.ndarray]:
    """((u, v) in the face's plane, component along its axis)."""
    axis = face // 2
    d = p[..., axis] * (-1 if face % 2 else 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([p[..., (axis + 1) % 3] / d, p[..., (axis + 2) % 3] / d], -1), d


def disc_squares(lat: np.ndarray, lon: np.ndarray, metres: float) -> np.ndarray:
    """(n, 4, 3): corners, on rays from the centre of the sphere, of the square around each disc."""
    c = unit(lat, lon)
    helper = np.zeros_like(c)
    np.put_along_axis(helper, np.abs(c).argmin(-1)[:, None], 1.0, -1)
    e1 = np.cross(c, helper)
    e1 /= np.linalg.norm(e1, axis=-1, keepdims=True)
    e2 = np.cross(c, e1)
    t = math.tan(metres / EARTH_RADIUS) * (1 + 1e-6) + 1e-12
    return np.stack([c + t * (a * e1 + b * e2) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))], 1)


def square_triangles(squares: np.ndarray, face: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, 3, 2) triangles on one face and the square each is of.

    Clipping any ear off a convex quadrangle leaves one more triangle, so all are cut at once.
    """
    uv, d = project(squares, face)
    lo, hi = uv.min(1), uv.max(1)
    own = np.flatnonzero((d > _NEAREST).all(1) & (lo <= 1).all(1) & (hi >= -1).all(1))
    q = uv[own]
    return np.concatenate([q[:, [0, 1, 2]], q[:, [0, 2, 3]]]), np.concatenate([own, own])


def edges_cross(p: np.ndarray) -> bool:
    """Whether two edges of a ring of (n, 2) vertices cross in their interiors; an edge meets only those in its range of x."""
    a, b = p, np.roll(p, -1, axis=0)
    order = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b = a[order], b[order]
    lo, hi = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    last = np.searchsorted(lo, hi, "right")

    def side(u, v, q):
        return (v[..., 0] - u[..., 0]) * (q[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (q[..., 0] - u[..., 0])

    for k in range(len(p)):
        c, d = a[k + 1 : last[k]], b[k + 1 : last[k]]
        if len(c) and ((side(a[k], b[k], c) * side(a[k], b[k], d) < 0) & (side(c, d, a[k]) * side(c, d, b[k]) < 0)).any():
            return True
    return False


def ear_clip(poly: np.ndarray) -> np.ndarray:
    """(m, 3): vertex numbers of the triangles of a simple polygon given by its (n, 2) vertices in either direction.

    Only vertices that do not turn outwards can lie in an ear; they are kept in order of x, so an ear
    is tested against those in its range alone.
    """
    p = np.asarray(poly, float)
    ring = np.flatnonzero((p != np.roll(p, 1, axis=0)).any(1))
    if len(np.unique(p[ring], axis=0)) < 3:
        raise ValueError("a region needs three distinct vertices")
    x, y = p[ring].T
    if np.dot(x, np.roll(y, -1)) < np.dot(y, np.roll(x, -1)):
        ring = ring[::-1]
    p = p[ring]
    n = len(p)
    if edges_cross(p):
        raise ValueError("the region's edges cross one another")

    def turn(a, b, c):
        return (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])

    every = np.arange(n)
    inward = np.flatnonzero(turn(np.roll(every, 1), every, np.roll(every, -1)) <= 0)
    inward = inward[np.argsort(p[inward, 0], kind="stable")]
    xs, alive = p[inward, 0], np.ones(n, bool)
    before, after = np.roll(every, 1).tolist(), np.roll(every, -1).tolist()

    def is_ear(a: int, b: int, c: int) -> bool:
        t = p[[a, b, c]]
        near = inward[np.searchsorted(xs, t[:, 0].min(), "left") : np.searchsorted(xs, t[:, 0].max(), "right")]
        near = near[alive[near]]
        q = p[near]
        inside = np.ones(len(near), bool)
        for i in range(3):
            u, v = t[i], t[(i + 1) % 3]
            inside &= (v[0] - u[0]) * (q[:, 1] - u[1]) - (v[1] - u[1]) * (q[:, 0] - u[0]) >= 0
            inside &= (q != u).any(1)
        return not inside.any()

    out, left, k, idle = [], n, 0, 0
    while left > 3:
        a, c = before[k], after[k]
        t = turn(a, k, c)
        if t == 0 or (t > 0 and is_ear(a, k, c)):
            if t > 0:
                out.append((a, k, c))
            after[a], before[c], alive[k] = c, a, False
            left, k, idle = left - 1, c, 0
        else:
            k, idle = c, idle + 1
            if idle > left:
                raise ValueError("the region's edges touch one another")
    if turn(before[k], k, after[k]) > 0:
        out.append((before[k], k, after[k]))
    return ring[np.array(out, np.int64).reshape(-1, 3)]


def _clip(poly: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a convex polygon (n, 3), seen from the centre of the sphere, on one side of a plane through it."""
    side = poly @ normal
    if (side >= 0).all():
        return poly
    out = []
    for k in range(len(poly)):
        a, b, x, y = poly[k - 1], poly[k], side[k - 1], side[k]
        if (x >= 0) != (y >= 0):
            out.append((a * y - b * x) / (y - x))  # where the edge meets the plane
        if y >= 0:
            out.append(b)
    return np.array(out).reshape(-1, 3)


def region_triangles(vertices: list[tuple[float, float]]) -> list[tuple[int, np.ndarray]]:
    """(face, triangles) for every cube face that a polygon of (lat, lon) vertices reaches."""
    p = unit(*np.array(vertices, float).T)
    centre = p.mean(0)
    length = np.linalg.norm(centre)
    if length < 1e-9 or (p @ centre / length < 1e-3).any():
        raise ValueError("a region must lie within a hemisphere")
    centre /= length
    e1 = np.cross(centre, np.eye(3)[np.abs(centre).argmin()])
    e1 /= np.linalg.norm(e1)
    flat = np.stack([p @ e1, p @ np.cross(centre, e1)], 1) / (p @ centre)[:, None]
    triangles = p[ear_clip(flat)]
    out = []
    for face in range(6):
        axis = np.eye(3)[face // 2] * (-1 if face % 2 else 1)
        # The four planes of the face's pyramid, moved out a little, so that points on its border are inside.
        planes = [axis * (1 + 1e-9) + sign * np.eye(3)[k] for k in range(3) if k != face // 2 for sign in (1, -1)]
        sides = np.stack([triangles @ plane for plane in planes])  # (4, triangles, 3)
        inside = (sides >= 0).all((0, 2))
        found = list(project(triangles[inside], face)[0])
        for t in triangles[~inside & ~(sides < 0).all(2).any(0)]:
            for plane in planes:
                t = _clip(t, plane)
                if len(t) < 3:
                    break
            else:
                uv = project(t, face)[0]
                found += [uv[[0, k, k + 1]] for k in range(1, len(uv) - 1)]
        if found:
            out.append((face, np.array(found)))
    return out


class BoxTree:
    """Boxes over the six faces; every leaf is half-open, so a point has exactly one."""

    def __init__(self, face: np.ndarray, uv: np.ndarray, leaves: int):
        self.axis, self.split, self.kids, self.leaf = [-1] * 6, [0.0] * 6, [(-1, -1)] * 6, [-1] * 6
        self.n_leaves = 0
        most = max(1.0, len(uv) / max(1, leaves))
        todo = [(f, uv[face == f]) for f in range(6)]
        while todo:
            node, own = todo.pop()
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(2)
            a = int(spread.argmax())
            cut = float(np.median(own[:, a])) if len(own) else 0.0
            below = own[:, a] < cut
            if len(own) <= most or spread[a] <= 0 or not below.any():
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            k = len(self.axis)
            for x, v in ((self.axis, -1), (self.split, 0.0), (self.kids, (-1, -1)), (self.leaf, -1)):
                x.extend([v, v])
            self.axis[node], self.split[node], self.kids[node] = a, cut, (k, k + 1)
            todo += [(k, own[below]), (k + 1, own[~below])]
        self.axis, self.split, self.leaf, self.kids = np.array(self.axis), np.array(self.split), np.array(self.leaf), np.array(self.kids)

    def place(self, face: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for every leaf that each box touches; a point is a box with lo = hi."""
        box, node = np.arange(len(lo)), np.asarray(face, np.int64).copy()
        found = []
        while len(box):
            end = self.leaf[node] >= 0
            found.append((box[end], self.leaf[node[end]]))
            box, node = box[~end], node[~end]
            a, s = self.axis[node], self.split[node]
            left, right = lo[box, a] < s, hi[box, a] >= s
            kids = self.kids[node]
            box, node = np.concatenate([box[left], box[right]]), np.concatenate([kids[left, 0], kids[right, 1]])
        return (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def points_in_triangles(tri: np.ndarray, pts: np.ndarray, block: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (triangle, point) index pairs, borders included, through a hierarchy of boxes."""
    if not len(tri) or not len(pts):
        return
    mid = tri.mean(1)
    lo, hi = mid.min(0), mid.max(0)
    grid = ((mid - lo) / np.where(hi > lo, hi - lo, 1) * 65_535).astype(np.uint64)
    code = np.zeros(len(tri), np.uint64)
    for b in range(16):  # Morton order keeps neighbours together
        for a in range(2):
            code |= ((grid[:, a] >> np.uint64(b)) & np.uint64(1)) << np.uint64(2 * b + a)
    order = code.argsort(kind="stable")
    boxes = [np.concatenate([tri[order].min(1), -tri[order].max(1)], 1) - 2 * EDGE]  # lower corner, negated upper corner
    while len(boxes[-1]) > 1:
        x = boxes[-1]
        if len(x) % 2:
            x = np.concatenate([x, x[-1:]])
        boxes.append(np.minimum(x[::2], x[1::2]))
    for at in range(0, len(pts), block):
        p = np.arange(at, min(at + block, len(pts)))
        node = np.zeros(len(p), np.int64)
        for level in range(len(boxes) - 1, -1, -1):
            b, q = boxes[level][node], pts[p]
            keep = (b[:, 0] <= q[:, 0]) & (b[:, 1] <= q[:, 1]) & (-b[:, 2] >= q[:, 0]) & (-b[:, 3] >= q[:, 1])
            p, node = p[keep], node[keep]
            if level:
                kids = np.concatenate([2 * node, 2 * node + 1])
                p = np.concatenate([p, p])
                real = kids < len(boxes[level - 1])
                p, node = p[real], kids[real]
        t = order[node]
        a, b, c, q = tri[t, 0], tri[t, 1], tri[t, 2], pts[p]
        turn = np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        hit = turn != 0  # a triangle without area holds nothing that its neighbours don't
        for x, y in ((a, b), (b, c), (c, a)):
            d = y - x
            hit &= turn * (d[:, 0] * (q[:, 1] - x[:, 1]) - d[:, 1] * (q[:, 0] - x[:, 0])) >= -EDGE * np.hypot(d[:, 0], d[:, 1])
        yield t[hit], p[hit]


def distance(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle metres by the haversine formula."""
    a, b, c, d = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def clean_places(geotags: DataFrame) -> DataFrame:
    """Distinct (page_id, lat, lon) of the usable tags."""
    plus = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return (
        geotags.select("page_id", "lat", "lon")
        .where("page_id is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")
        .where(~F.isnan("lat") & ~F.isnan("lon"))
        .select("page_id", plus("lat"), plus("lon"))
        .distinct()
    )


def fit_tree(locations: DataFrame) -> BoxTree:
    n = locations.count()
    leaves = min(MAX_LEAVES, -(-n // LEAF_POINTS))
    wanted = min(SAMPLE, max(20_000, 32 * leaves))
    rows = locations.sample(min(1.0, 0.9 * wanted / max(n, 1)), seed=7).limit(wanted).toPandas()
    face, uv = _points_on_faces(rows["lat"].to_numpy(float), rows["lon"].to_numpy(float))
    return BoxTree(face, uv, leaves)


def _points_on_faces(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = unit(lat, lon)
    face = face_of(p)
    uv = np.empty((len(p), 2))
    for f in range(6):
        uv[face == f] = project(p[face == f], f)[0]
    return face, uv


def near_locations(locations: DataFrame, metres: float) -> DataFrame:
    """Pairs of different locations within ``metres``: lat_a, lon_a, lat_b, lon_b, metres; a < b."""
    spark = locations.sparkSession
    tree = spark.sparkContext.broadcast(fit_tree(locations))

    def distribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tree.value
        for x in batches:
            lat, lon = x["lat"].to_numpy(float), x["lon"].to_numpy(float)
            face, uv = _points_on_faces(lat, lon)
            own, leaf = t.place(face, uv, uv)
            home = np.empty(len(lat), np.int64)
            home[own] = leaf
            # A place's row in its own leaf stands for the point and for its disc.
            yield pd.DataFrame({"leaf": home, "disc": False, "face": face, "lat": lat, "lon": lon})
            squares = disc_squares(lat, lon, metres)
            for f in range(6):
                tri, sq = square_triangles(squares, f)
                if len(tri):
                    k, leaf = t.place(np.full(len(tri), f), tri.min(1), tri.max(1))
                    away = leaf != home[sq[k]]
                    if away.any():
                        both = np.unique(sq[k[away]] * t.n_leaves + leaf[away])
                        i = both // t.n_leaves
                        yield pd.DataFrame({"leaf": both % t.n_leaves, "disc": True, "face": f, "lat": lat[i], "lon": lon[i]})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches))
        lat, lon, disc = x["lat"].to_numpy(), x["lon"].to_numpy(), x["disc"].to_numpy()
        f = int(x["face"].iloc[0])  # a leaf lies on one face
        d, p = np.arange(len(x)), np.flatnonzero(~disc)
        tri, sq = square_triangles(disc_squares(lat[d], lon[d], metres), f)
        pts = project(unit(lat[p], lon[p]), f)[0]
        for t, q in points_in_triangles(tri, pts):
            a, b = d[sq[t]], p[q]
            first = (lat[a] < lat[b]) | ((lat[a] == lat[b]) & (lon[a] < lon[b]))
            a, b = a[first], b[first]
            m = distance(lat[a], lon[a], lat[b], lon[b])
            a, b, m = a[m <= metres], b[m <= metres], m[m <= metres]
            # A block has all that its points meet, so what two triangles found goes here.
            yield pd.DataFrame({"lat_a": lat[a], "lon_a": lon[a], "lat_b": lat[b], "lon_b": lon[b], "metres": m}).drop_duplicates()

    spread = locations.mapInPandas(distribute, "leaf int, disc boolean, face int, lat double, lon double")
    return spread.groupBy("leaf").applyInPandas(within, "lat_a double, lon_a double, lat_b double, lon_b double, metres double")


def near_pages(geotags: DataFrame, metres: float = 200.0) -> DataFrame:
    """Distinct (page_a, page_b), page_a < page_b: pages with tags within ``metres`` of each other."""
    from ..session import cut

    places = cut(clean_places(geotags))
    locations = cut(places.select("lat", "lon").distinct())  # counted, sampled and distributed
    pairs = near_locations(locations, metres).select("lat_a", "lon_a", "lat_b", "lon_b")
    a = places.select(F.col("page_id").alias("p"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = places.select(F.col("page_id").alias("q"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    apart = pairs.join(a, ["lat_a", "lon_a"]).join(b, ["lat_b", "lon_b"]).select("p", "q")
    shared = a.join(b, (a["lat_a"] == b["lat_b"]) & (a["lon_a"] == b["lon_b"]) & (a["p"] < b["q"])).select("p", "q")
    return apart.unionByName(shared).where("p <> q").select(F.least("p", "q").alias("page_a"), F.greatest("p", "q").alias("page_b")).distinct()


def pages_in_regions(geotags: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, lat, lon, region_id): the region holding each place; of several the smallest id.

    ``regions`` has ``region_id BIGINT`` and ``vertices ARRAY<STRUCT<lat DOUBLE, lon DOUBLE>>``.
    Null ids and vertices that are null or not numbers are no regions; places in no region do not come out.
    """
    from ..session import cut

    places = cut(clean_places(geotags))
    locations = cut(places.select("lat", "lon").distinct())  # counted, sampled and distributed
    tree = locations.sparkSession.sparkContext.broadcast(fit_tree(locations))
    row = "leaf int, region_id long, face int, lat double, lon double, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"
    names = [c.split()[0] for c in row.split(", ")]

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for rid, vs in zip(x["region_id"], x["vertices"]):
                for f, tri in region_triangles([(v["lat"], v["lon"]) for v in vs]):
                    k, leaf = tree.value.place(np.full(len(tri), f), tri.min(1) - 2 * EDGE, tri.max(1) + 2 * EDGE)
                    y = pd.DataFrame(tri[k].reshape(-1, 6), columns=names[5:])
                    yield y.assign(leaf=leaf, region_id=rid, face=f, lat=np.nan, lon=np.nan)[names]

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            face, uv = _points_on_faces(x["lat"].to_numpy(float), x["lon"].to_numpy(float))
            own, leaf = tree.value.place(face, uv, uv)
            y = pd.DataFrame({"leaf": leaf, "region_id": np.int64(0), "face": face[own], "lat": x["lat"].to_numpy()[own], "lon": x["lon"].to_numpy()[own]})
            yield y.assign(**{"x0": uv[own, 0], "y0": uv[own, 1], "x1": np.nan, "y1": np.nan, "x2": np.nan, "y2": np.nan})[names]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches))
        is_tri = x["lat"].isna().to_numpy()
        t, p = x[is_tri], x[~is_tri]
        for i, j in points_in_triangles(t[names[5:]].to_numpy().reshape(-1, 3, 2), p[["x0", "y0"]].to_numpy()):
            found = pd.DataFrame({"lat": p["lat"].to_numpy()[j], "lon": p["lon"].to_numpy()[j], "region_id": t["region_id"].to_numpy()[i]})
            yield found.groupby(["lat", "lon"], as_index=False)["region_id"].min()

    usable = regions.select("region_id", "vertices").where("region_id is not null and vertices is not null and forall(vertices, v -> v.lat is not null and v.lon is not null and not isnan(v.lat) and not isnan(v.lon))")
    spread = usable.mapInPandas(triangles, row).unionByName(locations.mapInPandas(points, row))
    held = spread.groupBy("leaf").applyInPandas(inside, "lat double, lon double, region_id long")
    return places.join(held, ["lat", "lon"]).select("page_id", "lat", "lon", "region_id")
