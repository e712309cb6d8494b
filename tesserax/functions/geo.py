"""Geometry as column expressions: rings are a pair of arrays xs, ys (closed: the last vertex is the first)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Equatorial radius and half the Web-Mercator world, in metres; half the world at zoom 21, in pixels.
RADIUS = 6378137.0
HALF_WORLD = 20037508.342789244
HALF_PIXELS = 268435456


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def rad(x) -> Column:
    return _c(x) * F.lit(math.pi / 180)


# -- predicates ------------------------------------------------------------------------------------------------------


def in_box(x, y, minx, miny, maxx, maxy) -> Column:
    """Inclusive on all sides."""
    return (_c(x) >= _c(minx)) & (_c(x) <= _c(maxx)) & (_c(y) >= _c(miny)) & (_c(y) <= _c(maxy))


def in_circle(x, y, cx, cy, radius) -> Column:
    """Planar distance in degrees, inclusive."""
    dx, dy = _c(x) - _c(cx), _c(y) - _c(cy)
    return dx * dx + dy * dy <= _c(radius) * _c(radius)


def _edges(xs, ys, start, step) -> Column:
    """Fold step(acc, x1, y1, x2, y2) over a ring's edges."""
    xs, ys = _c(xs), _c(ys)
    at = F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1)))
    out = F.aggregate(at, start, lambda acc, i: step(acc, F.get(xs, i - 1), F.get(ys, i - 1), F.get(xs, i), F.get(ys, i)))
    return F.when(F.size(xs) > 1, out)


def in_ring(x, y, xs, ys) -> Column:
    """Even-odd rule on a vertical ray; points on an edge or vertex are inside."""
    x, y = _c(x), _c(y)

    def step(acc, x1, y1, x2, y2):
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = (side == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
        crossed = ((x1 > x) != (x2 > x)) & F.when(x2 > x1, side < 0).otherwise(side > 0)
        return F.when((acc < 0) | on, F.lit(-1)).when(crossed, acc + 1).otherwise(acc)

    n = _edges(xs, ys, F.lit(0), step)
    return F.coalesce((n < 0) | (n % 2 == 1), F.lit(False))


def edge_distance(x, y, x1, y1, x2, y2) -> Column:
    """Planar distance from a point to a segment."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.when(length > 0, length)))).otherwise(0.0)
    return F.sqrt(F.pow(x - (x1 + t * dx), F.lit(2.0)) + F.pow(y - (y1 + t * dy), F.lit(2.0)))


def ring_distance(x, y, xs, ys, signed: bool = False) -> Column:
    """Distance in degrees to a ring's polygon: 0 inside, or minus the distance to the edge if signed."""
    d = _edges(xs, ys, F.lit(float("inf")), lambda acc, x1, y1, x2, y2: F.least(acc, edge_distance(x, y, x1, y1, x2, y2)))
    return F.when(in_ring(x, y, xs, ys), -d if signed else F.lit(0.0)).otherwise(d)


# -- areas and distances on the sphere ---------------------------------------------------------------------------------


def central_angle(x1, y1, x2, y2) -> Column:
    """Haversine, in radians."""
    a = F.pow(F.sin(rad(_c(y1) - _c(y2)) / 2), F.lit(2.0)) + F.cos(rad(y1)) * F.cos(rad(y2)) * F.pow(F.sin(rad(_c(x1) - _c(x2)) / 2), F.lit(2.0))
    return 2 * F.asin(F.sqrt(a))


def sphere_distance(x1, y1, x2, y2) -> Column:
    """Metres along a great circle."""
    return central_angle(x1, y1, x2, y2) * RADIUS


def azimuth(x1, y1, x2, y2) -> Column:
    """Planar bearing in degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(_c(x2) - _c(x1), _c(y2) - _c(y1))) + 360.0, F.lit(360.0))


def triangle_excess(ax, ay, bx, by, cx, cy) -> Column:
    """Signed spherical excess: positive for vertices in anticlockwise order seen from outside."""
    ab, bc, ca = central_angle(ax, ay, bx, by), central_angle(bx, by, cx, cy), central_angle(cx, cy, ax, ay)
    s = (ab + bc + ca) / 2
    t = F.tan(s / 2) * F.tan((s - ab) / 2) * F.tan((s - bc) / 2) * F.tan((s - ca) / 2)
    p = [(F.cos(rad(y)) * F.cos(rad(x)), F.cos(rad(y)) * F.sin(rad(x)), F.sin(rad(y))) for x, y in ((ax, ay), (bx, by), (cx, cy))]
    (a, b, c) = p
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return 4 * F.atan(F.sqrt(F.abs(t))) * F.when(det > 0, 1.0).otherwise(-1.0)


def ring_area(xs, ys) -> Column:
    """Square metres, signed: a fan of spherical triangles from the first vertex. Rings at the world's corners only: the world."""
    xs, ys = _c(xs), _c(ys)
    at = F.sequence(F.lit(1), F.greatest(F.size(xs) - 3, F.lit(1)))
    fan = F.aggregate(at, F.lit(0.0), lambda acc, i: acc + triangle_excess(F.get(xs, F.lit(0)), F.get(ys, F.lit(0)), F.get(xs, i), F.get(ys, i), F.get(xs, i + 1), F.get(ys, i + 1)))
    world = F.forall(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: (F.abs(p["x"]) > 174) & (F.abs(p["y"]) > 84))
    return F.when(world, 510e12).otherwise(F.when(F.size(xs) > 3, fan).otherwise(0.0) * RADIUS * RADIUS)


def triangle_area(ax, ay, bx, by, cx, cy) -> Column:
    """ring_area of the closed triangle, without its sign and without arrays or branches, so that Spark compiles it and works out each part once."""
    world = F.lit(True)
    for x, y in ((ax, ay), (bx, by), (cx, cy)):
        world = world & (F.abs(_c(x)) > 174) & (F.abs(_c(y)) > 84)
    return F.greatest(F.abs(triangle_excess(ax, ay, bx, by, cx, cy)) * RADIUS * RADIUS, world.cast("double") * 510e12)


def box_area(minx, miny, maxx, maxy) -> Column:
    """Square metres of a box with great-circle sides: two spherical triangles."""
    return F.abs(triangle_excess(minx, miny, minx, maxy, maxx, maxy) + triangle_excess(minx, miny, maxx, maxy, maxx, miny)) * RADIUS * RADIUS


def cell_area(res: float, lat) -> Column:
    """Square kilometres of a res x res cell in the latitude band of lat."""
    low = F.floor(F.abs(_c(lat)) / res) * res
    return box_area(F.lit(0.0), low, F.lit(float(res)), low + res) / 1e6


# -- projections and lattices ------------------------------------------------------------------------------------------


def lon_to_metres(x) -> Column:
    return _c(x) * HALF_WORLD / 180


def metres_to_lon(m) -> Column:
    return _c(m) / HALF_WORLD * 180


def lat_to_metres(y) -> Column:
    return F.log(F.tan((rad(y) + math.pi / 2) / 2)) * HALF_WORLD / math.pi


def metres_to_lat(m) -> Column:
    return (2 * F.atan(F.exp(_c(m) / HALF_WORLD * math.pi)) - math.pi / 2) * (180 / math.pi)


def lon_to_pixel(x) -> Column:
    """Zoom-21 pixel column."""
    return F.floor(HALF_PIXELS + _c(x) * (HALF_PIXELS / 180) + 0.5).cast("long")


def lat_to_pixel(y) -> Column:
    s = F.sin(rad(y))
    return F.floor(HALF_PIXELS - F.log((1 + s) / (1 - s)) * (HALF_PIXELS / math.pi / 2) + 0.5).cast("long")


def pixel_to_lon(p) -> Column:
    return (_c(p) - HALF_PIXELS) * (180 / HALF_PIXELS)


def pixel_to_lat(p) -> Column:
    e = F.exp((HALF_PIXELS - _c(p)) * (2 * math.pi / HALF_PIXELS))
    return F.degrees(F.asin((e - 1) / (1 + e)))


def pixel_distance(x1, y1, x2, y2, zoom: int) -> Column:
    """Whole pixels between two points at a zoom."""
    dx, dy = (lon_to_pixel(x1) - lon_to_pixel(x2)).cast("double"), (lat_to_pixel(y1) - lat_to_pixel(y2)).cast("double")
    return F.floor(F.floor(F.sqrt(dx * dx + dy * dy)) / float(2 ** (21 - zoom))).cast("long")


def let(value, body) -> Column:
    """body(value), with the value worked out once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _circle_terms(lon, lat, radius) -> Column:
    """What all points of a circle share."""
    b, e = _c(radius) / RADIUS, rad(lat)
    return F.struct(_c(lon).alias("lon"), F.sin(e).alias("sin_e"), F.cos(b).alias("cos_b"), (F.cos(b) * F.sin(e)).alias("p"), (F.sin(b) * F.cos(e)).alias("q"))


def _circle_point(c, degree) -> Column:
    def placed(g):
        x = F.degrees(F.atan2(c["q"] * F.sin(rad(degree)), c["cos_b"] - c["sin_e"] * g))
        return F.struct((c["lon"] + x).alias("x"), F.degrees(F.asin(g)).alias("y"))

    return let(c["p"] + c["q"] * F.cos(rad(degree)), placed)


def circle_point(lon, lat, radius, degree) -> Column:
    """Struct (x, y): the point at a distance (metres) and bearing; x is not wrapped."""
    return let(_circle_terms(lon, lat, radius), lambda c: _circle_point(c, degree))


def circle(lon, lat, radius) -> Column:
    """Closed array of 361 vertices (x, y); moved east by 360 if any is west of -180."""
    ring = let(_circle_terms(lon, lat, radius), lambda c: F.transform(F.sequence(F.lit(0), F.lit(360)), lambda k: _circle_point(c, k % 360)))

    def wrapped(points):
        moved = F.transform(points, lambda p: F.struct((p["x"] + 360.0).alias("x"), p["y"].alias("y")))
        return F.when(F.exists(points, lambda p: p["x"] < -180), moved).otherwise(points)

    return let(ring, wrapped)


def snap(x, res: float, mode: str = "truncate") -> Column:
    """South-west edge of x's lattice cell: truncate moves negatives a cell down (exact multiples too); floor does not."""
    n = _c(x) / res
    whole = F.floor(n) if mode == "floor" else F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n) - F.when(n <= -1, 1).otherwise(0))
    return whole.cast("double") * res


def cell_index(x, origin, res: float, mode: str = "truncate") -> Column:
    """Lattice index of x: truncate, round (half up), ceil or floor."""
    n = (_c(x) - _c(origin)) / res
    how = {"truncate": lambda: F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)), "round": lambda: F.floor(n + 0.5), "ceil": lambda: F.ceil(n), "floor": lambda: F.floor(n)}
    return how[mode]().cast("int")


def min_max_scale(v, lo, hi) -> Column:
    return F.when(_c(hi) > _c(lo), (_c(v) - _c(lo)) / (_c(hi) - _c(lo))).otherwise(0.0)


def align(minimum, maximum, res: float) -> tuple[Column, Column]:
    """Extent widened to whole multiples of res, at least two cells."""
    lo = F.floor(_c(minimum) / res) * res
    return lo, F.greatest(F.ceil(_c(maximum) / res) * res, lo + 2 * res)


def box_wkt(minx, miny, maxx, maxy) -> Column:
    """POLYGON text of a box, from the south-west corner clockwise, coordinates with six decimals."""
    f = "%.6f %.6f"
    return F.format_string(f"POLYGON(({','.join([f] * 5)}))", *map(_c, (minx, miny, minx, maxy, maxx, maxy, maxx, miny, minx, miny)))


def normalise_ring(xs, ys) -> Column:
    """Struct (xs, ys): clamped to the world and closed."""
    cx = F.transform(_c(xs), lambda v: F.greatest(F.lit(-180.0), F.least(F.lit(180.0), v)))
    cy = F.transform(_c(ys), lambda v: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), v)))
    open_ = (F.get(cx, F.lit(0)) != F.get(cx, F.size(cx) - 1)) | (F.get(cy, F.lit(0)) != F.get(cy, F.size(cy) - 1))
    close = lambda a: F.when(open_, F.concat(a, F.slice(a, 1, 1))).otherwise(a)
    return F.struct(close(cx).alias("xs"), close(cy).alias("ys"))


# -- well-known text ---------------------------------------------------------------------------------------------------


def wkt_rings(wkt) -> Column:
    """array<struct<part, ring, xs, ys>> of POLYGON, MULTIPOLYGON and GEOMETRYCOLLECTION text; null text gives null."""
    text = F.regexp_replace(F.upper(_c(wkt)), r"\s*([(),])\s*", "$1")
    parts = F.regexp_extract_all(text, F.lit(r"\(\(([^()]*(?:\),\([^()]*)*)\)\)"), F.lit(1))
    point = lambda k: lambda p: F.element_at(F.split(F.trim(p), r"\s+"), k).cast("double")

    def ring(i, part):
        return lambda r, j: F.struct(i.cast("int").alias("part"), j.cast("int").alias("ring"), F.transform(F.split(r, ","), point(1)).alias("xs"), F.transform(F.split(r, ","), point(2)).alias("ys"))

    return F.flatten(F.transform(parts, lambda part, i: F.transform(F.split(part, r"\),\("), ring(i, part))))


def split_collection(wkt) -> Column:
    """array<string> of a collection's polygons and multipolygons; other text is its own only member."""
    text = F.regexp_replace(F.upper(_c(wkt)), r"\s*([(),])\s*", "$1")
    inner = F.regexp_extract_all(text, F.lit(r"((?:MULTIPOLYGON\(\(\([^A-Z]*\)\)\))|(?:POLYGON\(\([^A-Z]*?\)\)))(?=,[A-Z]|\)*$)"), F.lit(1))
    return F.when(text.startswith("GEOMETRYCOLLECTION"), inner).otherwise(F.array(_c(wkt)))


def ring_wkt(xs, ys) -> Column:
    points = F.transform(F.arrays_zip(_c(xs).alias("x"), _c(ys).alias("y")), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("("), F.array_join(points, ","), F.lit(")"))


#: WGS 84: semi-major axis in metres and flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
#: Fewest metres of a degree of latitude, at the equator.
LEAST_DEGREE = 110_500.0
#: Steps until the longitude on the sphere settles (six do, but near antipodes), and halvings of the azimuth where it does not.
SETTLE, HALVE = 30, 60


def _arc(g, lam, body) -> Column:
    """body(parts) of the geodesic between reduced latitudes (sines and cosines in g) whose longitudes on the sphere differ by lam.

    Each part is worked out once: written into one another they would be some thousand terms."""

    def angles(x):
        p, q = g["cos_u2"] * x["sin_l"], g["cos_u1"] * g["sin_u2"] - g["sin_u1"] * g["cos_u2"] * x["cos_l"]
        return F.struct(p.alias("p"), q.alias("q"), x["sin_l"].alias("sin_l"), (g["sin_u1"] * g["sin_u2"] + g["cos_u1"] * g["cos_u2"] * x["cos_l"]).alias("cos_s"))

    def arc(x):
        return F.struct(F.sqrt(x["p"] * x["p"] + x["q"] * x["q"]).alias("sin_s"), x["cos_s"].alias("cos_s"), x["sin_l"].alias("sin_l"))

    def azimuth_of(x):
        sin_a = F.when(x["sin_s"] == 0, 0.0).otherwise(g["cos_u1"] * g["cos_u2"] * x["sin_l"] / F.when(x["sin_s"] != 0, x["sin_s"]))
        return F.struct(F.atan2(x["sin_s"], x["cos_s"]).alias("s"), x["sin_s"].alias("sin_s"), x["cos_s"].alias("cos_s"), sin_a.alias("sin_a"))

    def squared(x):
        return F.struct(*(x[c].alias(c) for c in ("s", "sin_s", "cos_s", "sin_a")), (1 - x["sin_a"] * x["sin_a"]).alias("cos_a2"))

    def middle(x):
        mid = F.when(x["cos_a2"] == 0, 0.0).otherwise(x["cos_s"] - 2 * g["sin_u1"] * g["sin_u2"] / F.when(x["cos_a2"] != 0, x["cos_a2"]))
        return F.struct(*(x[c].alias(c) for c in ("s", "sin_s", "cos_s", "sin_a", "cos_a2")), mid.alias("mid"))

    own = F.struct(F.sin(lam).alias("sin_l"), F.cos(lam).alias("cos_l"))
    return let(own, lambda x: let(angles(x), lambda x: let(arc(x), lambda x: let(azimuth_of(x), lambda x: let(squared(x), lambda x: let(middle(x), body))))))


def _lag(g) -> Column:
    """By how much the longitude on the sphere is ahead of that on the spheroid, from the parts of a geodesic."""
    c = FLAT / 16 * g["cos_a2"] * (4 + FLAT * (4 - 3 * g["cos_a2"]))
    return let(c, lambda c: (1 - c) * FLAT * g["sin_a"] * (g["s"] + c * g["sin_s"] * (g["mid"] + c * g["cos_s"] * (-1 + 2 * g["mid"] * g["mid"]))))


def _length(g) -> Column:
    """Metres along a geodesic of these parts."""
    b = AXIS * (1 - FLAT)

    def along(k1):
        big, small = (1 + k1 * k1 / 4) / (1 - k1), k1 * (1 - 3 * k1 * k1 / 8)
        m = g["mid"]
        ds = small * g["sin_s"] * (m + small / 4 * (g["cos_s"] * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * g["sin_s"] * g["sin_s"]) * (-3 + 4 * m * m)))
        return b * big * (g["s"] - ds)

    root = F.sqrt(1 + g["cos_a2"] * (AXIS * AXIS - b * b) / (b * b))
    return let(let(root, lambda r: (r - 1) / (r + 1)), along)


def _turned(u1, u2, azimuth) -> dict[str, Column]:
    """Parts of the geodesic from reduced latitude u1 (south, the farther from the equator) at an azimuth to u2, and `lam`."""
    sin_a = F.sin(azimuth) * F.cos(u1)
    c1 = F.cos(azimuth) * F.cos(u1)
    c2 = F.sqrt(F.greatest(F.lit(0.0), c1 * c1 + (F.cos(u2) * F.cos(u2) - F.cos(u1) * F.cos(u1))))
    s1, s2 = F.atan2(F.sin(u1), c1), F.atan2(F.sin(u2), c2)
    lam = F.atan2(sin_a * F.sin(u2), c2) - F.atan2(sin_a * F.sin(u1), c1)
    return {"s": s2 - s1, "sin_s": F.sin(s2 - s1), "cos_s": F.cos(s2 - s1), "sin_a": sin_a, "cos_a2": 1 - sin_a * sin_a, "mid": F.cos(s1 + s2), "lam": lam}


def spheroid_distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres along the shortest line on the WGS 84 spheroid, to a millimetre.

    The longitude on the auxiliary sphere is iterated. Near antipodes that does not settle; there the azimuth at the latitude farther from
    the equator is halved upon, as the longitude it leads to falls steadily from half a turn.
    """
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    turn = F.abs(F.radians(lon2 - lon1)) % (2 * math.pi)
    length = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
    reduced = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(lat)))
    far, near = F.when(F.abs(lat1) >= F.abs(lat2), lat1).otherwise(lat2), F.when(F.abs(lat1) >= F.abs(lat2), lat2).otherwise(lat1)
    side = F.when(far > 0, -1.0).otherwise(1.0)
    # on the equator a little to the south, so that an azimuth is defined
    south = F.least(reduced(far * side), F.lit(-1e-15))
    given = let(F.struct(south.alias("u1"), reduced(near * side).alias("u2"), length.alias("l")), lambda g: F.struct(*(g[c].alias(c) for c in ("u1", "u2", "l")), *(f(g[u]).alias(f"{n}_{u}") for u in ("u1", "u2") for n, f in (("sin", F.sin), ("cos", F.cos)))))

    def solved(g):
        u1, u2, l = g["u1"], g["u2"], g["l"]
        # a longitude that has not moved does not move again
        step = lambda acc, _: F.when(acc["lam"] == acc["last"], acc).otherwise(F.struct((l + _arc(g, acc["lam"], _lag)).alias("lam"), acc["lam"].alias("last")))
        settled = F.aggregate(F.sequence(F.lit(1), F.lit(SETTLE)), F.struct(l.alias("lam"), F.lit(9.0).alias("last")), step)

        def halved(acc, _):
            m = (acc["lo"] + acc["hi"]) / 2
            at = _turned(u1, u2, m)
            # an azimuth that leads farther round than asked for is too far to the south
            beyond = at["lam"] - _lag(at) > l
            return F.struct(F.when(beyond, acc["lo"]).otherwise(m).alias("lo"), F.when(beyond, m).otherwise(acc["hi"]).alias("hi"))

        slow = F.aggregate(F.sequence(F.lit(1), F.lit(HALVE)), F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi).alias("hi")), halved, lambda acc: _length(_turned(u1, u2, (acc["lo"] + acc["hi"]) / 2)))
        good = lambda x: (F.abs(x["lam"] - x["last"]) < 1e-12) & (F.abs(x["lam"]) <= math.pi)
        return let(settled, lambda x: F.when(good(x), _arc(g, x["lam"], _length)).otherwise(slow))

    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).when(known, let(given, solved))
