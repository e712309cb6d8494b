"""Point, polygon and cell joins. Spatial joins are equi-joins on coarse buckets, refined by an exact expression.

Polygons come as rings(pid, part, ring, xs, ys), one row a ring; a point is in a polygon if an odd number of any one part's
rings contain it. Buckets are squares of `size` degrees. A polygon has a row for every bucket that it fills, where no point needs
a test, and for every bucket that its edges meet, with the edges at and above the bucket, which decide for the points in
it; so no row holds a whole polygon, however large. AQE splits hot buckets and broadcasts a side that turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.sources.scratch import materialise

#: Polygons in a list of those of one shape, about.
MEMBERS = 4096


def boxes_to_rings(boxes: DataFrame, part: int = 0) -> DataFrame:
    """rings of boxes(pid, [ring], minx, miny, maxx, maxy)."""
    ring = F.col("ring") if "ring" in boxes.columns else F.lit(0)
    xs, ys = F.array("minx", "minx", "maxx", "maxx", "minx"), F.array("miny", "maxy", "maxy", "miny", "miny")
    return boxes.select("pid", F.lit(part).alias("part"), ring.alias("ring"), xs.alias("xs"), ys.alias("ys"))


def triangles_to_rings(corners: DataFrame) -> DataFrame:
    xs, ys = F.array("ax", "bx", "cx", "ax"), F.array("ay", "b_y", "cy", "ay")
    return corners.select("pid", F.lit(0).alias("part"), F.lit(0).alias("ring"), xs.alias("xs"), ys.alias("ys"))


def ring_edges(rings: DataFrame) -> DataFrame:
    """(pid, part, ring, x1, y1, x2, y2): one row an edge."""
    z = F.arrays_zip(F.col("xs").alias("x1"), F.col("ys").alias("y1"), F.slice("xs", 2, F.size("xs")).alias("x2"), F.slice("ys", 2, F.size("ys")).alias("y2"))
    return rings.select("pid", "part", "ring", F.inline(z)).filter("x2 is not null")


def shapes(rings: DataFrame) -> DataFrame:
    """(pid, shape, minx, miny, maxx, maxy): a polygon's rings together, with its box."""
    r = rings.select("pid", F.struct("part", "ring", "xs", "ys").alias("r"), F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1"))
    return r.groupBy("pid").agg(F.collect_list("r").alias("shape"), F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))


def in_shape(x, y, shape) -> Column:
    """Whether an odd number of the rings of some part hold the point."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    odd = lambda p: F.aggregate(F.filter(shape, lambda r: r["part"] == p), F.lit(0), lambda n, r: n + geo.in_ring(x, y, r["xs"], r["ys"]).cast("int")) % 2 == 1
    return F.exists(F.array_distinct(F.transform(shape, lambda r: r["part"])), odd)


def shape_distance(x, y, shape) -> Column:
    """Degrees to the nearest edge; 0 inside."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    edge = F.array_min(F.transform(shape, lambda r: F.abs(geo.ring_distance(x, y, r["xs"], r["ys"], signed=True))))
    return F.when(in_shape(x, y, shape), 0.0).otherwise(edge)


def bucketed(boxes: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """boxes with a row for each bucket (bx, by) that the box, grown on all sides, meets."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - grow) / size).cast("int"), F.floor((F.col(hi) + grow) / size).cast("int")))
    return boxes.withColumn("bx", span("minx", "maxx")).withColumn("by", span("miny", "maxy"))


def with_bucket(points: DataFrame, size: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.withColumns({"bx": F.floor(F.col(lon) / size).cast("int"), "by": F.floor(F.col(lat) / size).cast("int")})


def in_edges(x, y, edges) -> Column:
    """Even-odd rule on a vertical ray over array<struct<x1, y1, x2, y2>>; points on an edge are inside."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y

    def step(acc, e):
        side = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        on = (side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        crossed = ((e["x1"] > x) != (e["x2"] > x)) & F.when(e["x2"] > e["x1"], side < 0).otherwise(side > 0)
        return F.when((acc < 0) | on, F.lit(-1)).when(crossed, acc + 1).otherwise(acc)

    n = F.aggregate(edges, F.lit(0), step)
    return (n < 0) | (n % 2 == 1)


def meets_box(x1, y1, x2, y2, minx, miny, maxx, maxy) -> Column:
    """Whether a segment and a closed box share a point: their boxes do, and the box is not wholly on one side of the line."""
    x1, y1, x2, y2, minx, miny, maxx, maxy = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2, minx, miny, maxx, maxy))
    boxes = (F.least(x1, x2) <= maxx) & (F.greatest(x1, x2) >= minx) & (F.least(y1, y2) <= maxy) & (F.greatest(y1, y2) >= miny)
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (minx, maxx) for y in (miny, maxy)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def covered(rings: DataFrame, size: float) -> DataFrame:
    """(pid, bx, by, parts): buckets that a polygon fills (parts null) or that its edges meet, with each part's rings' edges at or above."""
    n = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few rows of polygons make many of buckets
    e = ring_edges(rings).select("pid", "part", "ring", "x1", "y1", "x2", "y2").repartition(n, "pid", "x1", "y1")
    at = lambda c: F.floor(c / size).cast("int")
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))
    columns = e.withColumn("bx", span("x1", "x2"))
    box = (F.col("bx") * size, F.col("by") * size, (F.col("bx") + 1) * size, (F.col("by") + 1) * size)
    border = columns.withColumn("by", span("y1", "y2")).filter(meets_box("x1", "y1", "x2", "y2", *box)).select("pid", "bx", "by").distinct()
    extent = e.groupBy("pid").agg(F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"))
    cells = bucketed(extent, size).select("pid", "bx", "by").join(border.withColumn("border", F.lit(True)), ["pid", "bx", "by"], "left").na.fill(False, ["border"])
    above = cells.join(columns, ["pid", "bx"]).filter(F.greatest("y1", "y2") >= F.col("by") * size)
    own = above.groupBy("pid", "bx", "by", "border", "part", "ring").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    centre = in_edges((F.col("bx") + 0.5) * size, (F.col("by") + 0.5) * size, F.col("edges")).cast("int")
    parts = own.withColumn("c", centre).groupBy("pid", "bx", "by", "border", "part").agg(F.collect_list(F.struct("edges")).alias("rings"), F.sum("c").alias("c"))
    kept = parts.filter(F.col("border") | (F.col("c") % 2 == 1))
    return kept.groupBy("pid", "bx", "by").agg(F.collect_list(F.when(F.col("border"), F.struct("rings"))).alias("parts")).withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")))


def in_bucket(x, y, parts="parts") -> Column:
    """Whether a point is in a polygon, by a row of `covered` of the point's bucket."""
    odd = lambda p: F.aggregate(p["rings"], F.lit(0), lambda n, r: n + in_edges(x, y, r["edges"]).cast("int")) % 2 == 1
    return F.col(parts).isNull() | F.exists(parts, odd)


def alike(rings: DataFrame) -> DataFrame:
    """(pid, shape): for each polygon the lowest pid of those with the same rings, by a digest of each ring's text."""
    ring = F.sha2(F.concat_ws("|", F.col("xs").cast("string"), F.col("ys").cast("string")), 256)
    own = rings.select("pid", F.struct("part", "ring", ring.alias("digest")).alias("r"))
    key = own.groupBy("pid").agg(F.sort_array(F.collect_list("r")).alias("key"))
    key = key.select("pid", F.sha2(F.to_json("key"), 256).alias("key"))
    return key.join(key.groupBy("key").agg(F.min("pid").alias("shape")), "key").select("pid", "shape")


def points_in_shapes(points: DataFrame, rings: DataFrame, size: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(lon, lat, shape) for every distinct point and each shape that holds it, and (pid, shape) of the polygons of each shape."""
    members = materialise(alike(rings), "alike")
    first = rings.join(members.filter("pid = shape").select("pid"), "pid", "left_semi")
    own = with_bucket(points.select("lon", "lat").distinct(), size)
    return own.join(covered(first, size), ["bx", "by"]).filter(in_bucket("lon", "lat")).select("lon", "lat", F.col("pid").alias("shape")), members


def member_lists(members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(shape, pids): the pids of each shape as text, in lists of about `most`, so that a join makes a row a list, not a row a pid."""
    lists = members.groupBy("shape").agg(F.ceil(F.count("*") / most).alias("lists"))
    dealt = members.join(lists, "shape").withColumn("list", F.pmod(F.xxhash64("pid"), F.col("lists")))
    found = dealt.groupBy("shape", "list").agg(F.collect_list(F.struct(F.col("pid").cast("string").alias("pid"))).alias("m"))
    return materialise(found.select("shape", F.col("m.pid").alias("pids")), "lists")


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float = 0.5) -> DataFrame:
    """(lon, lat, pid) for every distinct point and each polygon that holds it. Polygons of the same rings are tested once."""
    places, members = points_in_shapes(points, rings, size)
    return places.join(members, "shape").select("lon", "lat", "pid")


def first_polygon(points: DataFrame, rings: DataFrame, size: float = 0.5) -> DataFrame:
    """points with pid: the lowest numbered polygon that holds each, else null. Coordinates are looked up once.

    Of polygons with the same rings, and of those that fill a bucket, only the lowest counts, and only lower ones need a test there.
    """
    first = rings.join(alike(rings).filter("pid = shape").select("pid"), "pid", "left_semi")
    own = materialise(covered(first, size), "covered")
    filled = own.filter("parts is null").groupBy("bx", "by").agg(F.min("pid").alias("filled"))
    lower = own.filter("parts is not null").join(filled, ["bx", "by"], "left").filter("filled is null or pid < filled").drop("filled")
    bucket = with_bucket(points.select("lon", "lat").distinct(), size)
    tested = bucket.join(lower, ["bx", "by"]).filter(in_bucket("lon", "lat")).groupBy("lon", "lat").agg(F.min("pid").alias("tested"))
    out = with_bucket(points, size).join(filled, ["bx", "by"], "left").join(tested, ["lon", "lat"], "left")
    return out.withColumn("pid", F.least("filled", "tested")).drop("bx", "by", "filled", "tested")


def every_polygon(points: DataFrame, rings: DataFrame, size: float = 0.5) -> DataFrame:
    """points once for each polygon that holds them."""
    places, members = points_in_shapes(points, rings, size)
    return points.join(places, ["lon", "lat"]).join(members, "shape").drop("shape")


def polygons_within(points: DataFrame, rings: DataFrame, distance: float, size: float = 4.0) -> DataFrame:
    """(lon, lat, pid, distance) for polygons at most so many degrees from a distinct point."""
    own = with_bucket(points.select("lon", "lat").distinct(), size)
    pairs = own.join(bucketed(shapes(rings), size, distance), ["bx", "by"])
    near = geo.in_box("lon", "lat", F.col("minx") - distance, F.col("miny") - distance, F.col("maxx") + distance, F.col("maxy") + distance)
    return pairs.filter(near).withColumn("distance", shape_distance("lon", "lat", "shape")).filter(F.col("distance") <= distance).select("lon", "lat", "pid", "distance")


def with_cell(points: DataFrame, west: float, north: float, res: float, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """points with row (from the north) and col; on the far edges the last cell; null outside rows x cols."""
    row, col = F.floor((F.lit(north) - F.col("lat")) / res).cast("int"), F.floor((F.col("lon") - F.lit(west)) / res).cast("int")
    if rows is not None:
        row = F.when(F.col("lat") == north - rows * res, rows - 1).when((row >= 0) & (row < rows), row)
        col = F.when(F.col("lon") == west + cols * res, cols - 1).when((col >= 0) & (col < cols), col)
    return points.withColumns({"row": row, "col": col})


def sample_grid(points: DataFrame, cells: DataFrame, name: str, west: float, north: float, res: float, rows: int, cols: int) -> DataFrame:
    """points with the value of their cell as `name`; null outside or without data."""
    values = cells.select(F.col("row"), F.col("col"), F.col("value").alias(name))
    return with_cell(points, west, north, res, rows, cols).join(values, ["row", "col"], "left").drop("row", "col")


def sample_classes(points: DataFrame, cells: DataFrame, names: DataFrame, name: str, west: float, north: float, res: float, rows: int, cols: int) -> DataFrame:
    """As sample_grid, with the class name of the cell's value from names(value, name)."""
    own = sample_grid(points, cells, "_value", west, north, res, rows, cols)
    return own.join(names.select(F.col("value").alias("_value"), F.col("name").alias(name)), "_value", "left").drop("_value")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as a shuffle has: a small file is read by one task, which would do all of a costly expression."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def within_radius(objects: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Point objects at most so far along the spheroid, with distance in metres; only those that can be are measured: by their latitude,
    then by the distance on the sphere, which is less than 0.7 % off."""
    degrees = metres / geo.LEAST_DEGREE + 1e-9
    near = objects.filter(F.col("lat").between(lat - degrees, lat + degrees))
    near = spread(near.filter(geo.sphere_distance("lon", "lat", F.lit(lon), F.lit(lat)) <= metres * 1.02 + 1))
    return near.withColumn("distance", geo.spheroid_distance("lon", "lat", F.lit(lon), F.lit(lat))).filter(F.col("distance") <= metres)


def nearest(objects: DataFrame, lon: float, lat: float, k: int = 40) -> DataFrame:
    """The k nearest point objects to one place along the spheroid, ties by pid, with distance (metres) and azimuth (degrees).

    Distances on the sphere are less than 0.6 % off, so those beyond 1.02 times the k-th of them are not measured."""
    rough = objects.withColumn("_rough", geo.sphere_distance(F.lit(lon), F.lit(lat), "lon", "lat"))
    bound = rough.select("_rough").orderBy("_rough").limit(k).agg((F.max("_rough") * 1.02 + 1).alias("_bound"))
    few = rough.crossJoin(F.broadcast(bound)).filter("_rough <= _bound").drop("_rough", "_bound")  # one row
    place = (F.lit(lon), F.lit(lat), "lon", "lat")
    return few.withColumns({"distance": geo.spheroid_distance(*place), "azimuth": geo.azimuth(*place)}).orderBy("distance", "pid").limit(k)


def boxes_overlap(a: DataFrame, b: DataFrame, size: float = 8.0) -> DataFrame:
    """(pid1, pid2, minx, miny, maxx, maxy): the common part of every two boxes that overlap in an area, by shared buckets."""
    left = bucketed(a.select(F.col("pid").alias("pid1"), "minx", "miny", "maxx", "maxy"), size)
    right = bucketed(b.select(F.col("pid").alias("pid2"), "minx", "miny", "maxx", "maxy"), size)
    right = right.withColumnsRenamed({"minx": "x0", "miny": "y0", "maxx": "x1", "maxy": "y1"})
    both = left.join(right, ["bx", "by"]).filter("minx < x1 and x0 < maxx and miny < y1 and y0 < maxy")
    out = both.select("pid1", "pid2", F.greatest("minx", "x0").alias("minx"), F.greatest("miny", "y0").alias("miny"), F.least("maxx", "x1").alias("maxx"), F.least("maxy", "y1").alias("maxy"), "bx", "by")
    # each pair once: in the bucket of its common part's corner
    return out.filter((F.floor(F.col("minx") / size) == F.col("bx")) & (F.floor(F.col("miny") / size) == F.col("by"))).drop("bx", "by")


def in_all(lists: list[DataFrame], key: str = "pid") -> DataFrame:
    """Keys that stand in every one of several results."""
    out = lists[0].select(key).distinct().withColumn("k", F.lit(0))
    for k, other in enumerate(lists[1:], 1):
        out = out.unionByName(other.select(key).distinct().withColumn("k", F.lit(k)))
    return out.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(lists)).select(key)


def rank_within(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
