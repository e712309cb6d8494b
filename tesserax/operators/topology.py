"""Which polygons meet, lie in each other, or are valid: joins of edges in a hierarchy of buckets.

An edge is at home on the level whose buckets are as large as itself, so it is in four buckets at most; it also has a row for its
bucket on each coarser level where the other side is at home. Two edges whose boxes meet then share a bucket on the coarser of
their levels, whatever their lengths, and are compared once, in the bucket of the corner of what their boxes share. So an outline
of many short edges is compared with its neighbourhood only: the work grows with edges and contacts, not with edges times edges,
and rows of one polygon are on as many tasks as it has buckets.

Signs of determinants decide, so coordinates without rounding give exact answers. rings(pid, part, ring, xs, ys) as in `spatial`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserax.operators.spatial import covered, in_bucket, points_in_polygons, with_bucket
from tesserax.sources.scratch import materialise

#: Size of buckets on level 0, in degrees: 2 ** -12.
BASE = 1 / 4096
#: Parts of an edge shorter than this share of it are not tested.
LEAST = 1e-9
EDGE = ("x1", "y1", "x2", "y2")


def numbered_edges(rings: DataFrame) -> DataFrame:
    """(pid, part, ring, k, last, x1, y1, x2, y2): edges with their place in their ring, and the ring's last place."""
    n = F.size("xs") - 1
    at = lambda c, d: F.get(c, F.col("k") + d).cast("double")
    each = rings.filter(n > 0).select("pid", "part", "ring", "xs", "ys", (n - 1).alias("last"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return each.select("pid", "part", "ring", "k", "last", at("xs", 0).alias("x1"), at("ys", 0).alias("y1"), at("xs", 1).alias("x2"), at("ys", 1).alias("y2"))


def _sides(e: str) -> dict[str, Column]:
    x = {c: F.col(f"{e}.{c}") for c in EDGE}
    return {"west": F.least(x["x1"], x["x2"]), "south": F.least(x["y1"], x["y2"]), "east": F.greatest(x["x1"], x["x2"]), "north": F.greatest(x["y1"], x["y2"])}


def _levels(edges: DataFrame, name: str) -> DataFrame:
    """(name struct, level) of edges."""
    df = edges.select(F.struct(*edges.columns).alias(name))
    s = _sides(name)
    size = F.greatest(s["east"] - s["west"], s["north"] - s["south"], F.lit(BASE))
    return df.withColumn("level", F.ceil(F.log2(size / BASE)).cast("int"))


def _dealt(own: DataFrame, name: str, others: list[int]) -> DataFrame:
    """own with a row for each bucket (at, bx, by) of its home level and of the coarser levels of the other side."""
    coarser = F.filter(F.array(*map(F.lit, others)), lambda l: l > F.col("level")) if others else F.array().cast("array<int>")
    df = own.withColumn("at", F.explode(F.concat(F.array("level"), coarser)))
    size, s = BASE * F.pow(F.lit(2.0), F.col("at")), _sides(name)
    span = lambda low, high: F.explode(F.sequence(F.floor(s[low] / size), F.floor(s[high] / size)))
    return df.withColumn("bx", span("west", "east")).withColumn("by", span("south", "north")).withColumn(f"home_{name}", F.col("at") == F.col("level")).drop("level")


def edge_pairs(a: DataFrame, b: DataFrame, same: list[str] | None = None) -> DataFrame:
    """(a, b): structs of all columns of two edge tables, for each two edges whose closed boxes meet, once; only of equal columns `same`."""
    la, lb = materialise(_levels(a, "a"), "edges"), materialise(_levels(b, "b"), "edges")
    present = lambda d: sorted(r[0] for r in d.select("level").distinct().collect())  # noqa: E731  some thirty levels at most
    left, right = _dealt(la, "a", present(lb)), _dealt(lb, "b", present(la))
    keys = [f"same_{c}" for c in same or []]
    keyed = lambda d, name: d.select("*", *(F.col(f"{name}.{c}").alias(f"same_{c}") for c in same or []))
    both = keyed(left, "a").join(keyed(right, "b"), ["at", "bx", "by", *keys]).filter("home_a or home_b")
    p, q, size = _sides("a"), _sides("b"), BASE * F.pow(F.lit(2.0), F.col("at"))
    meet = (p["west"] <= q["east"]) & (q["west"] <= p["east"]) & (p["south"] <= q["north"]) & (q["south"] <= p["north"])
    first = (F.floor(F.greatest(p["west"], q["west"]) / size) == F.col("bx")) & (F.floor(F.greatest(p["south"], q["south"]) / size) == F.col("by"))
    return both.filter(meet & first).select("a", "b")


def side(e: str, f: str, end: int) -> Column:
    """Which side of edge e an end of edge f is on: a number with that sign, 0 on its line."""
    x = {c: F.col(f"{e}.{c}") for c in EDGE}
    px, py = F.col(f"{f}.x{end}"), F.col(f"{f}.y{end}")
    return (x["x2"] - x["x1"]) * (py - x["y1"]) - (x["y2"] - x["y1"]) * (px - x["x1"])


def _apart(e: str, f: str) -> Column:
    """Of f's ends: -1 on opposite sides of e, 1 on one side, 0 one of them on its line."""
    return F.signum(side(e, f, 1)) * F.signum(side(e, f, 2))


def contacts(a: DataFrame, b: DataFrame, same: list[str] | None = None) -> DataFrame:
    """(a, b, proper, along): edges of two tables that share a point; proper if both go on on both sides; along if on one line."""
    found = edge_pairs(a, b, same).filter((_apart("a", "b") <= 0) & (_apart("b", "a") <= 0))
    level = (side("a", "b", 1) == 0) & (side("a", "b", 2) == 0)
    return found.withColumns({"proper": (_apart("a", "b") < 0) & (_apart("b", "a") < 0), "along": level})


def _corners(rings: DataFrame, name: str) -> DataFrame:
    """(name, lon, lat): a corner of each ring."""
    return rings.select(F.col("pid").alias(name), F.get("xs", F.lit(0)).cast("double").alias("lon"), F.get("ys", F.lit(0)).cast("double").alias("lat"))


def objects_intersecting(rings_a: DataFrame, rings_b: DataFrame, size: float = 0.5) -> DataFrame:
    """(pid1, pid2): polygons of two sets that share a point, be it of their edges only: edges that meet, or one inside the other."""
    own = lambda r: numbered_edges(r).select("pid", *EDGE)
    touching = contacts(own(rings_a), own(rings_b)).select(F.col("a.pid").alias("pid1"), F.col("b.pid").alias("pid2"))
    a, b = _corners(rings_a, "pid1"), _corners(rings_b, "pid2")
    in_b = a.join(points_in_polygons(a, rings_b, size).withColumnRenamed("pid", "pid2"), ["lon", "lat"]).select("pid1", "pid2")
    in_a = b.join(points_in_polygons(b, rings_a, size).withColumnRenamed("pid", "pid1"), ["lon", "lat"]).select("pid1", "pid2")
    return touching.unionByName(in_b).unionByName(in_a).distinct()


def _between(met: DataFrame, e: str, f: str) -> DataFrame:
    """(pid1, pid2, x, y): middles of the parts into which contacts cut the edges e, but for parts along an edge f."""
    s1, s2 = side(f, e, 1), side(f, e, 2)
    x = {c: F.col(f"{e}.{c}") for c in EDGE}
    dx, dy = x["x2"] - x["x1"], x["y2"] - x["y1"]
    share = lambda k: ((F.col(f"{f}.x{k}") - x["x1"]) * dx + (F.col(f"{f}.y{k}") - x["y1"]) * dy) / F.when((dx != 0) | (dy != 0), dx * dx + dy * dy)
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    lo, hi = clip(F.least(share(1), share(2))), clip(F.greatest(share(1), share(2)))
    at = F.when(F.col("along"), F.array(lo, hi)).otherwise(F.array(clip(F.try_divide(s1, s1 - s2))))
    rows = met.filter((dx != 0) | (dy != 0)).select(F.col("a.pid").alias("pid1"), F.col("b.pid").alias("pid2"), *(x[c].alias(c) for c in EDGE), at.alias("t"), F.when(F.col("along"), F.struct(lo.alias("lo"), hi.alias("hi"))).alias("cover"))
    cut = rows.groupBy("pid1", "pid2", *EDGE).agg(F.flatten(F.collect_list("t")).alias("t"), F.collect_list("cover").alias("cover"))
    cut = cut.withColumn("t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact("t")))))
    parts = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda p, q: F.struct(p.alias("lo"), q.alias("hi")))
    cut = cut.select("pid1", "pid2", *EDGE, "cover", F.explode(parts).alias("p")).filter(F.col("p.hi") - F.col("p.lo") > LEAST)
    m = (F.col("p.lo") + F.col("p.hi")) / 2
    cut = cut.filter(~F.exists("cover", lambda c: (c["lo"] <= m) & (m <= c["hi"])))
    return cut.select("pid1", "pid2", (F.col("x1") + m * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + m * (F.col("y2") - F.col("y1"))).alias("y"))


def interior(edges: DataFrame) -> DataFrame:
    """(pid, x, y): a point inside each polygon: halfway between its two lowest heights, between the first two edges there."""
    ys = edges.select("pid", F.explode(F.array("y1", "y2")).alias("y"))
    low = ys.groupBy("pid").agg(F.min("y").alias("low"))
    level = ys.join(low, "pid").filter("y > low").groupBy("pid").agg(((F.min("low") + F.min("y")) / 2).alias("y"))
    share = F.try_divide(F.col("y") - F.col("y1"), F.col("y2") - F.col("y1"))
    at = edges.join(level, "pid").filter("(y1 > y) <> (y2 > y)").select("pid", "y", (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"))
    first = at.groupBy("pid").agg(F.min("x").alias("one"))
    return at.join(first, "pid").filter("x > one").groupBy("pid", "y").agg(((F.min("one") + F.min("x")) / 2).alias("x")).select("pid", "x", "y")


def objects_within(inner: DataFrame, outer: DataFrame, size: float = 0.5) -> DataFrame:
    """(pid1, pid2): polygons of the first set that lie in one of the second, its edges included.

    Candidates have their box inside and a corner inside or on an edge. Such a polygon is inside if its vertices are, the middles of the
    parts into which contacts cut its edges are, a point of its interior is, and no vertex or part of an edge of the other, of a hole or
    a bay, is inside it and off its edges.
    """
    ea, eb = (numbered_edges(r).select("pid", *EDGE) for r in (inner, outer))
    met = materialise(contacts(ea, eb), "contacts")
    corner = _corners(inner, "pid1").groupBy("pid1").agg(F.min(F.struct("lon", "lat")).alias("c")).select("pid1", "c.*")
    inside = corner.join(points_in_polygons(corner, outer, size).withColumnRenamed("pid", "pid2"), ["lon", "lat"]).select("pid1", "pid2")
    extent = lambda e, p: e.groupBy(F.col("pid").alias(p)).agg(*(f(g(*c)).alias(f"{p}{n}") for n, f, g, c in (("w", F.min, F.least, ("x1", "x2")), ("s", F.min, F.least, ("y1", "y2")), ("e", F.max, F.greatest, ("x1", "x2")), ("n", F.max, F.greatest, ("y1", "y2")))))
    pairs = inside.unionByName(met.select(F.col("a.pid").alias("pid1"), F.col("b.pid").alias("pid2"))).distinct().join(extent(ea, "pid1"), "pid1").join(extent(eb, "pid2"), "pid2")
    pairs = materialise(pairs.filter("pid1w >= pid2w and pid1s >= pid2s and pid1e <= pid2e and pid1n <= pid2n").select("pid1", "pid2"), "candidates")
    met = met.join(pairs, (met["a.pid"] == pairs.pid1) & (met["b.pid"] == pairs.pid2), "left_semi")
    on = lambda e, f, k: met.filter(side(e, f, k) == 0).select(F.col("a.pid").alias("pid1"), F.col("b.pid").alias("pid2"), F.col(f"{f}.x{k}").alias("x"), F.col(f"{f}.y{k}").alias("y"))
    ends = lambda e, f: on(e, f, 1).unionByName(on(e, f, 2)).distinct()
    vertices = pairs.join(ea.select(F.col("pid").alias("pid1"), F.col("x1").alias("x"), F.col("y1").alias("y")).distinct(), "pid1")
    free = vertices.join(ends("b", "a"), ["pid1", "pid2", "x", "y"], "left_anti")
    within = pairs.join(interior(ea).withColumnRenamed("pid", "pid1"), "pid1").select("pid1", "pid2", "x", "y")
    tested = free.select("pid1", "pid2", "x", "y").unionByName(_between(met, "a", "b")).unionByName(within)
    buckets = covered(outer, size).withColumnRenamed("pid", "pid2").withColumn("there", F.lit(True))
    placed = with_bucket(tested, size, "x", "y").join(buckets, ["pid2", "bx", "by"], "left")
    out = placed.filter(F.col("there").isNull() | ~in_bucket("x", "y")).select("pid1", "pid2")
    # what of the other's outline is inside
    corners = eb.select(F.col("pid").alias("pid2"), F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    holding = points_in_polygons(corners.select(F.col("x").alias("lon"), F.col("y").alias("lat")), inner, size).select(F.col("pid").alias("pid1"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    pierced = corners.join(holding, ["x", "y"]).join(ends("a", "b"), ["pid1", "pid2", "x", "y"], "left_anti").select("pid1", "pid2")
    middles = _between(met, "b", "a")
    held = with_bucket(middles, size, "x", "y").join(covered(inner, size).withColumnRenamed("pid", "pid1"), ["pid1", "bx", "by"]).filter(in_bucket("x", "y")).select("pid1", "pid2")
    return pairs.join(out.unionByName(pierced).unionByName(held).distinct(), ["pid1", "pid2"], "left_anti")


def objects_within_area(objects: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """(pid) of objects that lie in one of the members (pid a member's own) of a geometry or a collection, each once; the lowest
    `limit` of them, if given."""
    found = objects_within(objects, members).select(F.col("pid1").alias("pid")).distinct()
    return found if limit is None else found.orderBy("pid").limit(limit)


def invalid_polygons(rings: DataFrame, size: float = 0.5) -> DataFrame:
    """(pid, fault): polygons that are not valid, each with its faults.

    'open' or 'short' rings (not closed, fewer than four vertices), 'flat' ones, edges that 'cross' or run along each other, rings that
    'touch' themselves, 'loose' holes outside their part's outer ring, 'nested' holes and parts in one another. Rings that touch each
    other in points are valid.
    """
    n = F.size("xs")
    last = lambda c: F.get(c, n - 1)
    closed = (F.get("xs", F.lit(0)) == last("xs")) & (F.get("ys", F.lit(0)) == last("ys"))
    turn = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.get("xs", i - 1) * F.get("ys", i) - F.get("xs", i) * F.get("ys", i - 1))
    short, loose_ends = F.coalesce(n, F.lit(0)) < 4, (n > 0) & ~closed
    faults = F.array(F.when(short, "short"), F.when(loose_ends, "open"), F.when(~short & ~loose_ends & (turn == 0), "flat"))
    single = rings.select("pid", F.explode(F.array_compact(faults)).alias("fault"))
    edges = numbered_edges(rings).filter("x1 <> x2 or y1 <> y2")
    met = contacts(edges, edges, ["pid"]).filter("(a.part, a.ring, a.k) < (b.part, b.ring, b.k)")
    ring = F.expr("a.part = b.part and a.ring = b.ring")
    beside = ring & (F.expr("b.k = a.k + 1 or (a.k = 0 and b.k = b.last)"))
    # edges along each other share more than an end if their boxes do
    wide = F.expr("least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) > greatest(least(a.x1, a.x2), least(b.x1, b.x2)) or least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) > greatest(least(a.y1, a.y2), least(b.y1, b.y2))")
    crossing = F.when(F.col("proper") | (F.col("along") & wide), "cross").when(ring & ~beside, "touch")
    crossed = met.select(F.col("a.pid").alias("pid"), crossing.alias("fault")).filter("fault is not null")
    # rings as polygons of their own: a hole must be in its part's outer ring only, an outer ring in none
    key = F.struct("pid", "part", "ring")
    # of a polygon of one ring there is nothing to find
    several = rings.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1").select("pid")
    alone = rings.join(several, "pid", "left_semi").select(key.alias("pid"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "xs", "ys")
    on = met.filter(~ring).select(F.explode(F.array(*(F.struct(F.struct(*(F.col(f"{e}.{c}") for c in ("pid", "part", "ring"))).alias("r"), F.col(f"{e}.x1").alias("lon"), F.col(f"{e}.y1").alias("lat")) for e in ("a", "b")))).alias("o")).select("o.*")
    ends = edges.select(F.struct("pid", "part", "ring").alias("r"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    free = ends.join(on.distinct(), ["r", "lon", "lat"], "left_anti").groupBy("r").agg(F.min(F.struct("lon", "lat")).alias("c")).select("r", "c.lon", "c.lat")
    # by polygon as well as by bucket, so that polygons that lie over each other do not meet
    buckets = covered(alone, size).withColumnRenamed("pid", "o").withColumn("own", F.col("o.pid"))
    lies = with_bucket(free.withColumn("own", F.col("r.pid")), size).join(buckets, ["own", "bx", "by"]).filter("r <> o").filter(in_bucket("lon", "lat")).select("r", "o")
    home = lies.filter("r.ring > 0 and o.part = r.part and o.ring = 0").select("r")
    holes = free.filter("r.ring > 0").select("r")
    loose = holes.join(home, "r", "left_anti").select("r.pid", F.lit("loose").alias("fault"))
    # within the outer ring of another part, but not in one of that part's holes; or a hole in a hole
    other = lies.filter("o.part <> r.part").groupBy("r", "o.part").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("r.pid")
    nested = lies.filter("r.ring > 0 and o.ring > 0 and o.part = r.part").select("r.pid").unionByName(other).withColumn("fault", F.lit("nested"))
    return single.unionByName(crossed).unionByName(loose).unionByName(nested).distinct()
