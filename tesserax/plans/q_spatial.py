"""Queries: sources of geometry, predicates, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import catalogue as C
from tesserax.operators import spatial as S
from tesserax.operators import topology as T
from tesserax.plans.views import Registry
from tesserax.sources.scratch import materialise

query = Registry()
GRID = dict(west=112.0, north=-10.0, res=0.25, rows=140, cols=160)
CELL = "cast(floor((-10 - lat) / 0.25) as int) as row, cast(floor((lon - 112) / 0.25) as int) as col"
# even-odd rule over an edge table e, for a point (x, y)
ODD = "(sum(case when (e.x1 > {x}) <> (e.x2 > {x}) and {y} < e.y1 + ({x} - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1) then 1 else 0 end) % 2 = 1)"
PIP = "select p.lon, p.lat, e.pid from (select distinct lon, lat from {occurrences}) p join {tri_edges} e on true group by all having " + ODD.replace("{x}", "p.lon").replace("{y}", "p.lat")


@query("pred1_box", "select count(*) as n, count(distinct species) as species from {occurrences} where lon between 120 and 135 and lat between -30 and -20")
def _(v):
    return v.occurrences.filter(geo.in_box("lon", "lat", F.lit(120), F.lit(-30), F.lit(135), F.lit(-20))).agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"))


@query("pred2_circle", "select species, count(*) as n from {occurrences} where (lon - 133) * (lon - 133) + (lat + 25) * (lat + 25) <= 36 group by species")
def _(v):
    return v.occurrences.filter(geo.in_circle("lon", "lat", F.lit(133), F.lit(-25), F.lit(6))).groupBy("species").agg(F.count("*").alias("n"))


@query("pred3_point_in_ring", "select p.lon, p.lat, p.n from (select lon, lat, count(*) as n from {occurrences} group by lon, lat) p join (values (118.0, -40.0, 140.0, -38.0), (140.0, -38.0, 126.0, -15.0), (126.0, -15.0, 118.0, -40.0)) e(x1, y1, x2, y2) on true group by all having " + ODD.format(x="p.lon", y="p.lat"))
def _(v):
    xs, ys = F.array(*map(F.lit, (118.0, 140.0, 126.0, 118.0))), F.array(*map(F.lit, (-40.0, -38.0, -15.0, -40.0)))
    return v.occurrences.filter(geo.in_ring("lon", "lat", xs, ys)).groupBy("lon", "lat").agg(F.count("*").alias("n"))


@query("pred4_point_in_multipolygon", """select o.lon, o.lat, b.pid from (select distinct lon, lat from {occurrences}) o join {areas} b
    on o.lon between b.minx and b.maxx and o.lat between b.miny and b.maxy
    where not (o.lon between b.minx + 2 and b.maxx - 2 and o.lat between b.miny + 1.75 and b.maxy - 1.75)""")
def _(v):
    return S.points_in_polygons(v.occurrences, S.boxes_to_rings(v.nested))


@query("pred5_within_distance", """select lon, lat from {point_objects} where sqrt(pow(greatest(125 - lon, 0, lon - 132), 2) + pow(greatest(-31 - lat, 0, lat + 22), 2)) <= 1.5""")
def _(v):
    xs, ys = F.array(*map(F.lit, (125.0, 125.0, 132.0, 132.0, 125.0))), F.array(*map(F.lit, (-31.0, -22.0, -22.0, -31.0, -31.0)))
    return v.point_objects.filter(geo.ring_distance("lon", "lat", xs, ys) <= 1.5).select("lon", "lat")


PX = "cast(floor(268435456 + {x} * (268435456 / 180) + 0.5) as bigint)"
PY = "cast(floor(268435456 - ln((1 + sin(radians({y}))) / (1 - sin(radians({y})))) * (268435456 / pi() / 2) + 0.5) as bigint)"


@query("pred6_point_in_ring_pixels", f"select pid from {{point_objects}} where {PX.format(x='lon')} between {PX.format(x='125')} and {PX.format(x='132')} and {PY.format(y='lat')} between {PY.format(y='-22')} and {PY.format(y='-31')}")
def _(v):
    x0, x1, y0, y1 = geo.lon_to_pixel(F.lit(125.0)), geo.lon_to_pixel(F.lit(132.0)), geo.lat_to_pixel(F.lit(-22.0)), geo.lat_to_pixel(F.lit(-31.0))
    xs, ys = F.array(x0, x0, x1, x1, x0), F.array(y0, y1, y1, y0, y0)
    return v.point_objects.filter(geo.in_ring(geo.lon_to_pixel("lon"), geo.lat_to_pixel("lat"), xs, ys)).select("pid")


@query("join1_point_polygon", f"select o.rec_order, o.rec_line, min(t.pid) as pid from {{occurrences}} o left join ({PIP}) t on o.lon = t.lon and o.lat = t.lat group by o.rec_order, o.rec_line, o.species, o.year")
def _(v):
    own = v.occurrences.select("rec_order", "rec_line", "species", "year", "lon", "lat")
    found = S.first_polygon(own, S.triangles_to_rings(v.corners))
    return found.groupBy("rec_order", "rec_line", "species", "year").agg(F.min("pid").alias("pid")).select("rec_order", "rec_line", "pid")


@query("join2_polygons_within_distance", """select p.pid as point, a.pid as pid, round(sqrt(pow(greatest(a.minx - p.lon, 0, p.lon - a.maxx), 2) + pow(greatest(a.miny - p.lat, 0, p.lat - a.maxy), 2)), 6) as distance
    from {point_objects} p join {areas} a on sqrt(pow(greatest(a.minx - p.lon, 0, p.lon - a.maxx), 2) + pow(greatest(a.miny - p.lat, 0, p.lat - a.maxy), 2)) <= 1.0""")
def _(v):
    found = S.polygons_within(v.point_objects, S.boxes_to_rings(v.areas), 1.0)
    return v.point_objects.select(F.col("pid").alias("point"), "lon", "lat").join(found, ["lon", "lat"]).select("point", "pid", F.round("distance", 6).alias("distance"))


@query("join3_point_raster", "select rec_order, rec_line, species, el1 from {samples}")
def _(v):
    return S.sample_grid(v.occurrences, v.cells_el1, "el1", **GRID).select("rec_order", "rec_line", "species", "el1")


@query("join4_point_classes", f"select p.pid, c.name from (select pid, {CELL} from {{point_objects}}) p left join {{cells_cl3}} c on c.row = p.row and c.col = p.col")
def _(v):
    names = v.cells_cl3.select("value", "name").distinct()
    return S.sample_classes(v.point_objects, v.cells_cl3, names, "name", **GRID).select("pid", "name")


@query("join5_batch_sampling", f"""select s.rec_order, s.rec_line, s.species, s.el1, s.el2, c.name as cl3, t.pid as cl1 from {{samples}} s
    left join {{cells_cl3}} c on c.row = cast(floor((-10 - s.lat) / 0.25) as int) and c.col = cast(floor((s.lon - 112) / 0.25) as int)
    left join (select lon, lat, min(pid) as pid from ({PIP}) group by lon, lat) t on t.lon = s.lon and t.lat = s.lat""")
def _(v):
    from tesserax.operators.rasters import stack

    wide = stack({"el1": v.cells_el1, "el2": v.cells_el2, "class": v.cells_cl3})
    names = v.cells_cl3.select(F.col("value").alias("class"), F.col("name").alias("cl3")).distinct()
    out = S.with_cell(v.occurrences, **GRID).join(wide, ["row", "col"], "left").join(names, "class", "left").drop("row", "col", "class")
    out = S.first_polygon(out, S.triangles_to_rings(v.corners)).withColumnRenamed("pid", "cl1")
    return out.select("rec_order", "rec_line", "species", "el1", "el2", "cl3", "cl1")


@query("join6_sample_wide", """select p.pid, a.value as el1, b.value as el2, c.value as cl3 from (select pid, cast(floor((-10 - lat) / 0.25) as int) as row, cast(floor((lon - 112) / 0.25) as int) as col from {point_objects}) p
    left join {cells_el1} a on a.row = p.row and a.col = p.col left join {cells_el2} b on b.row = p.row and b.col = p.col left join {cells_cl3} c on c.row = p.row and c.col = p.col""")
def _(v):
    from tesserax.operators.rasters import stack

    wide = stack({"el1": v.cells_el1, "el2": v.cells_el2, "cl3": v.cells_cl3})
    return S.with_cell(v.point_objects, **GRID).join(wide, ["row", "col"], "left").select("pid", "el1", "el2", "cl3")


@query("join7_point_detail", """select p.pid, p.lon, p.lat, a.pid as area_pid, a.name as area_name, f.name as layer, f.description, case f.spid % 3 when 0 then 'mm' when 1 then 'degrees' else 'percent' end as units, e.value as el1
    from {point_objects} p left join {areas} a on p.lon between a.minx and a.maxx and p.lat between a.miny and a.maxy
    left join {cells_el1} e on e.row = cast(floor((-10 - p.lat) / 0.25) as int) and e.col = cast(floor((p.lon - 112) / 0.25) as int)
    left join {fields} f on f.id = concat(case p.pid % 3 when 0 then 'el' else 'cl' end, cast(p.pid as varchar))""")
def _(v):
    own = S.sample_grid(v.point_objects, v.cells_el1, "el1", **GRID).withColumnRenamed("pid", "point")
    found = S.first_polygon(own, S.boxes_to_rings(v.areas)).join(v.areas.select("pid", F.col("name").alias("area_name")), "pid", "left")
    unit = F.when(F.col("spid") % 3 == 0, "mm").when(F.col("spid") % 3 == 1, "degrees").otherwise("percent")
    layers = v.fields.select(F.col("id").alias("fid_"), F.col("name").alias("layer"), "description", unit.alias("units"))
    field = F.concat(F.when(F.col("point") % 3 == 0, "el").otherwise("cl"), F.col("point").cast("string"))
    found = found.withColumn("fid_", field).join(layers, "fid_", "left").withColumn("units", F.when(F.col("layer").isNotNull(), F.col("units")))
    return found.select(F.col("point").alias("pid"), "lon", "lat", F.col("pid").alias("area_pid"), "area_name", "layer", "description", "units", "el1")


@query("join8_objects_at_location", f"""with t as ({PIP}) select o.rec_order, o.rec_line, cast(t.pid as varchar) as pid from {{occurrences}} o join t on o.lon = t.lon and o.lat = t.lat
    union all select o.rec_order, o.rec_line, 'grid:' || c.name from {{occurrences}} o join {{cells_cl3}} c on c.row = cast(floor((-10 - o.lat) / 0.25) as int) and c.col = cast(floor((o.lon - 112) / 0.25) as int)
    where not exists (select 1 from t where t.lon = o.lon and t.lat = o.lat)""")
def _(v):
    places, members = S.points_in_shapes(v.occurrences, S.triangles_to_rings(v.corners))
    places, own, pids = materialise(places, "places"), v.occurrences.select("rec_order", "rec_line", "lon", "lat"), S.member_lists(members)
    # records meet shapes first; a shape's polygons come last, as lists, so that no row of the result is shuffled or joined
    found = own.join(places, ["lon", "lat"]).join(pids, "shape").select("rec_order", "rec_line", F.explode("pids").alias("pid"))
    # where no polygon holds the place, the class of its cell
    names = v.cells_cl3.select("value", "name").distinct()
    outside = own.join(places.select("lon", "lat").distinct(), ["lon", "lat"], "left_anti")
    none = S.sample_classes(outside, v.cells_cl3, names, "name", **GRID).filter("name is not null")
    return found.unionByName(none.select("rec_order", "rec_line", F.concat(F.lit("grid:"), "name").alias("pid")))


@query("join9_objects_intersecting", "select a.pid as pid1, b.pid as pid2 from {areas} a join {areas2} b on a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy")
def _(v):
    return T.objects_intersecting(S.boxes_to_rings(v.areas), S.boxes_to_rings(v.areas2))


PROPER = "(sign((t.x2 - t.x1) * (o.y1 - t.y1) - (t.y2 - t.y1) * (o.x1 - t.x1)) * sign((t.x2 - t.x1) * (o.y2 - t.y1) - (t.y2 - t.y1) * (o.x2 - t.x1)) < 0 and sign((o.x2 - o.x1) * (t.y1 - o.y1) - (o.y2 - o.y1) * (t.x1 - o.x1)) * sign((o.x2 - o.x1) * (t.y2 - o.y1) - (o.y2 - o.y1) * (t.x2 - o.x1)) < 0)"


def dart(v):
    """The concave area of the view `dart` as rings."""
    corner = v.dart.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "x1", "y1"))).alias("p"))
    axis = lambda c: F.concat(F.transform("p", lambda p: p[c].cast("double")), F.array(F.col("p")[0][c].cast("double")))
    return corner.select(F.lit(0).alias("pid"), F.lit(0).alias("part"), F.lit(0).alias("ring"), axis("x1").alias("xs"), axis("y1").alias("ys"))


@query("join10_objects_within_area", f"""with inside as (select t.pid, t.x1, t.y1, {ODD.format(x='t.x1', y='t.y1')} as v from {{tri_edges}} t, {{dart}} e group by all),
    whole as (select pid from inside group by 1 having bool_and(v))
    select pid from whole where pid not in (select t.pid from {{tri_edges}} t, {{dart}} o where {PROPER})""")
def _(v):
    return T.objects_within_area(S.triangles_to_rings(v.corners), dart(v))


IN_BOX = "(least(ax, bx, cx) >= m.minx and greatest(ax, bx, cx) <= m.maxx and least(ay, b_y, cy) >= m.miny and greatest(ay, b_y, cy) <= m.maxy)"


@query("join10_objects_within_collection", f"select pid from {{corners}} where exists (select 1 from {{areas}} a join (values (0), (1), (2), (3)) as t(k) on true, lateral (select a.minx - 4 * (t.k % 2) as minx, a.maxx + 4 * (t.k % 2) as maxx, a.miny - 5 * (t.k // 2) as miny, a.maxy + 5 * (t.k // 2) as maxy) m where {IN_BOX}) order by pid limit 40")
def _(v):
    # a collection of overlapping members: each area, and it widened to the sides, upwards and both
    wide = v.areas.select("pid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "minx", "miny", "maxx", "maxy")
    x, y = 4 * (F.col("k") % 2), 5 * F.floor(F.col("k") / 2)
    members = wide.select((F.col("pid") * 4 + F.col("k")).alias("pid"), (F.col("minx") - x).alias("minx"), (F.col("miny") - y).alias("miny"), (F.col("maxx") + x).alias("maxx"), (F.col("maxy") + y).alias("maxy"))
    return T.objects_within_area(S.triangles_to_rings(v.corners), S.boxes_to_rings(members), limit=40)


@query("join9_touching_objects", "select a.pid as pid1, b.pid as pid2 from {areas} a join {areas} b on a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy")
def _(v):
    return T.objects_intersecting(S.boxes_to_rings(v.areas), S.boxes_to_rings(v.areas))


@query("join11_objects_within_object", f"""with s as (select pid, part, ring, ax + (x1 - ax) / 8 as x1, ay + (y1 - ay) / 8 as y1, ax + (x2 - ax) / 8 as x2, ay + (y2 - ay) / 8 as y2 from {{tri_edges}} join (select pid, ax, ay from {{corners}}) using (pid)),
    inside as (select t.pid as pid1, e.pid as pid2, t.x1, t.y1, {ODD.format(x='t.x1', y='t.y1')} as v from s t, {{half_edges}} e group by all)
    select pid1, pid2 from inside group by 1, 2 having bool_and(v)""")
def _(v):
    near = lambda c, o: (F.col(o) + (F.col(c) - F.col(o)) / 8).alias(c)
    small = v.corners.select("pid", "ax", "ay", near("bx", "ax"), near("b_y", "ay"), near("cx", "ax"), near("cy", "ay"))
    return T.objects_within(S.triangles_to_rings(small), S.triangles_to_rings(v.halves))


@query("join12_objects_by_envelope", f"""select p.pid from (select pid, {CELL} from {{point_objects}}) p join {{cells_el1}} a on a.row = p.row and a.col = p.col
    join {{cells_el2}} b on b.row = p.row and b.col = p.col where a.value between 10 and 50 and b.value between 5 and 40""")
def _(v):
    one = S.sample_grid(v.point_objects, v.cells_el1, "x", **GRID).filter(F.col("x").between(10, 50))
    two = S.sample_grid(v.point_objects, v.cells_el2, "x", **GRID).filter(F.col("x").between(5, 40))
    return S.in_all([one, two])


HAV = "2 * 6378137 * asin(sqrt(pow(sin(radians(lat - ({y})) / 2), 2) + cos(radians(lat)) * cos(radians({y})) * pow(sin(radians(lon - ({x})) / 2), 2)))"


def spheroid(x: float, y: float) -> str:
    """SQL of (pid, lon, lat, distance) of point objects from a place along the spheroid: the longitude settled step by step, each a subquery."""
    f, a = geo.FLAT, geo.AXIS
    b = a * (1 - f)
    u = lambda lat: f"atan({1 - f!r} * tan(radians({lat})))"
    sql = f"select pid, lon, lat, {u(y)} as u1, {u('lat')} as u2, abs(radians(lon - ({x}))) as l, abs(radians(lon - ({x}))) as lam from {{point_objects}}"
    for _ in range(9):
        sql = f"select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs from ({sql})"
        sql = f"select *, atan2(ss, cs) as s, case when ss = 0 then 0 else cos(u1) * cos(u2) * sin(lam) / ss end as sa from ({sql})"
        sql = f"select *, 1 - sa * sa as ca, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) as m, {f / 16!r} * (1 - sa * sa) * (4 + {f!r} * (4 - 3 * (1 - sa * sa))) as c from ({sql})"
        sql = f"select pid, lon, lat, u1, u2, l, l + (1 - c) * {f!r} * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1))) as lam, ss, cs, s, ca, m from ({sql})"
        last, sql = sql, f"select pid, lon, lat, u1, u2, l, lam from ({sql})"
    sql = f"select *, (sqrt(1 + ca * {(a * a - b * b) / (b * b)!r}) - 1) / (sqrt(1 + ca * {(a * a - b * b) / (b * b)!r}) + 1) as k from ({last})"
    sql = f"select *, k * (1 - 3 * k * k / 8) as q from ({sql})"
    ds = "q * ss * (m + q / 4 * (cs * (2 * m * m - 1) - q / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))"
    return f"(select pid, lon, lat, {b!r} * (1 + k * k / 4) / (1 - k) * (s - {ds}) as distance from ({sql}))"


@query("join13_objects_within_radius", f"select pid, round(distance, 3) as distance from {spheroid(133.0, -25.0)} where distance <= 500000")
def _(v):
    return S.within_radius(v.point_objects, 133.0, -25.0, 500_000.0).select("pid", F.round("distance", 3).alias("distance"))


@query("join14_nearest", f"""select pid, round(distance, 3) as distance, round((degrees(atan2(lon - 133.3, lat + 25.1)) + 360) % 360, 6) as azimuth
    from {spheroid(133.3, -25.1)} order by distance, pid limit 40""")
def _(v):
    return S.nearest(v.point_objects, 133.3, -25.1).select("pid", F.round("distance", 3).alias("distance"), F.round("azimuth", 6).alias("azimuth"))


@query("join15_point_in_object", f"select e.pid, {ODD.format(x='131.3', y='-28.7')} as inside from {{tri_edges}} e group by e.pid")
def _(v):
    shapes = S.shapes(S.triangles_to_rings(v.corners))
    return shapes.select("pid", S.in_shape(F.lit(131.3), F.lit(-28.7), "shape").alias("inside"))


@query("join31_distributions_near_point", "select spcode, family from {distributions} where type = 'e' and spcode in (select pid from {corners} where greatest(ax - 130, 0, 130 - bx) <= 8 and sqrt(pow(ax - 130, 2) + pow(ay + 30, 2)) <= 0) union select d.spcode, d.family from {distributions} d join (select pid, min(dd) as m from (select pid, sqrt(pow(130 - (x1 + t * (x2 - x1)), 2) + pow(-30 - (y1 + t * (y2 - y1)), 2)) as dd from (select *, greatest(0, least(1, ((130 - x1) * (x2 - x1) + (-30 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from {tri_edges})) group by pid) m on m.pid = d.spcode where d.type = 'e' and (m.m <= 3 or d.spcode in (select e.pid from {tri_edges} e group by e.pid having " + ODD.format(x="130", y="-30") + "))")
def _(v):
    near = S.shapes(S.triangles_to_rings(v.corners)).filter(S.shape_distance(F.lit(130.0), F.lit(-30.0), "shape") <= 3)
    return v.distributions.filter("type = 'e'").join(near, F.col("spcode") == F.col("pid"), "left_semi").select("spcode", "family")


ARTICLES = f"(select distinct id from (select p.id, p.lon, p.lat, {ODD.format(x='p.lon', y='p.lat')} as v from {{article_points}} p, {{dart}} e where not missing group by p.id, p.loc, p.lon, p.lat) where v)"


@query("join28_articles_in_polygon", f"select id from {ARTICLES}")
def _(v):
    return C.articles_in(v.article_points.filter(~F.col("missing")), dart(v))


@query("join28_count_and_page", f"select 'count' as what, count(*) as id from {ARTICLES} union all select * from (select 'page', id from {ARTICLES} order by id limit 25 offset 50)")
def _(v):
    found = C.articles_in(v.article_points.filter(~F.col("missing")), dart(v))
    page = found.orderBy("id").offset(50).limit(25).select(F.lit("page").alias("what"), F.col("id").cast("long").alias("id"))
    return found.agg(F.count("*").alias("id")).select(F.lit("count").alias("what"), "id").unionByName(page)


@query("set2_union_over_parts", "select distinct pid from {point_objects} where (lon between 115 and 122 and lat between -30 and -20) or (lon between 120 and 130 and lat between -25 and -15)")
def _(v):
    part = lambda *b: v.point_objects.filter(geo.in_box("lon", "lat", *map(F.lit, b))).select("pid")
    return part(115, -30, 122, -20).unionByName(part(120, -25, 130, -15)).dropDuplicates(["pid"])


@query("set3_in_all_lists", "select pid from {objects} where fid = 'cl1' and namesearch and length(name) > 8")
def _(v):
    return S.in_all([v.objects.filter("fid = 'cl1'"), v.objects.filter("namesearch"), v.objects.filter("length(name) > 8")])


# area of the right triangle (minx, miny), (minx, maxy), (maxx, miny) within a box: a sum over the box's corners
CUT = "pow(greatest(0, 1 - greatest({x} - h.ax, 0) / (h.cx - h.ax) - greatest({y} - h.ay, 0) / (h.b_y - h.ay)), 2)"
HALF_IN_BOX = "((h.cx - h.ax) * (h.b_y - h.ay) / 2 * (" + CUT.format(x="b.minx", y="b.miny") + " - " + CUT.format(x="b.maxx", y="b.miny") + " - " + CUT.format(x="b.minx", y="b.maxy") + " + " + CUT.format(x="b.maxx", y="b.maxy") + "))"


@query("join16_polygon_overlay", f"select h.pid as pid1, b.pid as pid2, round({HALF_IN_BOX}, 6) as area from {{halves}} h join {{areas2}} b on h.ax < b.maxx and b.minx < h.cx and h.ay < b.maxy and b.miny < h.b_y where {HALF_IN_BOX} > 1e-9")
def _(v):
    from tesserax.operators.overlay import overlay_area

    return overlay_area(S.triangles_to_rings(v.halves), S.boxes_to_rings(v.areas2)).filter("area > 1e-9").select("pid1", "pid2", F.round("area", 6).alias("area"))


SPH = ("2 * asin(sqrt(pow(sin(radians({b} - {d}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({a} - {c}) / 2), 2)))")


@query("fn3_central_angle", f"select pid, round({SPH.format(a='lon', b='lat', c='133', d='(-25)')}, 9) as angle from {{point_objects}}")
def _(v):
    return v.point_objects.select("pid", F.round(geo.central_angle("lon", "lat", F.lit(133), F.lit(-25)), 9).alias("angle"))
