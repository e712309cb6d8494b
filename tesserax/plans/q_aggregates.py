"""Queries: aggregates over cells, areas, years; windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import aggregates as A
from tesserax.operators import catalogue as C
from tesserax.operators import spatial as S
from tesserax.plans.views import Registry, boxes

query = Registry()
r6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


def sq_angle(a, b, c, d):
    return f"2 * asin(sqrt(pow(sin(radians({b} - {d}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({a} - {c}) / 2), 2)))"


def sq_excess(*p):
    ab, bc, ca = sq_angle(*p[0:4]), sq_angle(*p[2:6]), sq_angle(p[4], p[5], p[0], p[1])
    s = f"(({ab} + {bc} + {ca}) / 2)"
    return f"4 * atan(sqrt(abs(tan({s} / 2) * tan(({s} - {ab}) / 2) * tan(({s} - {bc}) / 2) * tan(({s} - {ca}) / 2))))"


def sq_box(x0, y0, x1, y1):
    """Square metres of a box."""
    return f"(({sq_excess(x0, y0, x0, y1, x1, y1)} + {sq_excess(x0, y0, x1, y1, x1, y0)}) * 6378137.0 * 6378137.0)"


def sq_cell(res, lat):
    low = f"(floor(abs({lat}) / {res}) * {res})"
    return f"({sq_box('0.0', low, f'{res}', f'({low} + {res})')} / 1e6)"


SITES = "select cast(trunc((lat + 45) / 0.5) as int) as row, cast(trunc((lon - 112) / 0.5) as int) as col, species, count(*) as n from {occurrences} group by 1, 2, 3"
W = "cast(ceil(cast(lat as decimal(12,8)) / {r}) as int) as lat_cell, cast(floor(cast(lon as decimal(12,8)) / {r}) as int) as lon_cell"
W1 = "cast(ceil(lat) as int) as lat_cell, cast(floor(lon) as int) as lon_cell"


@query("agg1_sites_by_species", f"select * from ({SITES}) where 112 + (col + 0.5) * 0.5 between 115 and 145 and -45 + (row + 0.5) * 0.5 between -40 and -15")
def _(v):
    return A.sites_by_species(v.occurrences, 112.0, -45.0, 0.5, geo.in_box("x", "y", F.lit(115), F.lit(-40), F.lit(145), F.lit(-15)))


@query("agg2_occurrence_density", "select cast(floor((lat + 45) / 0.5 + 0.5) as int) as row, cast(floor((lon - 112) / 0.5 + 0.5) as int) as col, count(*) as n from {occurrences} group by 1, 2")
def _(v):
    return A.density(v.occurrences, 112.0, -45.0, 0.5)


FOCAL = """from (select d.row + a.o as row, d.col + b.o as col, d.* exclude (row, col) from ({src}) d, (select unnest([-1, 0, 1]) as o) a, (select unnest([-1, 0, 1]) as o) b)
    where row between 0 and 69 and col between 0 and 79 group by row, col"""
INGRID = "((least(row + 1, 69) - greatest(row - 1, 0) + 1) * (least(col + 1, 79) - greatest(col - 1, 0) + 1))"


@query("agg3_focal_mean", f"select row, col, round(sum(n) / {INGRID}, 6) as value " + FOCAL.format(src=f"select row, col, sum(n) as n from ({SITES}) group by 1, 2"))
def _(v):
    cells = A.sites_by_species(v.occurrences, 112.0, -45.0, 0.5).groupBy("row", "col").agg(F.sum("n").alias("n"))
    return A.focal_mean(cells, 3, 70, 80).select("row", "col", *r6("value"))


@query("agg3_focal_mean_wrapped", f"""select row, col, round(sum(n) / ((least(row + 1, 69) - greatest(row - 1, 0) + 1) * 3), 6) as value from (select d.row + a.o as row, (d.col + b.o + 80) % 80 as col, n
    from (select row, col, sum(n) as n from ({SITES}) group by 1, 2) d, (select unnest([-1, 0, 1]) as o) a, (select unnest([-1, 0, 1]) as o) b) where row between 0 and 69 group by row, col""")
def _(v):
    cells = A.sites_by_species(v.occurrences, 112.0, -45.0, 0.5).groupBy("row", "col").agg(F.sum("n").alias("n"))
    return A.focal_mean(cells, 3, 70, 80, wrap=True).select("row", "col", *r6("value"))


@query("agg4_focal_richness", f"select row, col, round(count(distinct species) / {INGRID}, 6) as value " + FOCAL.format(src=f"select row, col, species from ({SITES})"))
def _(v):
    return A.focal_richness(A.sites_by_species(v.occurrences, 112.0, -45.0, 0.5), 3, 70, 80).select("row", "col", *r6("value"))


@query("win3_moving_window", f"select row, col, sum(n)::bigint as n, count(distinct species) as species " + FOCAL.format(src=f"select row, col, species, n from ({SITES})"))
def _(v):
    return A._window(A.sites_by_species(v.occurrences, 112.0, -45.0, 0.5), 3, 70, 80).groupBy("row", "col").agg(F.sum("n").alias("n"), F.countDistinct("species").alias("species"))


P2G = """select row, col, {agg} from (select d.row + a.o as row, d.col + b.o as col, species, n from (
    select cast(floor((lat - y0) / 2) as int) as row, cast(floor((lon - x0) / 2) as int) as col, species, count(*) as n, any_value(e.nr) as nr, any_value(e.nc) as nc
    from {occurrences}, (select floor(min(lon) / 2) * 2 - 2 as x0, floor(min(lat) / 2) * 2 - 2 as y0, ceil((max(lon) + 2 - (floor(min(lon) / 2) * 2 - 2)) / 2) as nc, ceil((max(lat) + 2 - (floor(min(lat) / 2) * 2 - 2)) / 2) as nr from {occurrences}) e
    group by 1, 2, 3) d, (select unnest([-1, 0, 1]) as o) a, (select unnest([-1, 0, 1]) as o) b) p, (select ceil((max(lon) + 2 - (floor(min(lon) / 2) * 2 - 2)) / 2) as nc, ceil((max(lat) + 2 - (floor(min(lat) / 2) * 2 - 2)) / 2) as nr from {occurrences}) e
    where row between 0 and nr - 1 and col between 0 and nc - 1 group by row, col, nr, nc"""
P2G_N = "((least(row + 1, nr - 1) - greatest(row - 1, 0) + 1) * (least(col + 1, nc - 1) - greatest(col - 1, 0) + 1))"


@query("agg5_points_to_grid", P2G.replace("{agg}", f"round(sum(n) / {P2G_N}, 6) as density, round(count(distinct species) / {P2G_N}, 6) as richness"))
def _(v):
    return A.points_to_grid(v.occurrences, 2.0, 3).select("row", "col", *r6("density", "richness"))


@query("agg6_world_counts", f"select * from (select {W1}, count(*) as n from {{occurrences}} group by 1, 2) where (lat_cell, lon_cell) in (select {W1} from {{cells_cl3}} where value % 3 = 0)")
def _(v):
    mask = A.world_cells(v.cells_cl3.filter("value % 3 = 0"), 1)
    return A.world_counts(v.occurrences, 1, mask)


@query("agg7_world_richness", f"select {W1}, count(distinct species) as species from {{occurrences}} group by 1, 2")
def _(v):
    return A.world_richness(v.occurrences, 1)


@query("agg8_endemism", f"with d as (select distinct {W1}, species from {{occurrences}}), r as (select species, count(*) as cells from d group by 1) select lat_cell, lon_cell, round(avg(1 / cells), 6) as value from d join r using (species) group by 1, 2")
def _(v):
    return A.endemism(v.occurrences, 1).select("lat_cell", "lon_cell", *r6("value"))


@query("agg9_shannon", f"with d as (select {W1}, species, count(*) as n from {{occurrences}} group by all), t as (select lat_cell, lon_cell, sum(n) as t from d group by 1, 2) select lat_cell, lon_cell, round(-sum(n / t * ln(n / t)), 6) as value from d join t using (lat_cell, lon_cell) group by 1, 2")
def _(v):
    return A.shannon(v.occurrences, 1).select("lat_cell", "lon_cell", *r6("value"))


@query("agg10_double_gridding", "select cast(floor(lon / 2) as int) as ox, cast(floor(lat / 2) as int) as oy, cast(floor(year / 3) * 3 as int) as bin, count(distinct species) as species, count(distinct (cast(floor(lon / 0.25) as int), cast(floor(lat / 0.25) as int))) as bins, count(*) as n from {occurrences} group by 1, 2, 3")
def _(v):
    return A.double_gridding(v.occurrences, 0.25, 2.0, 3)


@query("agg10_species_counts", "select cast(floor(lon / 2) as int) as ox, cast(floor(lat / 2) as int) as oy, cast(floor(year / 3) * 3 as int) as bin, species, count(distinct (cast(floor(lon / 0.25) as int), cast(floor(lat / 0.25) as int))) as bins, count(*) as n from {occurrences} group by 1, 2, 3, 4")
def _(v):
    return A.double_gridding_species(v.occurrences, 0.25, 2.0, 3)


@query("agg11_richness_by_region", f"select name, richness, count(*) as cells from (select name, {W1}, count(distinct species) as richness from {{hits}} group by 1, 2, 3) group by 1, 2")
def _(v):
    found = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas)).join(v.areas.select("pid", "name"), "pid")
    return A.richness_frequency(found, 1, "name")


@query("agg11_richness_by_decade", f"select decade, richness, count(*) as cells from (select cast(ceil(year / 10) as int) as decade, {W1}, count(distinct species) as richness from {{occurrences}} group by 1, 2, 3) group by 1, 2")
def _(v):
    return A.richness_frequency(v.occurrences.withColumn("decade", A.decade("year")), 1, "decade")


@query("agg12_decade_persistence", f"select decades, count(*) as n from (select {W1}, species, count(distinct cast(ceil(year / 10) as int)) as decades from {{occurrences}} group by 1, 2, 3) group by 1")
def _(v):
    return A.decade_persistence(v.occurrences, 1)


def _pairs(v):
    a = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas)).withColumnRenamed("pid", "pid1")
    return S.every_polygon(a, S.boxes_to_rings(v.areas2.filter("maxx > minx and maxy > miny"))).withColumnRenamed("pid", "pid2")


PAIRS = "select h.*, h.pid as pid1, b.pid as pid2 from {hits} h join {areas2} b on h.lon between b.minx and b.maxx and h.lat between b.miny and b.maxy"


@query("agg13_tabulation_counts", f"select pid1, pid2, count(*) as occurrences, count(distinct species) as species, cast(grouping(pid1) * 2 + grouping(pid2) as int) as side from ({PAIRS}) group by grouping sets ((pid1, pid2), (pid1), (pid2))")
def _(v):
    return A.tabulation_counts(_pairs(v))


@query("agg14_tabulation_matrix", "select pid1, pid2, round(sum((maxx - minx) * (maxy - miny)), 6) as total from {overlay} group by cube (pid1, pid2)")
def _(v):
    tab = S.boxes_overlap(v.areas, v.areas2).withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    return A.matrix_totals(tab).select("pid1", "pid2", *r6("total"))


IN_BOTH = "(select o.*, a.pid as pid1, b.pid as pid2 from {occurrences} o join {areas} a on o.lon between a.minx and a.maxx and o.lat between a.miny and a.maxy join {areas2} b on o.lon between b.minx and b.maxx and o.lat between b.miny and b.maxy)"


@query("agg14_matrix_rows", f"""with t as (select pid1, pid2, sum((maxx - minx) * (maxy - miny)) as v from {{overlay}} group by 1, 2), c as (select distinct pid2 from t), r as (select distinct pid1 from t),
    h as (select * from {IN_BOTH}), s1 as (select pid1, count(distinct species) as s from h group by 1), s2 as (select pid2, count(distinct species) as s from h group by 1),
    m as (select r.pid1, list(round(t.v, 6) order by c.pid2) as cells, round(sum(t.v), 6) as total from r cross join c left join t on t.pid1 = r.pid1 and t.pid2 = c.pid2 group by 1)
    select row_number() over (order by m.pid1) as at_, m.pid1 as pid, array_to_string(cells, ',') as cells_, len(cells) as n, total, s::double as species from m left join s1 on s1.pid1 = m.pid1
    union all select 2147483646, null, (select string_agg(round(v, 6)::varchar, ',' order by pid2) from (select pid2, sum(v) as v from t group by 1)), (select count(*) from c), (select round(sum(v), 6) from t), null
    union all select 2147483647, null, (select string_agg(s::double::varchar, ',' order by c.pid2) from c left join s2 on s2.pid2 = c.pid2), (select count(*) from c), null, null""")
def _(v):
    tab = S.boxes_overlap(v.areas, v.areas2).withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    one = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas)).withColumnRenamed("pid", "pid1")
    hits = S.every_polygon(one, S.boxes_to_rings(v.areas2)).withColumnRenamed("pid", "pid2")
    rows = A.tabulation_matrix(tab, A.tabulation_counts(hits))
    text = F.array_join(F.transform("cells", lambda x: F.round(x, 6).cast("string")), ",")
    return rows.select(F.col("at").alias("at_"), "pid", text.alias("cells_"), F.size("cells").alias("n"), *r6("total"), "species")


# a right triangle over most of the view: legs from its south-west corner
CLIP = "(select 113.0::double as ax, -44.5::double as ay, 151.0::double as cx, -11.5::double as b_y)"
CLIP_CORNER = "pow(greatest(0, 1 - greatest({x} - h.ax, 0) / (h.cx - h.ax) - greatest({y} - h.ay, 0) / (h.b_y - h.ay)), 2)"
CLIPPED = "((h.cx - h.ax) * (h.b_y - h.ay) / 2 * (" + " ".join(s + CLIP_CORNER.format(x=f"o.{x}", y=f"o.{y}") for s, x, y in (("", "minx", "miny"), ("- ", "maxx", "miny"), ("- ", "minx", "maxy"), ("+ ", "maxx", "maxy"))) + "))"


@query("agg15_tabulation_fetch", f"""select pid1, pid2, name1, name2, round({CLIPPED}, 6) as area, count(r.species) as occurrences, count(distinct r.species) as species from {{overlay}} o cross join {CLIP} h
    left join {{occurrences}} r on r.lon between o.minx and o.maxx and r.lat between o.miny and o.maxy and (r.lon - h.ax) / (h.cx - h.ax) + (r.lat - h.ay) / (h.b_y - h.ay) <= 1 and r.lon >= h.ax and r.lat >= h.ay
    where {CLIPPED} > 1e-9 group by all""")
def _(v):
    clip = v._spark.createDataFrame([(0, 113.0, -44.5, 113.0, -11.5, 151.0, -44.5)], "pid int, ax double, ay double, bx double, b_y double, cx double, cy double")
    return C.tabulation_clipped(S.boxes_to_rings(v.areas), S.boxes_to_rings(v.areas2), S.triangles_to_rings(clip), v.occurrences, v.areas, v.areas2).filter("area > 1e-9").select("pid1", "pid2", "name1", "name2", *r6("area"), "occurrences", "species")


TAB = "select o_orderkey % 40 as fid1, o_custkey % 30 as fid2, case when o_orderkey % 11 = 0 then 0 else o_totalprice end as area, o_orderkey % 97 <> 5 as complete from {orders}"


@query("agg16_tabulation_list", f"select fid1, fid2, round(sum(area), 2) as area from ({TAB}) t where fid1 < fid2 and not exists (select 1 from ({TAB}) x where x.fid1 = t.fid1 and x.fid2 = t.fid2 and not x.complete) group by 1, 2 having sum(area) > 0")
def _(v):
    t = v.orders.select((F.col("o_orderkey") % 40).alias("fid1"), (F.col("o_custkey") % 30).alias("fid2"), F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("area"), (F.col("o_orderkey") % 97 != 5).alias("complete"))
    from tesserax.operators.catalogue import tabulation_list

    return tabulation_list(t).withColumn("area", F.round("area", 2))


@query("agg17_records_in_area", "select pid, count(*) as n, count(distinct species) as species from {hits} group by pid")
def _(v):
    return S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas)).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"))


@query("agg18_single_field_tabulation", f"select pid, name, round({sq_box('greatest(minx, 118.0)', 'greatest(miny, -40.0)', 'least(maxx, 140.0)', 'least(maxy, -18.0)')} / 1e6, 3) as km2 from {{areas}} where minx < 140 and maxx > 118 and miny < -18 and maxy > -40")
def _(v):
    cut = S.boxes_overlap(v.areas, boxes(v, (0, 118.0, -40.0, 140.0, -18.0))).withColumn("km2", F.round(geo.box_area("minx", "miny", "maxx", "maxy") / 1e6, 3))
    return v.areas.select("pid", "name").join(cut, F.col("pid") == F.col("pid1")).select("pid", "name", "km2")


OF_HALF = "((h.cx - h.ax) * (h.b_y - h.ay) / 2 * (" + " ".join(s + CLIP_CORNER.format(x=f"b.{x}", y=f"b.{y}") for s, x, y in (("", "minx", "miny"), ("- ", "maxx", "miny"), ("- ", "minx", "maxy"), ("+ ", "maxx", "maxy"))) + "))"


@query("agg18_single_field_forms", f"""select 'object' as form, h.pid::varchar as pid, name, round({OF_HALF}, 6) as area from {{halves}} h join (select minx, miny, maxx, maxy from {{areas2}} where pid = 112) b on true where {OF_HALF} > 1e-9
    union all select 'world', pid::varchar, name, round((cx - ax) * (b_y - ay) / 2, 6) from {{halves}}
    union all select 'grid', c.value::varchar, '', round(sum({sq_cell('0.25', 'c.lat')}), 3) from {{cells_cl3}} c join (select * from {{areas2}} where pid = 112) a on c.lon between a.minx and a.maxx and c.lat between a.miny and a.maxy group by c.value""")
def _(v):
    from tesserax.operators import catalogue as C

    halves, one = S.triangles_to_rings(v.halves), S.boxes_to_rings(v.areas2.filter("pid = 112"))
    shape = lambda d, form: d.filter("area > 1e-9").select(F.lit(form).alias("form"), F.col("pid").cast("string").alias("pid"), "name", *r6("area"))
    grid = C.single_grid_field(v.cells_cl3, one, 0.25).select(F.lit("grid").alias("form"), F.col("value").cast("string").alias("pid"), F.lit("").alias("name"), F.round("km2", 3).alias("area"))
    return shape(C.single_field(halves, v.halves, one), "object").unionByName(shape(C.single_field(halves, v.halves), "world")).unionByName(grid)


@query("agg19_percent_of_area", "select c.value, count(*) as cells, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from {cells_cl3} c group by 1")
def _(v):
    return A.percent_of_total(v.cells_cl3.groupBy("value").agg(F.count("*").alias("cells")), "cells").select("value", "cells", *r6("percent"))


BOX_TEXT = "printf('POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', {a}, {b}, {a}, {d}, {c}, {d}, {c}, {b}, {a}, {b})".format(a="minx", b="miny", c="maxx", d="maxy")


@query("agg20_overlay_import", f"select pid1 % 5 as v1, pid2 % 5 as v2, round(sum({sq_box('minx', 'miny', 'maxx', 'maxy')} / 1e6), 2) as km2, 'GEOMETRYCOLLECTION(' || string_agg({BOX_TEXT}, ',' order by {BOX_TEXT}) || ')' as geometry from {{overlay}} group by 1, 2")
def _(v):
    cut = S.boxes_overlap(v.areas, v.areas2).select((F.col("pid1") % 5).alias("v1"), (F.col("pid2") % 5).alias("v2"), (geo.box_area("minx", "miny", "maxx", "maxy") / 1e6).alias("a"), geo.box_wkt("minx", "miny", "maxx", "maxy").alias("w"))
    text = F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(F.array_sort(F.collect_list("w")), ","), F.lit(")"))
    return cut.groupBy("v1", "v2").agg(F.round(F.sum("a"), 2).alias("km2"), text.alias("geometry"))


@query("agg21_species_by_layer", f"select a.pid, a.name, count(h.species) as n, count(distinct h.species) as species, round({sq_box('minx', 'miny', 'maxx', 'maxy')} / 1e6, 3) as km2 from {{areas}} a left join {{hits}} h on a.pid = h.pid group by all")
def _(v):
    inside = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas)).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"))
    named = v.areas.select("pid", "name", F.round(geo.box_area("minx", "miny", "maxx", "maxy") / 1e6, 3).alias("km2"))
    return named.join(inside, "pid", "left").na.fill(0, ["n", "species"]).select("pid", "name", "n", "species", "km2")


BIN = "least(cast(floor((el1 - lo) / ((hi - lo) / 16)) as int), 15)"


@query("agg22_species_by_environment", f"select {BIN} as bin, count(*) as n, count(distinct species) as species from {{samples}}, (select min(el1) as lo, max(el1) as hi from {{samples}}) where el1 is not null group by 1")
def _(v):
    own = S.sample_grid(v.occurrences, v.cells_el1, "el1", west=112.0, north=-10.0, res=0.25, rows=140, cols=160)
    return A.binned(own, "el1").groupBy("bin").agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"))


@query("agg22_environment_area", f"select least(cast(floor((value - lo) / ((hi - lo) / 16)) as int), 15) as bin, round(sum({sq_cell('0.25', 'lat')}), 3) as km2 from {{cells_el1}}, (select min(value) as lo, max(value) as hi from {{cells_el1}}) group by 1")
def _(v):
    return A.binned(v.cells_el1, "value").groupBy("bin").agg(F.round(F.sum(geo.cell_area(0.25, "lat")), 3).alias("km2"))


FREQ = "select year, count(*) as n from {occurrences} where year >= 1996 group by 1"


@query("agg23_taxon_frequency", f"select year, n, cast(sum(n) over (order by year) as bigint) as running from ({FREQ})")
def _(v):
    return A.taxon_frequency(v.occurrences, 1996)


@query("win1_running_total", "select species, year, n, cast(sum(n) over (partition by species order by year) as bigint) as running from (select species, year, count(*) as n from {occurrences} group by 1, 2)")
def _(v):
    from pyspark.sql import Window

    n = v.occurrences.groupBy("species", "year").agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.partitionBy("species").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


@query("win2_running_ratio", """with a as (select year, count(*) as n1 from {occurrences} where species = 'sp5' and year >= 1995 group by 1), b as (select year, count(*) as n2 from {occurrences} where species = 'sp7' and year >= 1995 group by 1),
    j as (select coalesce(a.year, b.year) as year, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2 from a full join b on a.year = b.year),
    r as (select *, sum(n1) over (order by year) / nullif(sum(n2) over (order by year), 0) as ratio from j)
    select year, n1, n2, round(ratio, 6) as ratio, round(sum(ratio) over (order by year), 6) as running_ratio from r""")
def _(v):
    return A.frequency_ratio(v.occurrences.filter("species = 'sp5'"), v.occurrences.filter("species = 'sp7'"), 1995).select("year", "n1", "n2", *r6("ratio", "running_ratio"))


@query("win4_row_numbers", "select s_suppkey, 5000000 + row_number() over (order by s_suppkey) - 1 as spcode from {supplier}")
def _(v):
    from tesserax.sources.records import numbered

    return numbered(v.supplier, "s_suppkey", "spcode", 5_000_000).select("s_suppkey", "spcode")


@query("win5_share_of_total", "select species, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from {occurrences} group by 1")
def _(v):
    return A.percent_of_total(v.occurrences.groupBy("species").agg(F.count("*").alias("n")), "n").select("species", "n", *r6("percent"))


@query("agg24_facet_counts", "select species as value, count(*) as n, count(*) over () as values_, cast(sum(count(*)) over () as bigint) as total from {occurrences} group by 1")
def _(v):
    from tesserax.operators.catalogue import facet_counts

    return facet_counts(v.occurrences, "species")


@query("agg25_species_list", "select species, count(*) as n from {occurrences} where year = 1998 group by 1")
def _(v):
    return v.occurrences.filter("year = 1998").groupBy("species").agg(F.count("*").alias("n"))


SNAP = "case when {c} / 0.5 >= 0 then floor({c} / 0.5) else ceil({c} / 0.5) - case when {c} / 0.5 <= -1 then 1 else 0 end end"


@query("agg26_area_of_occupancy", f"select species, count(distinct ({SNAP.format(c='lon')}, {SNAP.format(c='lat')})) as cells, count(distinct ({SNAP.format(c='lon')}, {SNAP.format(c='lat')})) * 0.25 * 10000 as km2 from {{occurrences}} group by 1")
def _(v):
    return A.area_of_occupancy(v.occurrences, 0.5)


@query("join25_compare_areas", """with a as (select species, count(*) as n1 from {hits} where pid = 3 group by 1), b as (select species, count(*) as n2 from {hits} where pid = 12 group by 1)
    select coalesce(a.species, b.species) as species, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, case when n2 is null then 'only 1' when n1 is null then 'only 2' else 'both' end as status from a full join b on a.species = b.species""")
def _(v):
    own = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas.filter("pid in (3, 12)")))
    return A.compare_areas(own.filter("pid = 3"), own.filter("pid = 12"))


@query("join25_compare_field", """with o as (select distinct pid, species || '_' || (rec_order % 20)::varchar as species from {hits}), n as (select pid, count(*) as n from o group by 1),
    b as (select a.pid as pid1, c.pid as pid2, count(*) as n from o a join o c using (species) where a.pid < c.pid group by 1, 2)
    select x.pid as pid1, y.pid as pid2, x.n - coalesce(b.n, 0) as only1, y.n - coalesce(b.n, 0) as only2, coalesce(b.n, 0) as "both" from n x join n y on x.pid < y.pid left join b on b.pid1 = x.pid and b.pid2 = y.pid""")
def _(v):
    records = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas))
    return A.compare_field(records.withColumn("species", F.concat_ws("_", "species", (F.col("rec_order") % 20).cast("string"))))


TAXON = "concat(species, '_', cast(year as varchar), '_', cast(rec_order % 20 as varchar))"


@query("set1_species_partition", f"""with a as (select distinct {TAXON} as species from {{hits}} where pid = 3), b as (select distinct {TAXON} as species from {{hits}} where pid = 12)
    select coalesce(a.species, b.species) as species, case when b.species is null then 'only 1' when a.species is null then 'only 2' else 'both' end as status from a full join b on a.species = b.species""")
def _(v):
    own = S.every_polygon(v.occurrences, S.boxes_to_rings(v.areas.filter("pid in (3, 12)")))
    own = own.withColumn("species", F.concat_ws("_", "species", "year", F.col("rec_order") % 20))
    return A.species_partition(own.filter("pid = 3"), own.filter("pid = 12"))


SCALED = "(select *, (value - min(value) over ()) / (max(value) over () - min(value) over ())::double as v from {{{0}}})"
#: As the operator scales: a grid of one value is 0 throughout.
SCALED_OR_0 = "(select *, case when max(value) over () > min(value) over () then (value - min(value) over ()) / (max(value) over () - min(value) over ())::double else 0 end as v from {{{0}}})"
#: The views' grids; the coarse one has cells of 0.625 degrees and another extent, with edges inside the others' cells.
FINE, COARSE = A.Lattice(112.0, -10.0, 0.25, 140, 160), A.Lattice(115.125, -12.75, 0.625, 40, 50)
IN_COARSE = "b.row = least(floor((-12.75 - a.lat) / 0.625::double), 39) and b.col = least(floor((a.lon - 115.125) / 0.625::double), 49) and a.lon between 115.125 and 146.375 and a.lat between -37.75 and -12.75"


@query("agg30_layer_distance", f"select round(avg(abs(a.v - b.v)), 6) as distance from {SCALED.format('cells_el1')} a join {SCALED.format('cells_el2')} b using (row, col)")
def _(v):
    return A.layer_distance(v.cells_el1, v.cells_el2, FINE, FINE).select(*r6("distance"))


@query("agg30_unequal_lattices", f"""with f as (select avg(abs(a.v - b.v)) as d, count(*) as n from {SCALED_OR_0.format('cells_el1')} a join {SCALED_OR_0.format('cells_coarse')} b on {IN_COARSE})
    select 'fine first' as way, round(d, 6) as distance, n as cells from f union all select 'coarse first', round(d, 6), n from f""")
def _(v):
    one = A.layer_distance(v.cells_el1, v.cells_coarse, FINE, COARSE).select(F.lit("fine first").alias("way"), *r6("distance"))
    two = A.layer_distance(v.cells_coarse, v.cells_el1, COARSE, FINE).select(F.lit("coarse first").alias("way"), *r6("distance"))
    n = A.common_cells(v.cells_el1, v.cells_coarse, FINE, COARSE).agg(F.count("*").alias("cells"))
    return one.unionByName(two).crossJoin(F.broadcast(n))


@query("agg32_class_statistics", f"select value, count(*) as cells, round(sum({sq_cell('0.25', 'lat')}), 3) as km2, min(lon) - 0.125 as minx, min(lat) - 0.125 as miny, max(lon) + 0.125 as maxx, max(lat) + 0.125 as maxy from {{cells_cl3}} group by 1")
def _(v):
    return A.class_statistics(v.cells_cl3, 0.25).withColumn("km2", F.round("km2", 3))


@query("agg34_grid_min_max", "select min(value) as lo, max(value) as hi from {cells_el1}")
def _(v):
    return v.cells_el1.filter(~F.isnan("value")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("agg45_endemic_species", "select distinct concat(species, '_', cast(year as varchar), '_', cast(rec_order % 20 as varchar)) as species from {hits} where pid = 7 and concat(species, '_', cast(year as varchar), '_', cast(rec_order % 20 as varchar)) not in (select concat(species, '_', cast(year as varchar), '_', cast(rec_order % 20 as varchar)) from {hits} where pid <> 7)")
def _(v):
    own = v.occurrences.withColumn("species", F.concat_ws("_", "species", "year", F.col("rec_order") % 20))
    found = S.every_polygon(own, S.boxes_to_rings(v.areas))
    return A.endemic_species(found.filter("pid = 7"), found.filter("pid <> 7"))


@query("agg51_extent_intersection", "select max(minx) as minx, max(miny) as miny, min(maxx) as maxx, min(maxy) as maxy, max(minx) < min(maxx) and max(miny) < min(maxy) as valid from (select min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy from {cells_el1} union all select min(lon), min(lat), max(lon), max(lat) from {cells_el2} union all select min(lon), min(lat), max(lon), max(lat) from {occurrences})")
def _(v):
    box = lambda d: d.agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    return A.extent_intersection(box(v.cells_el1).unionByName(box(v.cells_el2)).unionByName(box(v.occurrences)))


@query("fn2_cell_area", f"select row, col, round({sq_cell('0.25', 'lat')}, 6) as km2 from {{cells_el1}}")
def _(v):
    return v.cells_el1.select("row", "col", F.round(geo.cell_area(0.25, "lat"), 6).alias("km2"))


@query("fn1_spherical_area", f"select pid, round({sq_excess('ax', 'ay', 'bx', 'b_y', 'cx', 'cy')} * 6378137.0 * 6378137.0 / 1e6, 3) as km2 from {{corners}}")
def _(v):
    return S.triangles_to_rings(v.corners).select("pid", F.round(F.abs(geo.ring_area("xs", "ys")) / 1e6, 3).alias("km2"))
