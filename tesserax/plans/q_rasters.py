"""Queries: rasters, legends, scatter data, models, hulls, remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import legends as L
from tesserax.operators import models as M
from tesserax.operators import rasters as R
from tesserax.operators import spatial as S
from tesserax.operators.overlay import planar_area
from tesserax.plans.q_aggregates import r6, sq_angle, sq_cell
from tesserax.plans.q_spatial import ODD, dart
from tesserax.plans.views import Registry
from tesserax.sources import grids as G
from tesserax.sources.scratch import materialise

query = Registry()
GRID = dict(west=112.0, north=-10.0, res=0.25, rows=140, cols=160)


def _layers(v):
    return {"el1": v.cells_el1, "el2": v.cells_el2}


def _double(cells):
    return cells.withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})


@query("ras1_cut_layers", "select a.row, a.col, a.value as el1, b.value as el2 from {cells_el1} a join {cells_el2} b on a.row = b.row and a.col = b.col where a.lon between 118 and 140 and a.lat between -40 and -18")
def _(v):
    return R.cut(_layers(v), R.sub_grid(v.cells_el1, 118, -40, 140, -18))


@query("ras2_environmental_envelope", f"select count(*) as cells, round(sum({sq_cell('0.25', 'a.lat')}), 3) as km2, min(a.row) as row0, max(a.row) as row1, min(a.col) as col0, max(a.col) as col1, 0.25 * pow(2.0, greatest(0, ceil(log2((max(a.row) - min(a.row) + 1) * (max(a.col) - min(a.col) + 1) / 1000.0) / 2))) as res from {{cells_el1}} a join {{cells_el2}} b on a.row = b.row and a.col = b.col where a.value between 10 and 50 and b.value between 5 and 40")
def _(v):
    own = R.envelope_cells(_layers(v), {"el1": (10, 50), "el2": (5, 40)})
    return R.envelope_summary(own, v.cells_el1, 0.25, 1000).withColumn("km2", F.round("km2", 3))


# whether a segment e and the closed cell c (a quarter of a degree wide) share a point
CELL_SIDES = ", ".join(f"(e.x2 - e.x1) * (c.lat {b} 0.125 - e.y1) - (e.y2 - e.y1) * (c.lon {a} 0.125 - e.x1)" for a in "+-" for b in "+-")
MEETS_CELL = f"(least(e.x1, e.x2) <= c.lon + 0.125 and greatest(e.x1, e.x2) >= c.lon - 0.125 and least(e.y1, e.y2) <= c.lat + 0.125 and greatest(e.y1, e.y2) >= c.lat - 0.125 and least({CELL_SIDES}) <= 0 and greatest({CELL_SIDES}) >= 0)"


@query("ras3_region_mask", f"""with t as (select c.row, c.col, bool_or({MEETS_CELL}) as met, {ODD.format(x='c.lon', y='c.lat')} as inside from {{cells_el1}} c, {{dart}} e group by 1, 2, c.lon, c.lat)
    select row, col, not met as full_ from t where met or inside""")
def _(v):
    return R.region_mask(v.cells_el1, dart(v), 0.25).withColumnRenamed("full", "full_")


@query("ras4_standardise", " union all ".join(f"select {t}::double as target, cast(floor(row * 0.25 / {t} + 0.125 / {t}) as int) as row, cast(floor(col * 0.25 / {t} + 0.125 / {t}) as int) as col, round(avg(value), 6) as value from {{cells_el1}} group by 2, 3" for t in (0.5, 1.0)))
def _(v):
    return R.standardise(v.cells_el1, 0.25, [0.1, 0.5, 1.0], 112.0, -10.0).select("target", "row", "col", *r6("value"))


@query("ras5_rasterise", "select row, col, pid from {cells_el1} c join {areas} a on c.lon between a.minx and a.maxx and c.lat between a.miny and a.maxy")
def _(v):
    return R.rasterise(v.cells_el1, S.boxes_to_rings(v.areas))


@query("ras6_vectorise_classes", """with recursive c as (select row, col, value, cast(row as bigint) * 2147483648 + col as id from {cells_cl3}),
    e as (select a.id as x, b.id as y from c a join c b on a.value = b.value and ((a.row = b.row and abs(a.col - b.col) = 1) or (a.col = b.col and abs(a.row - b.row) = 1))),
    t as (select id, id as root from c union select e.y, t.root from t join e on t.id = e.x and t.root < e.y),
    l as (select id, min(root) as region from t group by 1),
    r as (select c.*, l.region from c join l on c.id = l.id),
    quads as (select a.region, count(*) as k from r a join r b on a.region = b.region and b.row = a.row and b.col = a.col + 1 join r d on a.region = d.region and d.row = a.row + 1 and d.col = a.col join r f on a.region = f.region and f.row = a.row + 1 and f.col = a.col + 1 group by 1)
    select r.value, r.region, count(*) as cells, cast(2 - (count(*) - coalesce(sum(n.k), 0) / 2 + coalesce(any_value(q.k), 0)) as bigint) as rings, round(count(*) * 0.0625, 6) as area
    from r left join (select x, count(*) as k from e group by 1) n on n.x = r.id left join quads q on q.region = r.region group by 1, 2""")
def _(v):
    labelled = materialise(R.regions(v.cells_cl3), "regions")
    rings = R.region_rings(labelled, 112.0, -10.0, 0.25)
    shell = F.when(F.col("ring") == 0, 1).otherwise(-1)
    outline = rings.groupBy("region").agg(F.count("*").alias("rings"), F.round(F.sum(shell * planar_area("xs", "ys")), 6).alias("area"))
    return labelled.groupBy("value", "region").agg(F.count("*").alias("cells")).join(outline, "region").select("value", "region", "cells", "rings", "area")


@query("ras7_envelope_polygon", """with c as (select a.row, a.col from {cells_el1} a join {cells_el2} b on a.row = b.row and a.col = b.col where a.value between 10 and 50 and b.value between 5 and 40),
    v as (select row + r as row, col + k as col, sum(case r * 2 + k when 0 then 8 when 1 then 4 when 2 then 2 else 1 end) as m from c, (select unnest([0, 1]) as r), (select unnest([0, 1]) as k) group by 1, 2)
    select count(*) as cells, round(count(*) * 0.0625, 6) as area, (select sum(case when m in (1, 2, 4, 8, 7, 11, 13, 14) then 1 when m in (6, 9) then 2 else 0 end) from v)::bigint as corners from c""")
def _(v):
    own = materialise(R.regions(R.envelope_cells(_layers(v), {"el1": (10, 50), "el2": (5, 40)}).withColumn("value", F.lit(1))), "regions")
    rings = R.region_rings(own, 112.0, -10.0, 0.25)
    shell = F.when(F.col("ring") == 0, 1).otherwise(-1)
    area = F.coalesce(F.sum(shell * planar_area("xs", "ys")), F.lit(0.0))  # no cell, no outline
    outline = rings.agg(F.round(area, 6).alias("area"), F.sum(F.size("xs") - 1).alias("corners"))
    return own.agg(F.count("*").alias("cells")).join(outline).select("cells", "area", "corners")


@query("ras8_reclassify", "select row, col, value % 7 as value from {cells_cl3}")
def _(v):
    classes = v.cells_cl3.select("value", (F.col("value") % 7).cast("string").alias("name")).distinct()
    low = classes.groupBy("name").agg(F.min("value").alias("new"))
    out = R.reclassify(v.cells_cl3.select("row", "col", "value"), classes)
    return out.join(low, out.value == low.new).select("row", "col", F.col("name").cast("int").alias("value"))


@query("ras9_hide_missing", "select row, col, value from {cells_el1} a where not exists (select 1 from {cells_el2} b where a.row = b.row and a.col = b.col)")
def _(v):
    return R.where_missing(v.cells_el1, v.cells_el2, keep=False).select("row", "col", "value")


@query("ras10_sub_grid", "select row, col, value from {cells_el1} where lon between 118 and 140 and lat between -40 and -18")
def _(v):
    return R.sub_grid(v.cells_el1, 118, -40, 140, -18).select("row", "col", "value")


#: Which side of a triangle's edges a point is on.
TURN = "((c.{1} - c.{0}) * (lat - c.{2}) - (c.{3} - c.{2}) * (lon - c.{0}))"
TURNS = ", ".join(TURN.format(*e) for e in (("ax", "bx", "ay", "b_y"), ("bx", "cx", "b_y", "cy"), ("cx", "ax", "cy", "ay")))


@query("ras11_lattice_points", f"""select pid, lon, lat from (select *, least(ax, bx, cx) + i * 0.375 as lon, least(ay, b_y, cy) + j * 0.375 as lat from {{corners}}, (select unnest(range(0, 200)) as i), (select unnest(range(0, 200)) as j)) c
    where least({TURNS}) >= 0 or greatest({TURNS}) <= 0""")
def _(v):
    return R.lattice(S.triangles_to_rings(v.corners), 0.375)


# -- legends ------------------------------------------------------------------------------------------------------------

RANGE = "(select min(l_extendedprice) as lo, max(l_extendedprice) as hi from {lineitem}), (select unnest(range(0, 10)) as i)"


@query("leg1_even_interval", f"select cast(i as int) as idx, round(case when i = 9 then hi else lo + (hi - lo) * ((i + 1) / 10) end, 6) as cut from {RANGE}")
def _(v):
    return L.cut_points(v.lineitem, "l_extendedprice").select("idx", *r6("cut"))


@query("leg2_even_log", f"select cast(i as int) as idx, round(case when i = 9 then hi else exp(ln(lo + s) + (ln(hi + s) - ln(lo + s)) * ((i + 1) / 10)) - s end, 4) as cut from (select *, case when lo < 1 then 1 - lo else 0 end as s from {RANGE})")
def _(v):
    return L.cut_points(v.lineitem, "l_extendedprice", kind="log").select("idx", F.round("cut", 4).alias("cut"))


@query("leg2_even_log10", "select cast(i as int) as idx, round(case when i = 9 then hi else pow(10.0, log10(lo + s) + (log10(hi + s) - log10(lo + s)) * ((i + 1) / 10)) - s end, 4) as cut from (select *, case when lo < 1 then 1 - lo else 0 end as s from (select min(c_acctbal) as lo, max(c_acctbal) as hi from {customer}), (select unnest(range(0, 10)) as i))")
def _(v):
    return L.cut_points(v.customer, "c_acctbal", kind="log10").select("idx", F.round("cut", 4).alias("cut"))


@query("leg3_equal_size", "select cast(g - 1 as int) as idx, max(v) as cut from (select v, ntile(10) over (order by v) as g from (select distinct c_acctbal as v from {customer})) group by 1")
def _(v):
    return L.cut_points(v.customer, "c_acctbal", kind="size")


@query("leg4_equal_area", "select cast(row_number() over (order by max(v)) - 1 as int) as idx, max(v)::double as cut from (select v, sum(n) over (order by v) as upto, sum(n) over () as total from (select l_quantity as v, count(*) as n from {lineitem} group by 1)) group by cast(ceil(upto * 10 / total) as int)")
def _(v):
    return L.equal_area(v.lineitem, "l_quantity")


@query("leg5_decade", "select cast(floor(year / 10) * 10 as int) as lo, cast(floor(year / 10) * 10 + 9 as int) as hi, count(*) as n from {occurrences} group by 1, 2")
def _(v):
    return L.decade_legend(v.occurrences)


@query("leg6_group_sizes", "with e as (select min(l_quantity) as lo, max(l_quantity) as hi from {lineitem}), b as (select cast(i as int) as idx, case when i = 0 then -1e9 else lo + (hi - lo) * (i / 10) end as p, case when i = 9 then hi else lo + (hi - lo) * ((i + 1) / 10) end as c from e, (select unnest(range(0, 10)) as i)) select idx, count(distinct l_quantity) as n_values, count(l_quantity) as n_cells from b left join {lineitem} on l_quantity > p and l_quantity <= c group by 1")
def _(v):
    return L.group_sizes(v.lineitem, "l_quantity", L.cut_points(v.lineitem, "l_quantity"))


BOUNDS = """with e as (select min(c_acctbal) as lo, max(c_acctbal) as hi, case when min(c_acctbal) < 1 then 1 - min(c_acctbal) else 0 end as s from {customer}),
    cuts as (select 'even' as kind, i, lo + (hi - lo) * (i / 10) as p, case when i = 9 then hi else lo + (hi - lo) * ((i + 1) / 10) end as c from e, (select unnest(range(0, 10)) as i)
      union all select 'log', i, exp(ln(lo + s) + (ln(hi + s) - ln(lo + s)) * (i / 10)) - s, case when i = 9 then hi else exp(ln(lo + s) + (ln(hi + s) - ln(lo + s)) * ((i + 1) / 10)) - s end from e, (select unnest(range(0, 10)) as i)
      union all select 'log10', i, pow(10.0, log10(lo + s) + (log10(hi + s) - log10(lo + s)) * (i / 10)) - s, case when i = 9 then hi else pow(10.0, log10(lo + s) + (log10(hi + s) - log10(lo + s)) * ((i + 1) / 10)) - s end from e, (select unnest(range(0, 10)) as i)),
    n as (select kind, i, count(distinct c_acctbal) as n from cuts left join {customer} on (i = 0 or c_acctbal > p) and c_acctbal <= c group by 1, 2),
    s as (select kind, round(stddev_pop(n), 6) as score from n group by 1)"""


@query("leg7_score", BOUNDS + " select kind, score, kind = (select kind from s order by score, array_position(['even', 'log', 'log10'], kind) limit 1) as chosen from s")
def _(v):
    return L.score(v.customer, "c_acctbal").select("kind", *r6("score"), "chosen")


@query("leg8_category_legend", "select o_orderpriority as value, count(*) as n, cast(row_number() over (order by count(*) desc, o_orderpriority) as int) as rank from {orders} group by 1")
def _(v):
    return L.category_legend(v.orders, "o_orderpriority")


@query("leg9_field_legend", "select p_brand as label, count(*) as n from {part} group by 1")
def _(v):
    return L.field_legend(v.part, "p_brand")


# values that none has a share of ten to itself: classes end where the running count passes each tenth
TENTHS = "(select v, sum(n) over (order by v) as upto, sum(n) over () as total from (select {column} as v, count(*) as n from {{{table}}} group by 1))"


@query("leg9_field_legend_numeric", "select cast(max(v) as varchar) as label, cast(max(upto) - coalesce(lag(max(upto)) over (order by max(v)), 0) as bigint) as n from " + TENTHS.format(column="l_quantity", table="lineitem") + " group by cast(ceil(upto * 10 / total) as int)")
def _(v):
    return L.field_legend(v.lineitem, "l_quantity")


@query("leg10_grid_legend", """with c as (select row_number() over (order by max(v)) - 1 as idx, max(v)::double as cut from (select v, sum(n) over (order by v) as upto, sum(n) over () as total from (select value as v, count(*) as n from {cells_el1} where row % 2 = 0 and col % 2 = 0 group by 1)) group by cast(ceil(upto * 10 / total) as int)),
    b as (select idx, cut, coalesce(lag(cut) over (order by idx), -1e9) as p from c)
    select cast(idx as int) as idx, cut, count(distinct value) as n_values, count(value) as n_cells from b left join {cells_el1} on value > p and value <= cut group by 1, 2""")
def _(v):
    cuts = L.equal_area(G.decimated(v.cells_el1, 2), "value")
    return L.group_sizes(v.cells_el1, "value", cuts).join(cuts, "idx").select("idx", "cut", "n_values", "n_cells")


@query("leg11_tail_rollup", "with r as (select species, count(*) as n, row_number() over (order by count(*) desc, species) as k from {occurrences} group by 1) select species as label, n from r where k <= 10 union all select cast(count(*) as varchar) || ' more', cast(sum(n) as bigint) from r where k > 10")
def _(v):
    return L.tail_rolled_up(v.occurrences, "species", 10)


# -- scatter data -------------------------------------------------------------------------------------------------------


def _sampled(v):
    return S.sample_grid(S.sample_grid(v.occurrences, v.cells_el1, "el1", **GRID), v.cells_el2, "el2", **GRID)


@query("scat1_dataset", "select species as series, count(*) as n, count(*) filter (el1 is null or el2 is null) as missing, round(avg(case when el2 is not null then el1 end), 6) as x, round(avg(case when el1 is not null then el2 end), 6) as y from {samples} group by 1")
def _(v):
    gone = F.col("el1").isNull() | F.col("el2").isNull()
    return _sampled(v).groupBy(F.col("species").alias("series")).agg(F.count("*").alias("n"), F.count_if(gone).alias("missing"), F.round(F.avg(F.when(~gone, F.col("el1"))), 6).alias("x"), F.round(F.avg(F.when(~gone, F.col("el2"))), 6).alias("y"))


@query("scat2_selection_flags", "select rec_order, rec_line, lon between 118 and 130 and lat between -35 and -20 as in_area, el1 between 10 and 50 and el2 between 5 and 40 as in_range from {samples} where el1 is not null and el2 is not null")
def _(v):
    own = _sampled(v).filter("el1 is not null and el2 is not null")
    return own.select("rec_order", "rec_line", geo.in_box("lon", "lat", *map(F.lit, (118, -35, 130, -20))).alias("in_area"), (F.col("el1").between(10, 50) & F.col("el2").between(5, 40)).alias("in_range"))


@query("scat3_pairs", "select 'el1' as a, 'el2' as b, count(*) as n, round(corr(el1, el2), 6) as corr from {samples} where el1 is not null and el2 is not null")
def _(v):
    from itertools import combinations

    wide = _sampled(v)
    out = None
    for a, b in combinations(["el1", "el2"], 2):
        one = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("corr")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "corr")
        out = one if out is None else out.unionByName(one)
    return out


@query("scat4_layer_extents", "select min(el1) as min1, max(el1) as max1, min(el2) as min2, max(el2) as max2 from {samples}")
def _(v):
    return _sampled(v).agg(F.min("el1").alias("min1"), F.max("el1").alias("max1"), F.min("el2").alias("min2"), F.max("el2").alias("max2"))


# -- models and hulls ---------------------------------------------------------------------------------------------------


@query("ml1_classification")
def _(v):
    return M.group_means(M.classify(R.cut(_layers(v)), ["el1", "el2"], 5), ["el1", "el2"])


@query("ml2_habitat_model")
def _(v):
    cells = R.cut(_layers(v)).join(v.cells_cl3.select("row", "col", F.col("value").cast("string").alias("cl3")), ["row", "col"])
    found = S.with_cell(v.occurrences.filter("species = 'sp5'"), 112.0, -10.0, 0.25, 140, 160)
    return M.habitat(cells, found, ["el1", "el2"], "cl3")


@query("agg27_extent_of_occurrence")
def _(v):
    return M.extent_of_occurrence(v.occurrences)


@query("agg28_alpha_hull")
def _(v):
    return M.alpha_hull(v.occurrences)


SNAP = "(case when {c} / 0.5 >= 0 then floor({c} / 0.5) else ceil({c} / 0.5) - case when {c} / 0.5 <= -1 then 1 else 0 end end * 0.5)"
REACH = "(40000 / 6378137.0 * 180 / pi())"


@query("agg29_point_radius_area", f"""with s as (select distinct species, {SNAP.format(c='lon')} as x, {SNAP.format(c='lat')} as y from {{occurrences}}),
    r as (select species, x, y, unnest(range(cast(floor((y - {REACH}) / 0.125) as bigint), cast(floor((y + {REACH}) / 0.125) as bigint) + 1)) as r from s),
    c as (select species, x, y, r, unnest(range(cast(floor((x - {REACH} / cos(radians(y))) / 0.125) as bigint), cast(floor((x + {REACH} / cos(radians(y))) / 0.125) as bigint) + 1)) as c from r),
    d as (select distinct species, r, c from c where 6378137.0 * {sq_angle('x', 'y', '(c + 0.5) * 0.125', '(r + 0.5) * 0.125')} <= 40000)
    select species, round(sum({sq_cell('0.125', '(r + 0.5) * 0.125')}), 3) as km2 from d group by 1""")
def _(v):
    return M.point_radius_area(v.occurrences, 40_000.0, 0.5, 0.125).withColumn("km2", F.round("km2", 3))


# -- functions ----------------------------------------------------------------------------------------------------------


@query("fn4_distance_azimuth", "select pid, round(2 * 6378137 * asin(sqrt(pow(sin(radians(lat + 25) / 2), 2) + cos(radians(lat)) * cos(radians(-25)) * pow(sin(radians(lon - 133) / 2), 2))), 3) as distance, round((degrees(atan2(lon - 133, lat + 25)) + 360) % 360, 6) as azimuth from {point_objects}")
def _(v):
    return v.point_objects.select("pid", F.round(geo.sphere_distance("lon", "lat", F.lit(133), F.lit(-25)), 3).alias("distance"), F.round(geo.azimuth(F.lit(133), F.lit(-25), "lon", "lat"), 6).alias("azimuth"))


@query("fn5_mercator_metres", "select pid, round(lon * 20037508.342789244 / 180, 4) as mx, round(ln(tan((radians(lat) + pi() / 2) / 2)) * 20037508.342789244 / pi(), 4) as my, round(lon, 9) as lon, round(lat, 9) as lat from {point_objects}")
def _(v):
    own = v.point_objects.withColumns({"mx": geo.lon_to_metres("lon"), "my": geo.lat_to_metres("lat")})
    return own.select("pid", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round(geo.metres_to_lon("mx"), 9).alias("lon"), F.round(geo.metres_to_lat("my"), 9).alias("lat"))


@query("fn6_pixels", "select pid, cast(floor(268435456 + lon * (268435456 / 180) + 0.5) as bigint) as px, cast(floor(268435456 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) * (268435456 / pi() / 2) + 0.5) as bigint) as py from {point_objects}")
def _(v):
    return v.point_objects.select("pid", geo.lon_to_pixel("lon").alias("px"), geo.lat_to_pixel("lat").alias("py"))


@query("fn7_circle", """select pid, round(max(y), 6) as north, round(min(y), 6) as south, count(*) + 1 as vertices from (select pid, degrees(asin(cos(50000 / 6378137.0) * sin(radians(lat)) + sin(50000 / 6378137.0) * cos(radians(lat)) * cos(radians(k)))) as y from {point_objects}, (select unnest(range(0, 360)) as k)) group by 1""")
def _(v):
    ys = geo.let(geo.circle("lon", "lat", F.lit(50000)), lambda c: F.transform(c, lambda p: p["y"]))
    own = S.spread(v.point_objects.select("pid", "lon", "lat")).withColumn("c", geo.let(ys, lambda y: F.struct(F.array_max(y).alias("north"), F.array_min(y).alias("south"), F.size(y).alias("n"))))
    return own.select("pid", F.round("c.north", 6).alias("north"), F.round("c.south", 6).alias("south"), F.col("c.n").cast("long").alias("vertices"))


@query("fn8_snap", "select rec_order, rec_line, case when lat / 0.5 >= 0 then floor(lat / 0.5) else ceil(lat / 0.5) - case when lat / 0.5 <= -1 then 1 else 0 end end * 0.5 as y from {occurrences}")
def _(v):
    return v.occurrences.select("rec_order", "rec_line", geo.snap("lat", 0.5).alias("y"))


WKT = "printf('POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', {a}, {b}, {a}, {d}, {c}, {d}, {c}, {b}, {a}, {b})"


@query("fn9_cell_polygon", "select row, col, " + WKT.format(a="(lon - 0.125)::double", b="(lat - 0.125)::double", c="(lon + 0.125)::double", d="(lat + 0.125)::double") + " as wkt from {cells_el1}")
def _(v):
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    return v.cells_el1.select("row", "col", geo.box_wkt(lon - 0.125, lat - 0.125, lon + 0.125, lat + 0.125).alias("wkt"))


@query("fn10_cell_indexes", "select rec_order, rec_line, cast(trunc((lon - 130) / 0.5) as int) as t, cast(floor((lon - 130) / 0.5 + 0.5) as int) as r, cast(ceil((lon - 130) / 0.5) as int) as c, cast(floor((lon - 130) / 0.5) as int) as f from {occurrences}")
def _(v):
    at = lambda m: geo.cell_index("lon", F.lit(130.0), 0.5, m)
    return v.occurrences.select("rec_order", "rec_line", at("truncate").alias("t"), at("round").alias("r"), at("ceil").alias("c"), at("floor").alias("f"))


@query("fn11_min_max_scale", "select row, col, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 9) as s from {cells_el1}")
def _(v):
    e = v.cells_el1.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    return v.cells_el1.select("row", "col", F.round(geo.min_max_scale("value", F.lit(e.lo), F.lit(e.hi)), 9).alias("s"))


@query("fn12_align_extent", "select pid, floor(ax / 0.7) * 0.7 as lo, greatest(ceil(bx / 0.7) * 0.7, floor(ax / 0.7) * 0.7 + 1.4) as hi from {corners}")
def _(v):
    lo, hi = geo.align("ax", "bx", 0.7)
    return v.corners.select("pid", lo.alias("lo"), hi.alias("hi"))


@query("fn13_normalise_ring", "select pid, 4 as n, least(180, greatest(-180, ax + 40)) as x0, least(180, greatest(-180, cx + 40)) as x2 from {corners}")
def _(v):
    xs, ys = F.array(F.col("ax") + 40, F.col("bx") + 40, F.col("cx") + 40), F.array("ay", "b_y", "cy")
    r = geo.normalise_ring(xs, ys)
    return v.corners.select("pid", r.alias("r")).select("pid", F.size("r.xs").alias("n"), F.get("r.xs", F.lit(0)).alias("x0"), F.get("r.xs", F.lit(2)).alias("x2"))


@query("fn14_polygon_distance", "select p.pid as point, a.pid, round(sqrt(pow(greatest(a.minx - p.lon, 0, p.lon - a.maxx), 2) + pow(greatest(a.miny - p.lat, 0, p.lat - a.maxy), 2)), 6) as d from {point_objects} p join {areas} a on a.pid = p.pid % 25")
def _(v):
    rings = S.boxes_to_rings(v.areas)
    own = v.point_objects.select(F.col("pid").alias("point"), "lon", "lat", (F.col("pid") % 25).alias("pid"))
    return own.join(rings, "pid").select("point", "pid", F.round(geo.ring_distance("lon", "lat", "xs", "ys"), 6).alias("d"))


@query("fn15_bbox_text", "select pid, " + WKT.format(a="minx", b="miny", c="maxx", d="maxy") + " as wkt from {areas}")
def _(v):
    return v.areas.select("pid", geo.box_wkt("minx", "miny", "maxx", "maxy").alias("wkt"))


@query("fn16_decade", "select rec_order, rec_line, cast(ceil(year / 10) as int) as decade, cast((cast(ceil(year / 10) as int) - 1) * 10 + 1 as varchar) || '-' || cast(cast(ceil(year / 10) as int) * 10 as varchar) as label from {occurrences}")
def _(v):
    from tesserax.operators.aggregates import decade

    d = decade("year")
    return v.occurrences.select("rec_order", "rec_line", d.alias("decade"), F.concat(((d - 1) * 10 + 1).cast("string"), F.lit("-"), (d * 10).cast("string")).alias("label"))


@query("fn17_species_key", "select p_partkey, p_name as name, p_brand as lsid, p_type as family from {part}")
def _(v):
    parts = F.split(F.concat_ws("|", "p_name", "p_brand", F.lit("common"), F.lit("kingdom"), "p_type"), r"\|")
    return v.part.select("p_partkey", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("lsid"), F.get(parts, F.lit(4)).alias("family"))
