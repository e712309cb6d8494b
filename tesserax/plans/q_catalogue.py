"""Queries: predicates as builders, look-ups, catalogue joins, search, logs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import aggregates as A
from tesserax.operators import catalogue as C
from tesserax.operators import spatial as S
from tesserax.operators import topology as T
from tesserax.operators.overlay import merged, planar_area
from tesserax.plans.q_aggregates import COARSE, FINE, IN_COARSE, SCALED_OR_0, TAXON, sq_cell, sq_excess
from tesserax.plans.views import Registry, boxes
from tesserax.sources.records import in_order
from tesserax.sources.scratch import materialise

query = Registry()
GRID = dict(west=112.0, north=-10.0, res=0.25, rows=140, cols=160)


def _sampled(v):
    out = S.sample_grid(S.sample_grid(v.occurrences, v.cells_el1, "el1", **GRID), v.cells_el2, "el2", **GRID)
    return S.sample_grid(out, v.cells_cl3, "cl3", **GRID)


@query("pred7_environmental_range", "select row, col, value from {cells_el1} where value between 10 - 1e-7 and 50 + 1e-7")
def _(v):
    return v.cells_el1.filter(C.environmental_range("value", 10, 50)).select("row", "col", "value")


@query("pred8_envelope", "select rec_order, rec_line from {samples} s join {cells_cl3} c on c.row = cast(floor((-10 - s.lat) / 0.25) as int) and c.col = cast(floor((s.lon - 112) / 0.25) as int) where el1 between 10 and 50 and el2 between 5 and 40 and c.value in (3, 4, 10, 11, 12)")
def _(v):
    return _sampled(v).filter(C.envelope("ENVELOPE(el1,10,50:el2,5,40:cl3,3,4,10,11,12)")).select("rec_order", "rec_line")


@query("pred9_facet", "select species, year, count(*) as n from {occurrences} where (species = 'sp5' or species = 'sp7' or year between 1995 and 1996) and not (species = 'sp9') group by 1, 2")
def _(v):
    return v.occurrences.filter(C.facet('(species:sp5 OR species:"sp7" OR year:[1995 TO 1996]) AND -species:sp9')).groupBy("species", "year").agg(F.count("*").alias("n"))


@query("pred10_year_facet", "select 'a' as k, count(*) as n from {occurrences} where year between 1996 and 1997 union all select 'b', count(*) from {occurrences} where year <= 1849 union all select 'c', count(*) from {occurrences} where year between 1990 and 1999")
def _(v):
    one = lambda k, t: v.occurrences.filter(C.year_facet(t)).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
    return one("a", "[1996 TO 1997]").unionByName(one("b", "before")).unionByName(one("c", "1990s"))


@query("pred11_species_query_with_area", "select species, count(*) as n from {hits} where pid = 12 and lon between 126 and 133 and year = 1997 group by 1")
def _(v):
    area = S.every_polygon(v.occurrences.filter(C.facet("year:[1997 TO 1997]")), S.boxes_to_rings(v.areas.filter("pid = 12")))
    return area.filter(geo.in_box("lon", "lat", F.lit(126), F.lit(-90), F.lit(133), F.lit(90))).groupBy("species").agg(F.count("*").alias("n"))


@query("pred12_sensitive_records", "select species, count(*) as n, 'kept' as part from {occurrences} where rec_order % 50 <> 0 group by 1 union all select species, 0, 'sensitive' from (select distinct species from {occurrences} where rec_order % 50 = 0)")
def _(v):
    kept, found = C.without_sensitive(v.occurrences.withColumn("sensitive", F.when(F.col("rec_order") % 50 == 0, "yes")))
    return kept.groupBy("species").agg(F.count("*").alias("n")).withColumn("part", F.lit("kept")).unionByName(found.select("species", F.lit(0).cast("long").alias("n"), F.lit("sensitive").alias("part")))


@query("pred13_layer_search", "select id, displayname from {layers} where enabled and (keywords ilike '%ring%' or displayname ilike '%ring%' or name ilike '%ring%' or domain ilike '%ring%')")
def _(v):
    return v.layers.filter("enabled").filter(C.matches("RING", "keywords", "displayname", "name", "domain")).select("id", "displayname")


@query("pred14_field_search", "select f.id, f.name from {fields} f join {layers} l on f.spid = l.id where l.enabled and f.enabled and (f.name ilike '%small%' or l.keywords ilike '%small%' or l.displayname ilike '%small%' or l.name ilike '%small%' or l.type ilike '%small%')")
def _(v):
    both = v.fields.filter("enabled").join(v.layers.filter("enabled").select(F.col("id").alias("spid"), "keywords", "displayname", F.col("name").alias("lname"), F.col("type").alias("ltype")), "spid")
    return both.filter(C.matches("small", "name", "keywords", "displayname", "lname", "ltype")).select("id", "name")


@query("pred15_objects_of_field", "select pid, name from {objects} where fid = 'cl2' and (name ilike '%r%' or descr ilike '%r%') order by pid limit 50 offset 10")
def _(v):
    return v.objects.filter("fid = 'cl2'").filter(C.matches("r", "name", "descr")).orderBy("pid").offset(10).limit(50).select("pid", "name")


@query("pred15_classes_of_field", """select pid::varchar as pid, name from (select pid, name from {objects} where fid = 'cl3' and (name ilike '%an%' or descr ilike '%an%') order by pid limit 20 offset 5)
    union all select * from (select '31:' || value, name from (select distinct value, name from {cells_cl3}) where name ilike '%1%' order by value limit 12 offset 3)""")
def _(v):
    classes = v.cells_cl3.select(F.lit("cl9").alias("fid"), F.lit("31").alias("layer"), "value", "name").distinct()
    return C.objects_of_field(v.objects, classes, "cl3", "an", 5, 20).unionByName(C.objects_of_field(v.objects, classes, "cl9", "1", 3, 12))


@query("pred16_distribution_filter", "select spcode, lsid from {distributions} where type = 'e' and lsid in ('lsid:3', 'lsid:6', 'lsid:9', 'lsid:12') and data_resource in ('dr0', 'dr3') and spcode in (select pid from {corners} where least(ax, bx, cx) < 140 and greatest(ax, bx, cx) > 115)")
def _(v):
    near = S.boxes_overlap(S.shapes(S.triangles_to_rings(v.corners)), boxes(v, (0, 115.0, -90.0, 140.0, 90.0)))
    own = v.distributions.filter("type = 'e'").filter(F.col("lsid").isin("lsid:3", "lsid:6", "lsid:9", "lsid:12") & F.col("data_resource").isin("dr0", "dr3"))
    return own.join(near, F.col("spcode") == F.col("pid1"), "left_semi").select("spcode", "lsid")


@query("pred17_log_filter", "select event_id from {log} where category1 = 'Tool' and created >= timestamp '2024-01-10' and created < timestamp '2024-01-20' and user_id not in (select c_custkey from {customer} where c_mktsegment = 'BUILDING')")
def _(v):
    staff = v.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    own = v.log.filter("category1 = 'Tool' and created >= timestamp_ntz '2024-01-10' and created < timestamp_ntz '2024-01-20'")
    return own.join(staff, "user_id", "left_anti").select("event_id")


@query("pred18_domain_compatibility", "select id from {layers} where domain is null or list_has_any(list_transform(string_split(lower(domain), ','), lambda x: trim(x)), ['marine'])")
def _(v):
    return v.layers.filter(C.domains_meet(F.col("domain"), F.lit("Marine , Other"))).select("id")


#: Four-cornered polygons: a triangle's corners and a fourth; with every fifth left open. Opposite sides that meet make them invalid.
FOUR = "(select pid, ax as px, ay as py, bx as qx, b_y as qy, cx as rx, cy as ry, ax + pid % 9 - cast(4 as double) as sx, ay + pid % 7 - cast(2.5 as double) as sy from {corners})"
SIDES = "(({1}x - {0}x) * ({2}y - {0}y) - ({1}y - {0}y) * ({2}x - {0}x))"
APART = lambda a, b, c, d: f"sign({SIDES.format(a, b, c)}) * sign({SIDES.format(a, b, d)}) <= 0 and sign({SIDES.format(c, d, a)}) * sign({SIDES.format(c, d, b)}) <= 0"


@query("pred19_geometry_validity", f"""select pid, not (pid % 5 = 0 or ({APART("p", "q", "r", "s")}) or ({APART("q", "r", "s", "p")})) as valid from {FOUR} q""")
def _(v):
    q = v._spark.sql(f"select * from {FOUR}", corners=v.corners)
    ring = lambda c: F.when(F.col("pid") % 5 == 0, F.array(*(F.col(x + c) for x in "pqrs"))).otherwise(F.array(*(F.col(x + c) for x in "pqrsp")))
    rings = q.select("pid", F.lit(0).alias("part"), F.lit(0).alias("ring"), ring("x").alias("xs"), ring("y").alias("ys"))
    return q.select("pid").join(T.invalid_polygons(rings).select("pid", F.lit(False).alias("valid")).distinct(), "pid", "left").select("pid", F.coalesce("valid", F.lit(True)).alias("valid"))


@query("pred19_holes", "select pid, case pid % 5 when 0 then 'loose' when 1 then 'nested' when 2 then 'cross' end as fault from {areas}")
def _(v):
    # a hole that is outside, in another hole, over the outer ring's edge, touching the outer ring in a point, or inside
    box = lambda ring, x, y, w, h: F.struct(F.lit(ring).alias("ring"), *(F.expr(e).alias(c) for c, e in (("minx", f"minx + {x}"), ("miny", f"miny + {y}"), ("maxx", f"minx + {x} + {w}"), ("maxy", f"miny + {y} + {h}"))))
    kind = F.col("pid") % 5
    second = F.when(kind == 0, box(1, 9.0, 1.0, 1.0, 1.0)).when(kind == 1, box(1, 2.5, 2.5, 1.0, 1.0)).when(kind == 2, box(1, 7.5, 3.0, 1.0, 1.0)).when(kind == 3, box(1, 5.0, 5.0, 1.0, 1.0)).otherwise(box(1, 4.0, 5.0, 1.0, 1.0))
    holes = v.areas.select("pid", F.explode(F.array(box(0, 0.0, 0.0, 8.0, 7.0), second, box(2, 2.0, 2.0, 2.0, 2.0))).alias("b")).select("pid", "b.*")
    rings = S.boxes_to_rings(holes)
    # the hole of the fourth kind is a triangle with one corner on the outer ring
    tip = (F.col("ring") == 1) & (F.col("pid") % 5 == 3)
    rings = rings.withColumns({"xs": F.when(tip, F.transform("xs", lambda x, i: x)).otherwise(F.col("xs")), "ys": F.when(tip, F.transform("ys", lambda y, i: F.when((i == 1), y + 1.0).otherwise(y))).otherwise(F.col("ys"))})
    return v.areas.select("pid").join(T.invalid_polygons(rings), "pid", "left").select("pid", "fault")


@query("pred19_licence_level", "select id from {layers} where id % 5 in (1, 3)")
def _(v):
    level = F.when(F.col("id") % 5 != 4, F.col("id") % 5)
    return C.download_allowed(v.layers.withColumn("licence_level", level), [1, 3]).select("id")


@query("join17_grid_overlay", f"select cast(floor(a.value / 16) as int) as v1, cast(floor(b.value / 16) as int) as v2, count(*) as cells, round(sum({sq_cell('0.25', 'a.lat')}), 3) as km2 from {{cells_el1}} a join {{cells_el2}} b on a.row = b.row and a.col = b.col group by 1, 2")
def _(v):
    from tesserax.operators.rasters import overlay_grids

    band = lambda d: d.withColumn("value", F.floor(F.col("value") / 16).cast("int"))
    return overlay_grids(band(v.cells_el1), band(v.cells_el2), 0.25).withColumn("km2", F.round("km2", 3))


@query("join18_grid_polygon_overlay", f"select c.value, a.pid, round(sum({sq_cell('0.25', 'c.lat')}), 3) as km2 from {{cells_cl3}} c join {{areas}} a on c.lon between a.minx and a.maxx and c.lat between a.miny and a.maxy group by 1, 2")
def _(v):
    cells = S.every_polygon(v.cells_cl3.withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")}), S.boxes_to_rings(v.areas))
    return cells.groupBy("value", "pid").agg(F.round(F.sum(geo.cell_area(0.25, "lat")), 3).alias("km2"))


@query("join19_field_object_count", "select f.fid, count(o.pid) as n from (select distinct concat('cl', cast(p_size % 7 as varchar)) as fid from {part}) f left join {objects} o on o.fid = f.fid group by 1")
def _(v):
    fields = v.part.select(F.concat(F.lit("cl"), (F.col("p_size") % 7).cast("string")).alias("fid")).distinct()
    return fields.join(v.objects, "fid", "left").groupBy("fid").agg(F.count("pid").alias("n"))


@query("join20_backfill_pid", "select c_custkey, coalesce(case when c_custkey % 3 = 0 then cast(c_custkey as varchar) end, cast(a.pid as varchar), 'g' || md5('box ' || cast(c_nationkey + c_custkey % 9 as varchar))) as pid from {customer} left join (select 'box ' || cast(n_nationkey as varchar) as geom, n_nationkey as pid from {nation}) a on a.geom = 'box ' || cast(c_nationkey + c_custkey % 9 as varchar)")
def _(v):
    rows = v.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("pid"), F.concat(F.lit("box "), (F.col("c_nationkey") + F.col("c_custkey") % 9).cast("string")).alias("geom"))
    objects = v.nation.select(F.concat(F.lit("box "), F.col("n_nationkey").cast("string")).alias("geom"), F.col("n_nationkey").alias("pid"))
    return C.backfill_pid(rows, objects).select("c_custkey", "pid")


@query("join21_rematch_taxa", "select p_partkey, case when p_size % 6 = 0 then null when p_partkey % 2 = 0 then p_brand else coalesce(p_type, p_brand) end as family from (select p.p_partkey, p.p_brand, p.p_type, p.p_size from {part} p)")
def _(v):
    taxa = v.part.select("p_partkey", F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("family"), F.lit(None).cast("string").alias("lsid"))
    names = v.part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("family"), F.col("p_brand").alias("lsid"), F.when(F.col("p_size") % 6 == 0, "excluded").alias("issue"))
    return C.rematch(taxa, names).select("p_partkey", "family")


@query("join22_catalogue_diff", "select coalesce(a.k, b.k) as k, case when b.k is null then 'local' when a.k is null then 'remote' else 'both' end as status from (select distinct o_custkey as k from {orders} where o_orderkey % 3 = 0) a full join (select c_custkey as k from {customer} where c_custkey % 2 = 0) b on a.k = b.k")
def _(v):
    return C.catalogue_diff(v.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k")), v.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k")


@query("join23_tabulation_import", "select a.pid as pid1, b.pid as pid2, t.o_totalprice as area from {orders} t join {areas} a on a.name = 'NATION_' || cast(t.o_orderkey % 40 as varchar) join {areas2} b on b.name = 'bNATION_' || cast(t.o_custkey % 30 as varchar)")
def _(v):
    t = v.orders.select(F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 40).cast("string")).alias("name1"), F.concat(F.lit("bNATION_"), (F.col("o_custkey") % 30).cast("string")).alias("name2"), F.col("o_totalprice").alias("area"))
    local = lambda d, k: d.select(F.col("name").alias(f"name{k}"), F.col("pid").alias(f"pid{k}"))
    return t.join(local(v.areas, 1), "name1").join(local(v.areas2, 2), "name2").select("pid1", "pid2", "area")


@query("join24_series_lookup", "select rec_order, rec_line, o_orderpriority as series from {occurrences} left join {orders} on o_orderkey = rec_order and o_orderkey % 4 <> 0")
def _(v):
    ids = v.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("rec_order"), F.col("o_orderpriority").alias("series"))
    return v.occurrences.join(ids, "rec_order", "left").select("rec_order", "rec_line", "series")


LD = "select p_partkey as id, p_size as grp, case p_partkey % 4 when 0 then 'Terrestrial' when 1 then 'Marine' when 2 then 'Terrestrial,Marine' end as domain, p_partkey % 3 <> 2 as intersects from {part}"


@query("join26_missing_pairs", f"with f as ({LD}) select a.id as id1, b.id as id2 from f a join f b on a.grp = b.grp and a.id < b.id and a.intersects and b.intersects where (a.domain is null or b.domain is null or list_has_any(string_split(lower(a.domain), ','), string_split(lower(b.domain), ','))) and not exists (select 1 from {{lineitem}} where (l_partkey = a.id and l_suppkey = b.id) or (l_partkey = b.id and l_suppkey = a.id))")
def _(v):
    fields = v.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("grp"), F.expr("case p_partkey % 4 when 0 then 'Terrestrial' when 1 then 'Marine' when 2 then 'Terrestrial,Marine' end").alias("domain"), (F.col("p_partkey") % 3 != 2).alias("intersects"))
    return C.missing_pairs(fields, v.lineitem.select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")))


@query("join27_species_list_attribute", "select p.p_partkey, regexp_replace(s.c_mktsegment || ' x', '[a-z]', '', 'g') as status from {part} p left join {customer} s on lower('KEY' || cast(p.p_partkey as varchar)) = lower('key' || cast(s.c_custkey as varchar))")
def _(v):
    left = v.part.select("p_partkey", F.concat(F.lit("KEY"), F.col("p_partkey").cast("string")).alias("lsid"))
    right = v.customer.select(F.lower(F.concat(F.lit("key"), F.col("c_custkey").cast("string"))).alias("k"), F.regexp_replace(F.concat("c_mktsegment", F.lit(" x")), "[a-z]", "").alias("status"))
    return left.join(right, F.lower("lsid") == F.col("k"), "left").select("p_partkey", "status")


@query("join30_match_category", """with n as (select distinct case when s_suppkey % 3 = 0 then upper(n_name) || ' !' else n_name end as name from {supplier} join {nation} on n_nationkey = s_nationkey), e as (select n.name, min(a.pid) as pid, 'exact' as how from n join {areas} a on a.name = n.name group by 1)
    select * from e union all select n.name, min(a.pid), 'plain' from n join {areas} a on regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n.name), '[^a-z0-9]', '', 'g') where n.name not in (select name from e) group by 1""")
def _(v):
    names = v.supplier.join(v.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.upper("n_name"), F.lit(" !"))).otherwise(F.col("n_name")).alias("name")).distinct()
    return C.match_names(names, v.areas)


@query("agg31_layer_distance_matrix", f"""with l as (select 'el1' as n, row, col, v from {SCALED_OR_0.format('cells_el1')} union all select 'el2', row, col, v from {SCALED_OR_0.format('cells_el2')} union all select 'cl3', row, col, v from {SCALED_OR_0.format('cells_cl3')}),
    f as (select l.*, 112 + (2 * col + 1) / 8::double as lon, -10 - (2 * row + 1) / 8::double as lat from l),
    d as (select a.n as n1, b.n as n2, avg(abs(a.v - b.v)) as d from l a join l b on a.row = b.row and a.col = b.col and a.n > b.n group by 1, 2
      union all select greatest(a.n, 'coarse'), least(a.n, 'coarse'), avg(abs(a.v - b.v)) from f a join {SCALED_OR_0.format('cells_coarse')} b on {IN_COARSE} group by a.n)
    select n1 as name, round(max(case when n2 = 'cl3' then d end), 6) as cl3, round(max(case when n2 = 'coarse' then d end), 6) as coarse, round(max(case when n2 = 'el1' then d end), 6) as el1 from d group by 1""")
def _(v):
    layers = {"el1": (v.cells_el1, FINE), "el2": (v.cells_el2, FINE), "cl3": (v.cells_cl3, FINE), "coarse": (v.cells_coarse, COARSE)}
    pairs = [(a, b) for a in layers for b in layers if a > b]
    each = [A.layer_distance(layers[a][0], layers[b][0], layers[a][1], layers[b][1]).select(F.lit(a).alias("name"), F.lit(b).alias("n2"), "distance") for a, b in pairs]
    return reduce(DataFrame.unionByName, each).groupBy("name").pivot("n2", ["cl3", "coarse", "el1"]).agg(F.round(F.max("distance"), 6))


@query("agg33_layer_usage", """with u as (select cast(json_extract_string(data, '$.k') as bigint) as id, category1 as kind from {log} where created >= timestamp '2024-01-08'
      union all select cast(unnest(json_extract(inputs, '$.layers[*]')) as bigint), kind from {task_inputs}),
    f as (select 'field' as level, id, kind, count(*) as n from u group by 2, 3 union all select 'layer', p_partkey % 20, kind, count(*) from u join {part} on p_partkey = id group by 2, 3)
    select level, id, kind, n from f union all select level, id, 'Total', cast(sum(n) as bigint) from f group by 1, 2""")
def _(v):
    recent = v.log.filter("created >= timestamp_ntz '2024-01-08'").select(F.get_json_object("data", "$.k").cast("long").alias("id"), F.col("category1").alias("kind"))
    fields = v.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("layer"))
    return C.layer_usage(recent, v.task_inputs, fields)


@query("agg35_environment_block", f"select least(cast(floor((a.value - x.lo) / ((x.hi - x.lo) / 20)) as int), 19) as bx, least(cast(floor((b.value - y.lo) / ((y.hi - y.lo) / 20)) as int), 19) as b_y, round(sum({sq_cell('0.25', 'a.lat')}), 3) as km2 from {{cells_el1}} a join {{cells_el2}} b on a.row = b.row and a.col = b.col, (select min(value) as lo, max(value) as hi from {{cells_el1}}) x, (select min(value) as lo, max(value) as hi from {{cells_el2}}) y group by 1, 2")
def _(v):
    x = A.binned(v.cells_el1, "value", 20).select("row", "col", "lat", F.col("bin").alias("bx"))
    y = A.binned(v.cells_el2, "value", 20).select("row", "col", F.col("bin").alias("b_y"))
    return x.join(y, ["row", "col"]).groupBy("bx", "b_y").agg(F.round(F.sum(geo.cell_area(0.25, "lat")), 3).alias("km2"))


@query("agg36_distribution_families", "select family, count(*) as n from {distributions} where type = 'e' group by 1")
def _(v):
    return v.distributions.filter("type = 'e'").groupBy("family").agg(F.count("*").alias("n"))


@query("agg36_distribution_families_near", "select family, count(*) as n from {distributions} where type = 'e' and spcode in (select pid from {near_point} where d <= 6 or inside) group by 1")
def _(v):
    near = S.shapes(S.triangles_to_rings(v.corners)).filter(S.shape_distance(F.lit(130.0), F.lit(-30.0), "shape") <= 6)
    return v.distributions.filter("type = 'e'").join(near, F.col("spcode") == F.col("pid"), "left_semi").groupBy("family").agg(F.count("*").alias("n"))


@query("agg37_distribution_rollup", "select lsid, max(case when area_name like '%likely%' then area_km end) as likely, max(case when area_name like '%maybe%' then area_km end) as maybe from {distributions} group by 1")
def _(v):
    of = lambda w: F.max(F.when(F.col("area_name").contains(w), F.col("area_km"))).alias(w)
    return v.distributions.groupBy("lsid").agg(of("likely"), of("maybe"))


@query("agg38_checklist_summary", "select wmsurl, count(*) as species, max_by(area_name, spcode) as area_name from {distributions} where type = 'c' group by 1")
def _(v):
    return v.distributions.filter("type = 'c'").groupBy("wmsurl").agg(F.count("*").alias("species"), F.max_by("area_name", "spcode").alias("area_name"))


@query("agg39_log_counts", "select category2, cast(year(created) as int) as year, cast(month(created) as int) as month, count(*) as records, count(*) filter (category1 = 'Tool') as tools, count(*) filter (category1 = 'Area') as areas, count(distinct session_id) as sessions, count(distinct user_id) as users from {log} group by 1, 2, 3")
def _(v):
    return C.log_counts(v.log, ["category2"])


@query("agg40_log_group_count", "select count(distinct (category1, category2)) as n from {log}")
def _(v):
    return v.log.agg(F.countDistinct("category1", "category2").alias("n"))


PAIRS = [f"{a}_{b}" for a in ("Area", "Tool") for b in ("click", "error", "purchase", "signup", "view")]
PAIR_COUNTS = ", ".join(f"count(*) filter (concat(category1, '_', category2) = '{p}') as {p}" for p in PAIRS)


@query("agg41_user_activity", f"select user_id, {PAIR_COUNTS}, count(*) as total, row_number() over (order by count(*) desc, user_id) as place from {{log}} group by 1")
def _(v):
    return C.user_activity(v.log)


@query("agg42_monthly_tasks", "select category1, category2, cast(year(created) as int) as year, cast(month(created) as int) as month, count(*) as n from {log} where user_id <> 3 group by 1, 2, 3, 4")
def _(v):
    return v.log.filter("user_id <> 3").groupBy("category1", "category2", F.year("created").alias("year"), F.month("created").alias("month")).agg(F.count("*").alias("n"))


TRIANGLE = "concat('((', ax, ' ', ay, ',', bx, ' ', b_y, ',', cx, ' ', cy, ',', ax, ' ', ay, '))')"


@query("agg43_aggregate_shapes", f"""select concat('n', cast(pid % 7 as varchar)) as name, concat('n', cast(pid % 7 as varchar), ', group ', cast(pid % 7 % 3 as varchar)) as description, count(*) as parts, round(sum({sq_excess('ax', 'ay', 'bx', 'b_y', 'cx', 'cy')}) * 6378137.0 * 6378137.0 / 1e6, 2) as km2,
    min(ax) as minx, min(ay) as miny, max(cx) as maxx, max(b_y) as maxy, 'MULTIPOLYGON(' || string_agg({TRIANGLE}, ',' order by pid) || ')' as wkt from {{halves}} group by 1, 2""")
def _(v):
    named = v.halves.select("pid", F.concat(F.lit("n"), (F.col("pid") % 7).cast("string")).alias("name"), (F.col("pid") % 7 % 3).alias("grp"))
    rings = S.triangles_to_rings(v.halves).join(named, "pid").withColumn("group", F.concat(F.lit("group "), F.col("grp").cast("string")))
    out = C.aggregate_shapes(rings, "name", ["name", "group"])
    return out.select("name", "description", "parts", F.round("km2", 2).alias("km2"), "minx", "miny", "maxx", "maxy", "wkt")


MERGE_IN = "((h.cx - h.ax) * (h.b_y - h.ay) / 2 * (" + " ".join(s + "pow(greatest(0, 1 - greatest(b.{x} - h.ax, 0) / (h.cx - h.ax) - greatest(b.{y} - h.ay, 0) / (h.b_y - h.ay)), 2)".format(x=x, y=y) for s, x, y in (("", "minx", "miny"), ("- ", "maxx", "miny"), ("- ", "minx", "maxy"), ("+ ", "maxx", "maxy"))) + "))"


@query("agg44_merge_areas", f"""with m as (select h.pid, {MERGE_IN} as i, (h.cx - h.ax) * (h.b_y - h.ay) / 2 + greatest(b.maxx - b.minx, 0) * greatest(b.maxy - b.miny, 0) as t from {{halves}} h join {{areas2}} b on b.pid = h.pid + 100 where b.maxx > b.minx and b.maxy > b.miny)
    select 'union' as kind, pid, round(t - i, 6) as area from m union all select 'intersection', pid, round(i, 6) from m where i > 1e-9""")
def _(v):
    b = v.areas2.filter("maxx > minx and maxy > miny").withColumn("pid", F.col("pid") - 100)
    a = S.triangles_to_rings(v.halves.join(b.select("pid"), "pid", "left_semi"))
    of = lambda how: merged(a, S.boxes_to_rings(b), how).groupBy("pid").agg(F.round(F.sum(planar_area("xs", "ys")), 6).alias("area")).filter("area > 0").select(F.lit(how).alias("kind"), "pid", "area")
    return of("union").unionByName(of("intersection"))


BOX_SIDES = ", ".join(f"(e.x2 - e.x1) * (a.{y} - e.y1) - (e.y2 - e.y1) * (a.{x} - e.x1)" for x in ("minx", "maxx") for y in ("miny", "maxy"))
MEETS_BOX = f"(least(e.x1, e.x2) <= a.maxx and greatest(e.x1, e.x2) >= a.minx and least(e.y1, e.y2) <= a.maxy and greatest(e.y1, e.y2) >= a.miny and least({BOX_SIDES}) <= 0 and greatest({BOX_SIDES}) >= 0)"
ODD_CORNER = "(sum(case when (e.x1 > a.minx) <> (e.x2 > a.minx) and a.miny < e.y1 + (a.minx - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1) then 1 else 0 end) % 2 = 1)"


@query("agg46_area_report", f"""with a as (select * from {{areas}} where pid = 12), t as (select e.pid from {{tri_edges}} e, a group by e.pid, a.minx, a.miny having bool_or({MEETS_BOX}) or {ODD_CORNER}),
    d as (select * from {{distributions}} where spcode in (select pid from t)), taxa as (select *, {TAXON} as taxon from {{hits}})
    select 'records' as item, count(*) as n from {{hits}} where pid = 12 union all select 'species', count(distinct species) from {{hits}} where pid = 12
    union all select 'endemic', count(distinct taxon) from taxa where pid = 12 and taxon not in (select taxon from taxa where pid <> 12)
    union all select 'checklists', count(distinct wmsurl) from d where type = 'c' union all select 'expert distributions', count(*) from d where type = 'e'
    union all select 'articles', count(distinct id) from {{article_points}}, a where not missing and lon between minx and maxx and lat between miny and maxy
    union all select 'tabulation', count(*) from {{overlay}} where pid1 = 12""")
def _(v):
    area = v.areas.filter("pid = 12")
    found = S.every_polygon(v.occurrences.withColumn("taxon", F.concat_ws("_", "species", "year", F.col("rec_order") % 20)), S.boxes_to_rings(v.areas))
    met = T.objects_intersecting(S.triangles_to_rings(v.corners), S.boxes_to_rings(area)).select(F.col("pid1").alias("spcode"))
    articles = S.every_polygon(v.article_points.filter("not missing"), S.boxes_to_rings(area))
    return C.area_report(materialise(found, "records"), 12, v.distributions.join(met, "spcode", "left_semi"), articles, S.boxes_overlap(area, v.areas2))


@query("agg47_name_index", "select lower(name) as name_lower, row_number() over (order by lower(name)) as name_id from (select distinct lower(name) as name from {objects} where namesearch)")
def _(v):
    return C.name_index(v.objects)


@query("agg48_fill_missing_area", "select d.spcode, coalesce(d.area_km, round(x.a, 3)) as area_km from {distributions} d join (select pid, round(" + sq_excess("ax", "ay", "bx", "b_y", "cx", "cy") + " * 6378137.0 * 6378137.0 / 1e6, 3) as a from {corners}) x on x.pid = d.spcode")
def _(v):
    rings = S.triangles_to_rings(v.corners).withColumn("a", F.round(F.abs(geo.ring_area("xs", "ys")) / 1e6, 3))
    return v.distributions.join(rings, F.col("spcode") == F.col("pid")).select("spcode", F.coalesce("area_km", "a").alias("area_km"))


@query("srt1_search_ranking", "select pid, name, strpos(lower(name), 'in') as at from {objects} where name ilike '%in%' and fid in ('cl1', 'cl2') order by 3, 2, 1 limit 40 offset 5")
def _(v):
    return C.search_ranked(v.objects, "in", 40, 5, ["cl1", "cl2"]).select("pid", "name", "at")


@query("srt2_name_index_search", "select o.pid, o.name from {objects} o where namesearch and name ilike '%ll%' order by strpos(lower(name), 'll'), lower(name), pid limit 30")
def _(v):
    names = v.objects.filter("namesearch").select(F.lower("name").alias("low")).distinct().filter(F.col("low").contains("ll"))
    found = v.objects.filter("namesearch").join(names, F.lower("name") == F.col("low"))
    return found.orderBy(F.locate("ll", F.col("low")), "low", "pid").limit(30).select("pid", "name")


@query("srt3_spatial_sort", "select row, col, count(*) as n, true as in_order from (select cast(trunc((lat + 45) / 0.5) as int) as row, cast(trunc((lon - 112) / 0.5) as int) as col from {occurrences}) group by 1, 2")
def _(v):
    g = A.gridded(v.occurrences, 112.0, -45.0, 0.5).repartitionByRange("row", "col").sortWithinPartitions("row", "col")
    return in_order(g, "row", "col").groupBy("row", "col").agg(F.count("*").alias("n"), F.bool_and("in_order").alias("in_order"))


@query("srt4_categories_by_count", "select species, n, cast(row_number() over (order by n desc, species) as int) as rank from (select species, count(*) as n from {occurrences} group by 1)")
def _(v):
    from tesserax.operators.legends import category_legend

    return category_legend(v.occurrences, "species").select(F.col("value").alias("species"), "n", "rank")


@query("set4_search_with_classes", "select name, src from (select * from (select name, 'object' as src, 0 as k, pid from {objects} where name ilike '%ring%' order by strpos(lower(name), 'ring'), name, pid limit 400) union all select distinct 'ring ' || name, 'class', 1, value from {cells_cl3}) order by k, pid limit 400")
def _(v):
    objects = C.search_ranked(v.objects, "ring", 400).select("name", F.lit("object").alias("src"), F.lit(0).alias("k"), F.col("pid").cast("long").alias("pid"))
    classes = v.cells_cl3.select(F.concat(F.lit("ring "), "name").alias("name"), F.lit("class").alias("src"), F.lit(1).alias("k"), F.col("value").cast("long").alias("pid")).distinct()
    return objects.unionByName(classes).orderBy("k", "pid").limit(400).select("name", "src")


@query("set5_distinct_lsids", "select distinct lsid from {distributions} where type = 'e'")
def _(v):
    return v.distributions.filter("type = 'e'").select("lsid").distinct()


@query("fn18_text_cleaning", "select pid, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as plain, regexp_replace(descr, '[^A-Za-z0-9_.-]', '_', 'g') as filename, case when descr like '%,%' or descr like '%\"%' then '\"' || replace(descr, '\"', '\"\"') || '\"' else descr end as csv from {objects}")
def _(v):
    wrap = F.when(F.col("descr").rlike('[,"]'), F.concat(F.lit('"'), F.replace("descr", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("descr"))
    return v.objects.select("pid", C.plain("name").alias("plain"), F.regexp_replace("descr", "[^A-Za-z0-9_.-]", "_").alias("filename"), wrap.alias("csv"))


@query("fn19_type_inference", "select 'id' as col_, case when count(*) = count(try_cast(id as int)) then 'INT' when count(*) = count(try_cast(id as double)) then 'DOUBLE' else 'STRING' end as type from (select cast(c_custkey as varchar) as id from {customer}) union all select 'bal', case when count(*) = count(try_cast(id as double)) then 'DOUBLE' else 'STRING' end from (select cast(c_acctbal as varchar) as id from {customer}) union all select 'name', case when count(*) = count(try_cast(id as double)) then 'DOUBLE' else 'STRING' end from (select c_name as id from {customer})")
def _(v):
    text = v.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("string").alias("bal"), F.col("c_name").alias("name"))
    out = C.infer_type(text, "id").unionByName(C.infer_type(text, "bal")).unionByName(C.infer_type(text, "name"))
    return out.withColumnRenamed("column", "col_")


@query("fn23_json_member", "select event_id, json_extract_string(data, '$.k') as k from {log}")
def _(v):
    return v.log.select("event_id", F.get_json_object("data", "$.k").alias("k"))


@query("fn24_year_month", "select event_id, cast(year(created) as int) as y, cast(month(created) as int) as m, created >= timestamp '2024-01-05' and created <= timestamp '2024-01-15' as inside from {log}")
def _(v):
    return v.log.select("event_id", F.year("created").alias("y"), F.month("created").alias("m"), F.expr("created between timestamp_ntz '2024-01-05' and timestamp_ntz '2024-01-15'").alias("inside"))


@query("fn25_domain_list", "select id, len(string_split(domain, ',')) as n from {layers} where domain is not null")
def _(v):
    return v.layers.filter("domain is not null").select("id", F.size(F.transform(F.split("domain", ","), lambda x: F.trim(x))).cast("long").alias("n"))
