"""Queries: sources and sinks. Files are written from the tables to the shared folder and read by the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import aggregates as A
from tesserax.operators import spatial as S
from tesserax.plans.views import Registry
from tesserax.sources import exports as E
from tesserax.sources import grid_source as B
from tesserax.sources import grids as G
from tesserax.sources import polygon_source as P
from tesserax.sources import records as R
from tesserax.sources.headers import header_text
from tesserax.sources.scratch import materialise, shared_path

query = Registry()


def _csv(v):
    path = shared_path(v._spark, "occ.csv")
    bad = F.col("rec_order") % 100 == 7
    own = v.occurrences.select(F.col("species").alias("names_and_lsid"), F.when(bad, F.lit("x")).otherwise(F.col("lon").cast("string")).alias("longitude"), F.col("lat").alias("latitude"), F.when(F.col("rec_line") == 3, F.lit("?")).otherwise(F.col("year").cast("string")).alias("year"))
    own.write.csv(path, header=True)
    return path


@query("src1_occurrence_csv", "select species, case when rec_line = 3 then 0 else year end as year, count(*) as n from {occurrences} where rec_order % 100 <> 7 and lon between 115 and 145 and lat between -40 and -15 group by 1, 2")
def _(v):
    occ = R.read_occurrences(v._spark, _csv(v), bbox=(115, -40, 145, -15))
    return occ.groupBy("species", F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))


@query("src2_occurrence_file_region", "select species, count(*) as n from {occurrences} where rec_order % 100 <> 7 and lon between 120 and 128 and lat between -31 and -24 group by 1")
def _(v):
    xs, ys = F.array(*map(F.lit, (120.0, 120.0, 128.0, 128.0, 120.0))), F.array(*map(F.lit, (-31.0, -24.0, -24.0, -31.0, -31.0)))
    return R.read_occurrences(v._spark, _csv(v), keep=geo.in_ring("lon", "lat", xs, ys), include_year=False).groupBy("species").agg(F.count("*").alias("n"))


@query("src3_world_extract", "select cast(floor(lon) as int) as slice, count(*) as n, true as in_order from {occurrences} group by 1")
def _(v):
    own = R.in_order(R.by_longitude(v.occurrences, 40), "lon")
    return own.groupBy(F.floor("lon").cast("int").alias("slice")).agg(F.count("*").alias("n"), F.bool_and("in_order").alias("in_order"))


@query("src4_download_normaliser", "select replace(p_name || '|' || p_brand, ',', ' ') as species, count(*) as n from {part} where p_partkey % 10 <> 0 group by 1")
def _(v):
    path = shared_path(v._spark, "down.tsv")
    own = v.part.select(F.col("p_brand").alias("lsid"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 != 0, F.lit("-25.5")).otherwise(F.lit(" ")).alias("latitude"), F.lit("133.1").alias("longitude"))
    own.write.csv(path, sep="\t", quote="|", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_downloads(v._spark, path).groupBy("species").agg(F.count("*").alias("n"))


@query("src5_species_dictionary", "select species, cast(dense_rank() over (order by species) - 1 as bigint) as species_id from (select distinct species from {occurrences})")
def _(v):
    return R.species_dictionary(v.occurrences)[0]


@query("src5_unique_points", """select rec_order, rec_line, cast(dense_rank() over (order by species) - 1 as bigint) as species_id, cast(dense_rank() over (order by lon, lat) - 1 as bigint) as point_id from {occurrences}""")
def _(v):
    return R.with_references(v.occurrences).select("rec_order", "rec_line", "species_id", "point_id")


@query("src6_binary_grid", "select row, col, value from {cells_el1}")
def _(v):
    path = shared_path(v._spark, "grids")
    B.write_grids(v.cells_el1.withColumn("layer", F.lit("el1")), path, {"el1": (112.0, -10.0, 0.25, 140, 160)}, part=640 * 30)
    return B.read_grids(v._spark, path, split=640 * 9).select("row", "col", "value")


@query("src6_grid_window", """select 'el2' as layer, row, col, lon, lat, value from {cells_el2} where lon between 120 and 131.5 and lat between -31 and -17.125 union all
    select 'el1', row, col, lon, lat, value from {cells_el1} where lon between 120 and 131.5 and lat between -31 and -17.125""")
def _(v):
    path = shared_path(v._spark, "grids")
    both = v.cells_el1.withColumn("layer", F.lit("el1")).unionByName(v.cells_el2.withColumn("layer", F.lit("el2")))
    both = both.unionByName(v.cells_el1.withColumn("layer", F.lit("other")))
    B.write_grids(both, path, {k: (112.0, -10.0, 0.25, 140, 160) for k in ("el1", "el2", "other")}, part=640 * 50)
    return B.read_grids(v._spark, path, split=640 * 16, layers=("el1", "el2"), lon=(120.0, 131.5), lat=(-31.0, -17.125))


def _binary(spark, path: str, chunks) -> None:
    """One small file through Hadoop's file system, wherever the shared folder is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    for c in chunks:
        out.write(bytearray(c))
    out.close()


def _tiles(v):
    """Two overlapping tiles of the view's grids, written and read as a directory."""
    path = shared_path(v._spark, "tiles")
    west = v.cells_el1.filter("col < 100").select(F.lit("a").alias("layer"), "row", "col", "value")
    east = v.cells_el2.filter("col >= 60").select(F.lit("b").alias("layer"), "row", (F.col("col") - 60).alias("col"), "value")
    sizes = {"a": (112.0, -10.0, 0.25, 140, 100), "b": (127.0, -10.0, 0.25, 140, 100)}
    B.write_grids(west.unionByName(east), path, sizes)
    return G.read_tiles(v._spark, path)


TILES = "(select row, col, coalesce(max(case when t = 0 then value end), max(case when t = 1 then value end)) as value from (select row, col, value, 0 as t from {cells_el1} where col < 100 union all select row, col, value, 1 from {cells_el2} where col >= 60) group by 1, 2)"


@query("src7_grid_collection", f"select row, col, value from {TILES}")
def _(v):
    return _tiles(v)[0].select("row", "col", "value")


@query("src7_collection_extent", f"select 112.0::double as minx, -45.0::double as miny, 152.0::double as maxx, -10.0::double as maxy, 0.25::double as res, 140 as rows_, 160 as cols_, min(value) as lo, max(value) as hi from {TILES}")
def _(v):
    return _tiles(v)[1].select("minx", "miny", "maxx", "maxy", "res", F.col("rows").alias("rows_"), F.col("cols").alias("cols_"), "lo", "hi")


@query("src8_decimated_grid", "select row, col, value from {cells_el1} where row % 4 = 0 and col % 4 = 0")
def _(v):
    return G.decimated(v.cells_el1, 4).select("row", "col", "value")


@query("src8_sampled_collection", f"select r as row, c as col, value from (select unnest(range(0, 50)) as r), (select unnest(range(0, 60)) as c) join {TILES} t on t.row = floor((r + 0.5) / 50 * 140) and t.col = floor((c + 0.5) / 60 * 160)")
def _(v):
    return G.sampled(*_tiles(v), 50, 60)


@query("src9_wide_grid_cache", "select coalesce(a.row, b.row) as row, coalesce(a.col, b.col) as col, a.value as el1, b.value as el2 from {cells_el1} a full join {cells_el2} b on a.row = b.row and a.col = b.col")
def _(v):
    from tesserax.operators.rasters import stack

    path = shared_path(v._spark, "wide")
    stack({"el1": v.cells_el1, "el2": v.cells_el2}).write.parquet(path)
    return v._spark.read.parquet(path)


#: Features of two parts (one for each third pid), the second with two holes, and null shapes for each seventh pid.
PARTS = """select pid, part, ring, minx + dx * (maxx - minx) as minx, miny + dy * (maxy - miny) as miny, minx + (dx + w) * (maxx - minx) as maxx, miny + (dy + w) * (maxy - miny) as maxy
    from {areas} join (values (0, 0, 0.0, 0.0, 0.25), (1, 0, 0.5, 0.5, 0.5), (1, 1, 0.625, 0.625, 0.125), (1, 2, 0.8125, 0.625, 0.125)) as t(part, ring, dx, dy, w) on part = 0 or pid % 3 = 0 where pid % 7 <> 0"""


@query("src10_polygon_files", "select pid, ax as x0, cx as x2, 'class ' || (pid % 13)::varchar as label, (select count(distinct 'class ' || (d.pid % 13)::varchar) from {corners} d where 'class ' || (d.pid % 13)::varchar < 'class ' || (c.pid % 13)::varchar)::int as code from {corners} c")
def _(v):
    path = shared_path(v._spark, "shapes")
    at = lambda *names: F.array(*(F.col(n).cast("double") for n in names))
    rings = v.corners.select("pid", F.lit(0).alias("part"), F.lit(0).alias("ring"), at("ax", "cx", "bx", "ax").alias("xs"), at("ay", "cy", "b_y", "ay").alias("ys"), F.concat(F.lit("class "), (F.col("pid") % 13).cast("string")).alias("label"), F.col("pid").cast("string").alias("own"))
    materialise(P.write_polygons(rings, path, 2 + rings.count() // 50_000, [("label", 12), ("own", 12)]))
    own = P.read_polygons(v._spark, path, records=300)
    own = own.select(F.col("attributes")["own"].cast("long").alias("pid"), F.get("xs", F.lit(0)).alias("x0"), F.get("xs", F.lit(1)).alias("x2"), F.col("attributes")["label"].alias("label"))
    return G.coded(own.withColumn("code", F.col("label")), "code")[0]


@query("src10_parts_and_holes", f"""select a.pid::bigint as pid, a.name, p.part, p.ring, round(minx, 9) as minx, round(maxy, 9) as maxy, round((p.maxx - p.minx) * (p.maxy - p.miny), 9) as area
    from (select pid, name from {{areas}}) a left join ({PARTS}) p on a.pid = p.pid""")
def _(v):
    path = shared_path(v._spark, "parts")
    boxes = v._spark.sql(PARTS, areas=v.areas)
    at = lambda *names: F.array(*(F.col(n).cast("double") for n in names))
    rings = v.areas.select("pid", "name").join(boxes, "pid", "left").select(
        "pid", "name", "part", "ring", F.when(F.col("part").isNotNull(), at("minx", "minx", "maxx", "maxx", "minx")).alias("xs"), at("miny", "maxy", "maxy", "miny", "miny").alias("ys"), F.col("pid").cast("string").alias("own")
    )
    materialise(P.write_polygons(rings, path, 3, [("name", 30), ("own", 12)]))
    own = P.read_polygons(v._spark, path, records=4)
    width, height = F.array_max("xs") - F.array_min("xs"), F.array_max("ys") - F.array_min("ys")
    return own.select(
        F.col("attributes")["own"].cast("long").alias("pid"), F.col("attributes")["name"].alias("name"), "part", "ring",
        F.round(F.array_min("xs"), 9).alias("minx"), F.round(F.array_max("ys"), 9).alias("maxy"), F.round(width * height, 9).alias("area"),
    )


@query("src11_wkt_reader", "select pid, ring, minx, maxy, 5 as n from {nested}")
def _(v):
    text = E.as_wkt(S.shapes(S.boxes_to_rings(v.nested)))
    rings = text.select("pid", F.inline(geo.wkt_rings("wkt")))
    return rings.select("pid", "ring", F.array_min("xs").alias("minx"), F.array_max("ys").alias("maxy"), F.size("xs").alias("n"))


@query("src12_collection_splitter", "select pid, case when k = 2 then 'M' else 'P' end as kind, count(*) as n from {areas}, (select unnest([1, 2, 3]) as k) group by 1, 2")
def _(v):
    box = geo.box_wkt("minx", "miny", "maxx", "maxy")
    multi = F.concat(F.lit("MULTIPOLYGON("), F.substring(box, 8, 10_000), F.lit(")"))
    text = F.concat(F.lit("GEOMETRYCOLLECTION("), box, F.lit(", "), multi, F.lit(","), box, F.lit(")"))
    parts = v.areas.select("pid", F.explode(geo.split_collection(text)).alias("w"))
    return parts.groupBy("pid", F.substring("w", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("src13_geojson_reader", """select a.pid, case when a.pid % 4 <> 0 then part end as part, case when a.pid % 4 <> 0 then ring end as ring, case when a.pid % 4 <> 0 then a.minx + 2 * ring + 8 * part end as x, case when a.pid % 4 <> 0 then a.maxy - 1.75 * ring end as y
    from {areas} a, (select unnest([0, 1]) as part), (select unnest([0, 1]) as ring) where a.pid % 4 <> 0 and (part = 0 or a.pid % 2 = 0) or a.pid % 4 = 0 and part + ring = 0""")
def _(v):
    shift = v.nested.select("pid", F.lit(1).alias("part"), "ring", *(((F.col(c) + 8.0) if c.endswith("x") else F.col(c)).alias(c) for c in ("minx", "miny", "maxx", "maxy"))).filter("pid % 2 = 0")
    rings = S.boxes_to_rings(v.nested).unionByName(S.boxes_to_rings(shift, 1))
    text = E.as_geojson(S.shapes(rings)).withColumn("json", F.when(F.col("pid") % 4 == 0, F.lit("{oops")).otherwise(F.col("json")))
    return E.read_geojson(text, "json").select("pid", F.inline_outer("shape")).select("pid", "part", "ring", F.array_min("xs").alias("x"), F.array_max("ys").alias("y"))


def _articles(v):
    point = F.struct(F.when(F.col("loc") % 2 == 0, F.struct("lon", "lat")).alias("coords"), F.when(F.col("loc") % 2 == 1, F.col("lon")).alias("longitude"), F.when(F.col("loc") % 2 == 1, F.col("lat")).alias("latitude"))
    path = shared_path(v._spark, "articles.json")
    own = v.article_points.groupBy("id").agg(F.collect_list(F.when(~F.col("missing"), point)).alias("p"))
    own.select("id", F.when(F.size("p") > 0, F.col("p")).alias("locations")).write.json(path)
    schema = "id long, locations array<struct<coords: struct<lon: double, lat: double>, longitude: double, latitude: double>>"
    return v._spark.read.schema(schema).json(path)


@query("src15_article_scan", "select id, count(*) as n, round(sum(lon), 6) as lon, round(sum(lat), 6) as lat from {article_points} where not missing group by 1")
def _(v):
    return R.article_locations(_articles(v)).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 6).alias("lon"), F.round(F.sum("lat"), 6).alias("lat"))


@query("src16_upload_ingest", "select c_name as \"scientificName\", row_number() over (order by c_custkey) as \"occurrenceID\", 'u1' as \"userId\", 'set' as \"datasetName\" from {customer}")
def _(v):
    raw = v.customer.select("c_custkey", F.col("c_name").alias("Scientific Name"))
    return R.ingest_upload(raw, "c_custkey", "u1", "set").select("scientificName", "occurrenceID", "userId", "datasetName")


@query("src17_track_harvest", "select s_name as name, case when s_suppkey % 5 <> 0 then 'c' end as family, 5000000 + row_number() over (order by s_suppkey) - 1 as spcode, 't' as type, ax as minx, ay as miny, bx as maxx, cy as maxy from {supplier} join {corners} on pid = s_suppkey")
def _(v):
    lines = v.corners.select(F.col("pid").alias("s_suppkey"), F.format_string("LINESTRING(%s %s, %s %s, %s %s)", "ax", "ay", "bx", "b_y", "cx", "cy").alias("wkt"))
    raw = v.supplier.join(lines, "s_suppkey").withColumn("fam", F.when(F.col("s_suppkey") % 5 != 0, F.lit("c")).otherwise(F.lit(" ")))
    return R.harvest_tracks(raw, {"s_name": "name", "fam": "family"}, "s_suppkey", "wkt").select("name", "family", "spcode", "type", "minx", "miny", "maxx", "maxy")


@query("src18_distribution_load", "select k, max_by(v, o) as v from (select c_custkey % 400 as k, c_acctbal as v, c_custkey as o from {customer} where c_custkey % 3 <> 0 union all select s_suppkey * 3, s_acctbal, -1 from {supplier}) group by 1")
def _(v):
    loaded = v.customer.select((F.col("c_custkey") % 400).alias("k"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("o"), F.when(F.col("c_custkey") % 3 != 0, F.lit("POINT")).alias("geom"))
    return R.replace_by_key(v.supplier.select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("v")), loaded, "k", "o", "geom")


@query("src19_article_filter", "select id from {article_points} group by 1 having not bool_and(missing)")
def _(v):
    return _articles(v).filter(F.col("locations").isNotNull()).select("id")


@query("snk1_sample_csv", "select round(lat, 6) as latitude, round(lon, 6) as longitude, pid, fid from {point_objects}")
def _(v):
    path = shared_path(v._spark, "samples.csv")
    E.write_samples(v.point_objects, path, ["pid", "fid"])
    back = v._spark.read.csv(path, header=True, schema="latitude double, longitude double, pid long, fid string")
    return back.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "pid", "fid")


HEAD = "(values (0, 'ncols 160'), (1, 'nrows 140'), (2, 'xllcorner 112.0'), (3, 'yllcorner -45.0'), (4, 'cellsize 0.25'), (5, 'NODATA_value -9999')) as h(at_, line)"


@query("snk2_ascii_grid", f"""select at_::bigint as at_, line from {HEAD} union all select r + 6, string_agg(coalesce(case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end, '-9999'), ' ' order by c)
    from (select unnest(range(0, 140)) as r), (select unnest(range(0, 160)) as c) left join {{cells_el1}} on row = r and col = c group by r""")
def _(v):
    path = shared_path(v._spark, "grid.asc")
    own = G.ascii_grid(v.cells_el1, 140, 160, 112.0, -45.0, 0.25).withColumnRenamed("value", "line")
    E.write_lines(own, path)
    return E.read_lines(v._spark, path).select(F.col("at").alias("at_"), "line")


@query("snk3_grid_header", "select 112.0::double as minx, -10.0::double as maxy, 0.25::double as res, 140 as rows_, 160 as cols_, min(value) as lo, max(value) as hi from {cells_el1}")
def _(v):
    e = v.cells_el1.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    path = shared_path(v._spark, "el1.grd")
    _binary(v._spark, path, [header_text(112.0, -45.0, 152.0, -10.0, 140, 160, e.lo, e.hi).encode()])
    text = v._spark.read.text(path, wholetext=True)
    at = lambda k: F.regexp_extract("value", rf"(?m)^{k}=(.*)$", 1)
    d = lambda k: at(k).cast("double")
    return text.select(d("MinX").alias("minx"), d("MaxY").alias("maxy"), ((d("MaxX") - d("MinX")) / d("Columns")).alias("res"), at("Rows").cast("int").alias("rows_"), at("Columns").cast("int").alias("cols_"), d("MinValue").alias("lo"), d("MaxValue").alias("hi"))


#: Species of the matrix: all.
EVERY = [f"sp{k}" for k in range(97)]


@query("snk4_species_matrix", "select cast(trunc((lat + 45) / 2) as int) as row, cast(trunc((lon - 112) / 2) as int) as col, " + ", ".join(f"count(*) filter (species = '{s}') as {s}" for s in EVERY) + " from {occurrences} group by 1, 2")
def _(v):
    sites = A.sites_by_species(v.occurrences, 112.0, -45.0, 2.0)
    lines = E.species_matrix_lines(A.site_matrix(sites, EVERY), EVERY)
    path = shared_path(v._spark, "matrix.csv")
    E.write_lines(lines, path)
    cells = F.split("line", ",")
    return E.read_lines(v._spark, path).filter("at >= 5").select(*(F.get(cells, F.lit(k)).cast("int" if k < 2 else "long").alias(n) for k, n in enumerate(("row", "col", *EVERY))))


RING = "concat({a}, ' ', {b}, ',', {a}, ' ', {d}, ',', {c}, ' ', {d}, ',', {c}, ' ', {b}, ',', {a}, ' ', {b})"
OUTER, INNER = RING.format(a="minx", b="miny", c="maxx", d="maxy"), RING.format(a="(minx + 2)", b="(miny + 1.75)", c="(maxx - 2)", d="(maxy - 1.75)")
JSON_RING = "concat('[[', replace(replace({r}, ',', '],['), ' ', ','), ']]')"
KML_RING = "concat('<LinearRing><coordinates>', replace(replace(replace({r}, ',', ';'), ' ', ','), ';', ' '), '</coordinates></LinearRing>')"


@query("snk5_geometry_export", f"""select pid, concat('POLYGON((', {OUTER}, '),(', {INNER}, '))') as wkt, concat('{{{{"type":"Polygon","coordinates":[', {JSON_RING.format(r=OUTER)}, ',', {JSON_RING.format(r=INNER)}, ']}}}}') as json,
    concat('<MultiGeometry><Polygon><outerBoundaryIs>', {KML_RING.format(r=OUTER)}, '</outerBoundaryIs><innerBoundaryIs>', {KML_RING.format(r=INNER)}, '</innerBoundaryIs></Polygon></MultiGeometry>') as kml from {{areas}}""")
def _(v):
    shapes = S.shapes(S.boxes_to_rings(v.nested))
    return E.as_wkt(shapes).join(E.as_geojson(shapes), "pid").join(E.as_kml(shapes), "pid").select("pid", "wkt", "json", "kml")


@query("snk5_joined_collection", f"select concat(pid, '~', (pid + 7) % 25, '~99') as ids, concat('GEOMETRYCOLLECTION(', w, ',', o, ')') as wkt from (select pid, concat('POLYGON((', {OUTER}, '))') as w from {{areas}}) join (select pid as other, concat('POLYGON((', {OUTER}, '))') as o from {{areas}}) on other = (pid + 7) % 25")
def _(v):
    wanted = v.areas.select(F.concat_ws("~", F.col("pid").cast("string"), ((F.col("pid") + 7) % 25).cast("string"), F.lit("99")).alias("ids"))
    return E.joined(S.shapes(S.boxes_to_rings(v.areas)), wanted)


@query("snk6_catalogue_csv", """select cast(l.id as varchar) as "ID", name as "Short name", displayname as "Name", type as "Type", keywords as "Keywords", 'line one line two' as "Notes", cast(coalesce(n, 0) as varchar) as "Usage", 21 as columns_
    from {layers} l left join (select cast(json_extract_string(data, '$.k') as bigint) as id, count(*) as n from {log} group by 1) u on u.id = l.id""")
def _(v):
    usage = v.log.groupBy(F.get_json_object("data", "$.k").cast("long").alias("id")).agg(F.count("*").alias("n"))
    path = shared_path(v._spark, "layers.csv")
    E.write_catalogue(v.layers.withColumn("notes", F.lit("line one\nline two")), path, usage)
    back = v._spark.read.csv(path, header=True, escape='"')
    return back.select("ID", "Short name", "Name", "Type", "Keywords", "Notes", "Usage", F.lit(len(back.columns)).alias("columns_"))


TABLE = "(select a.name as name1, b.name as name2, sum((o.maxx - o.minx) * (o.maxy - o.miny)) as area from {overlay} o join {areas} a on a.pid = pid1 join {areas2} b on b.pid = pid2 group by 1, 2)"


@query("snk8_tabulation_csv", f"""with t as {TABLE}, n as (select distinct name2 from t), f as (select distinct name1 from t),
    c as (select f.name1, n.name2, t.area from f cross join n left join t on t.name1 = f.name1 and t.name2 = n.name2),
    h as (select concat(',', string_agg(name2, ',' order by name2), ',Total') as line from n),
    r as (select name1, concat(name1, ',', string_agg(coalesce(printf('%.4f', area), ''), ',' order by name2), ',', printf('%.4f', sum(area))) as line from c group by 1),
    s as (select concat('Total,', string_agg(printf('%.4f', area), ',' order by name2), ',', printf('%.4f', sum(area))) as line from (select name2, sum(area) as area from t group by 1)),
    o as (select 0 as k, '' as name1, line from h union all select 1, name1, line from r union all select 2, '', line from s union all select 3, '', '' union all select 4, '', 'Values are square degrees.' union all select 5, '', 'Blank cells have none.')
    select row_number() over (order by k, name1) - 1 as at_, line from o""")
def _(v):
    path = shared_path(v._spark, "tabulation.csv")
    E.write_lines(E.tabulation_lines(_tabulation(v), "area", "square degrees"), path)
    return E.read_lines(v._spark, path).select(F.col("at").alias("at_"), "line")


@query("snk8_tabulation_json", f"select name1, name2, round(area, 6) as area from {TABLE}")
def _(v):
    path = shared_path(v._spark, "tabulation.json")
    _tabulation(v).write.json(path)
    return v._spark.read.schema("name1 string, name2 string, area double").json(path).select("name1", "name2", F.round("area", 6).alias("area"))


def _tabulation(v):
    cut = S.boxes_overlap(v.areas, v.areas2).withColumn("a", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    named = cut.join(v.areas.select(F.col("pid").alias("pid1"), F.col("name").alias("name1")), "pid1").join(v.areas2.select(F.col("pid").alias("pid2"), F.col("name").alias("name2")), "pid2")
    return named.groupBy("name1", "name2").agg(F.sum("a").alias("area"))
