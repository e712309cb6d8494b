"""Text outputs: samples, matrices, geometries, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.sources.records import numbered


def quoted(c: str) -> Column:
    """Text for a CSV cell: in quotes, doubled inside, where it has a comma or a quote."""
    s = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): one CSV line a row, without the header."""
    return df.select(F.concat_ws(",", *map(quoted, columns)).alias("line"))


def write_samples(df: DataFrame, path: str, fields: list[str]) -> None:
    """latitude, longitude, then the fields, with a header."""
    df.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), *fields).write.csv(path, header=True)


def species_matrix_lines(matrix: DataFrame, species: list[str]) -> DataFrame:
    """(at, line): five header lines (LSID, common name, kingdom, family, species) from pipe-joined keys, then a line a cell."""
    parts = [(s.split("|") + [""] * 5)[:5] for s in species]
    names = [("LSID", 1), ("Common name", 2), ("Kingdom", 3), ("Family", 4), ("Species", 0)]
    head = [(k - 5, ",".join([n, "", *(p[i] for p in parts)])) for k, (n, i) in enumerate(names)]
    top = matrix.sparkSession.createDataFrame(head, "at long, line string")
    body = matrix.select((F.col("row").cast("long") * 1_000_000 + F.col("col")).alias("at"), F.concat_ws(",", "row", "col", *(F.col(f"`{s}`") for s in species)).alias("line"))
    return top.unionByName(body)


def as_wkt(shapes: DataFrame) -> DataFrame:
    """(pid, wkt) of shapes(pid, shape): a polygon, or a multipolygon by parts."""
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(F.transform(F.filter("shape", lambda r: r["part"] == p), lambda r: F.struct(r["ring"], geo.ring_wkt(r["xs"], r["ys"]).alias("w")))), lambda r: r["w"]), ","), F.lit(")"))
    parts = F.array_sort(F.array_distinct(F.transform("shape", lambda r: r["part"])))
    text = F.array_join(F.transform(parts, part), ",")
    return shapes.select("pid", F.when(F.size(parts) == 1, F.concat(F.lit("POLYGON"), text)).otherwise(F.concat(F.lit("MULTIPOLYGON("), text, F.lit(")"))).alias("wkt"))


def _by_part(of) -> Column:
    """One text for each part of `shape`, in order: of(rings), rings being a part's rings in order."""
    parts = F.array_sort(F.array_distinct(F.transform("shape", lambda r: r["part"])))
    rings = lambda p: F.array_sort(F.filter("shape", lambda r: r["part"] == p), lambda a, b: a["ring"] - b["ring"])
    return F.transform(parts, lambda p: of(rings(p)))


def _pairs(r, f) -> Column:
    return F.transform(F.arrays_zip(r["xs"].alias("x"), r["ys"].alias("y")), lambda p: f(p["x"].cast("string"), p["y"].cast("string")))


def as_geojson(shapes: DataFrame) -> DataFrame:
    """(pid, json) of shapes(pid, shape): a Polygon, or a MultiPolygon by parts."""
    ring = lambda r: F.concat(F.lit("["), F.array_join(_pairs(r, lambda x, y: F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))), ","), F.lit("]"))
    parts = _by_part(lambda rings: F.concat(F.lit("["), F.array_join(F.transform(rings, ring), ","), F.lit("]")))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), parts[0], F.lit("}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.array_join(parts, ","), F.lit("]}"))
    return shapes.select("pid", F.when(F.size(parts) == 1, one).otherwise(many).alias("json"))


def as_kml(shapes: DataFrame) -> DataFrame:
    """(pid, kml) of shapes(pid, shape): a MultiGeometry of polygons, holes as inner boundaries."""
    line = lambda r: F.concat(F.lit("<LinearRing><coordinates>"), F.array_join(_pairs(r, lambda x, y: F.concat_ws(",", x, y)), " "), F.lit("</coordinates></LinearRing>"))
    bound = lambda r, i: F.concat(F.when(i == 0, F.lit("<outerBoundaryIs>")).otherwise("<innerBoundaryIs>"), line(r), F.when(i == 0, F.lit("</outerBoundaryIs>")).otherwise("</innerBoundaryIs>"))
    polygons = _by_part(lambda rings: F.concat(F.lit("<Polygon>"), F.array_join(F.transform(rings, bound), ""), F.lit("</Polygon>")))
    return shapes.select("pid", F.concat(F.lit("<MultiGeometry>"), F.array_join(polygons, ""), F.lit("</MultiGeometry>")).alias("kml"))


def joined(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ids, wkt): for ids joined with `~`, the polygons of all of them, in the ids' order, as one collection; unknown ids are left out."""
    each = wanted.select("ids", F.posexplode(F.split("ids", "~")).alias("at", "pid"))
    text = as_wkt(shapes).withColumn("pid", F.col("pid").cast("string"))
    found = each.join(text, "pid").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "wkt"))).alias("w"))
    return found.select("ids", F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(F.transform("w", lambda p: p["wkt"]), ","), F.lit(")")).alias("wkt"))


# The catalogue's columns, name in the table and heading.
CATALOGUE = [
    ("id", "ID"), ("name", "Short name"), ("displayname", "Name"), ("description", "Description"), ("source", "Data provider"),
    ("source_link", "Provider website"), ("respparty_role", "Provider role"), ("mddatest", "Metadata date"), ("citation_date", "Reference date"),
    ("licence_level", "Licence level"), ("licence_link", "Licence info"), ("licence_notes", "Licence notes"), ("type", "Type"),
    ("classification1", "Classification 1"), ("classification2", "Classification 2"), ("environmentalvalueunits", "Units"), ("notes", "Notes"),
    ("metadatapath", "More information"), ("keywords", "Keywords"), ("dt_added", "Date Added"),
]


def write_catalogue(layers: DataFrame, path: str, usage: DataFrame | None = None) -> None:
    """The layers' CATALOGUE columns as CSV with a header; line ends in descriptions and notes become spaces, columns that
    layers lacks are empty. With usage(id, n), a last column Usage, 0 where there is none."""
    flat = ("description", "notes", "licence_notes")
    own = layers.join(usage.select("id", F.col("n").alias("_n")), "id", "left") if usage is not None else layers
    text = lambda c: F.lit("") if c not in layers.columns else F.regexp_replace(F.col(c).cast("string"), "\n", " ") if c in flat else F.date_format(c, "yyyy/MM/dd") if c == "dt_added" else F.col(c).cast("string")
    columns = [F.coalesce(text(c), F.lit("")).alias(h) for c, h in CATALOGUE]
    own.select(*columns, *([F.coalesce("_n", F.lit(0)).alias("Usage")] if usage is not None else [])).write.csv(path, header=True, escape='"')


def tabulation_lines(tab: DataFrame, value: str, unit: str) -> DataFrame:
    """(at, line): a tabulation(name1, name2, value) as a CSV matrix: a header of the second field's names, a line for each of the
    first field's with its total, a line of totals, then notes. Cells without a value are empty. At most 10,000 columns."""
    names = [r.name2 for r in tab.select("name2").distinct().orderBy("name2").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("over 10,000 columns: use the long form")
    number = lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.4f", c))
    cells = tab.groupBy("name1").pivot("name2", names).agg(F.sum(value))
    total = tab.groupBy("name1").agg(F.sum(value).alias("_total"))
    rows = numbered(cells.join(total, "name1"), "name1", "at")
    body = rows.select("at", F.concat_ws(",", quoted("name1"), *(number(F.col(f"`{n}`")) for n in names), number(F.col("_total"))).alias("line"))
    sums = tab.agg(*(F.sum(F.when(F.col("name2") == n, F.col(value))).alias(f"_{k}") for k, n in enumerate(names)), F.sum(value).alias("_total"))
    last = sums.select(F.lit(2**62).alias("at"), F.concat_ws(",", F.lit("Total"), *(number(F.col(f"_{k}")) for k in range(len(names))), number(F.col("_total"))).alias("line"))
    csv = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\n') else n
    fixed = [(0, ",".join(["", *map(csv, names), "Total"])), (2**62 + 1, ""), (2**62 + 2, f"Values are {unit}."), (2**62 + 3, "Blank cells have none.")]
    return body.unionByName(last).unionByName(tab.sparkSession.createDataFrame(fixed, "at long, line string"))


def write_lines(lines: DataFrame, path: str) -> None:
    """lines(at, line) as text files whose names are in the order of `at`: one after the other they are the file."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(path)


def read_lines(spark, path: str) -> DataFrame:
    """(at, line): what write_lines wrote, numbered from 0 in order: by file name, then by place in the file."""
    own = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    return numbered(own, ["f", "m"], "at", 0).select("at", "line")


def read_geojson(rows: DataFrame, column: str) -> DataFrame:
    """rows with shape, array<struct<part, ring, xs, ys>>, of a Polygon or MultiPolygon; other text, and what does not parse, gives null."""
    g = F.from_json(column, "type string, coordinates string")
    one = F.from_json(g["coordinates"], "array<array<array<double>>>")
    many = F.when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], "array<array<array<array<double>>>>")).when(g["type"] == "Polygon", F.array(one))
    axis = lambda r, k: F.transform(r, lambda p: F.get(p, F.lit(k)))
    ring = lambda part: lambda r, j: F.struct(part.cast("int").alias("part"), j.cast("int").alias("ring"), axis(r, 0).alias("xs"), axis(r, 1).alias("ys"))
    return rows.withColumn("shape", F.flatten(F.transform(many, lambda rings, i: F.transform(rings, ring(i)))))
