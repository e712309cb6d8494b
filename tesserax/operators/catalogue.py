"""Catalogue, log and look-up operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators.overlay import as_rings, overlay_area, overlay_shapes, planar_area
from tesserax.operators.spatial import every_polygon, shapes
from tesserax.sources.exports import as_wkt
from tesserax.sources.records import numbered
from tesserax.sources.scratch import materialise


def tabulation_list(tab: DataFrame) -> DataFrame:
    """(fid1, fid2, area) of the field pairs in id order with an area, leaving out pairs with an incomplete row."""
    own = tab.filter("fid1 < fid2")
    missing = own.filter("not complete").select("fid1", "fid2").distinct()
    return own.join(missing, ["fid1", "fid2"], "left_anti").groupBy("fid1", "fid2").agg(F.sum("area").alias("area")).filter("area > 0")


def tabulation_clipped(rings_a: DataFrame, rings_b: DataFrame, clip: DataFrame, occ: DataFrame, names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """(pid1, pid2, name1, name2, area, occurrences, species) of the overlay of two fields within an area (rings), recomputed:
    planar area, records and species of what is left of each pair. Names come from (pid, name)."""
    key = F.concat_ws(":", "pid1", "pid2")
    both = materialise(as_rings(overlay_shapes(rings_a, rings_b), key), "overlay")
    cut = materialise(overlay_shapes(both, clip.withColumn("pid", F.lit("0"))), "clipped")
    area = cut.groupBy(F.col("pid1").alias("pid")).agg(F.sum(planar_area("xs", "ys")).alias("area"))
    inside = every_polygon(occ.select("lon", "lat", "species"), as_rings(cut, F.col("pid1")))
    counts = inside.groupBy("pid").agg(F.count("*").alias("occurrences"), F.countDistinct("species").alias("species"))
    out = area.join(counts, "pid", "left").na.fill(0, ["occurrences", "species"])
    at = lambda k, d: F.split("pid", ":")[k].cast(dict(d.dtypes)["pid"])
    out = out.withColumns({"pid1": at(0, rings_a), "pid2": at(1, rings_b)}).drop("pid")
    named = lambda d, k: d.select(F.col("pid").alias(f"pid{k}"), F.col("name").alias(f"name{k}"))
    return out.join(named(names_a, 1), "pid1").join(named(names_b, 2), "pid2")


def download_allowed(layers: DataFrame, levels: list[int], level: str = "licence_level") -> DataFrame:
    """Layers whose licence level permits a download; layers without a level do not."""
    return layers.filter(F.col(level).isin(*levels))


def layer_usage(log: DataFrame, tasks: DataFrame, fields: DataFrame) -> DataFrame:
    """(level, id, kind, n): uses of fields and of their layers, by kind and in all (kind `Total`).

    log(id, kind): a field and what it was used for; tasks(kind, inputs): JSON {"layers": [...]} with the fields that a task
    took; fields(id, layer). Uses of unknown fields count for the field only.
    """
    taken = tasks.select(F.explode(F.from_json("inputs", "layers array<long>")["layers"]).alias("id"), "kind")
    uses = log.filter("id is not null").select("id", "kind").unionByName(taken).groupBy("id", "kind").agg(F.count("*").alias("n"))
    layers = uses.join(fields.select("id", "layer"), "id").groupBy(F.col("layer").alias("id"), "kind").agg(F.sum("n").alias("n"))
    both = uses.select(F.lit("field").alias("level"), "id", "kind", "n").unionByName(layers.select(F.lit("layer").alias("level"), "id", "kind", "n"))
    return both.rollup("level", "id", "kind").agg(F.sum("n").alias("n")).filter("id is not null").na.fill({"kind": "Total"})


def facet_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, values_, total): counts of a column's values, how many values there are, and records."""
    every = Window.partitionBy()
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumns({"values_": F.count("*").over(every), "total": F.sum("n").over(every)})


# -- predicates ---------------------------------------------------------------------------------------------------------


def parse_envelope(text: str) -> dict[str, tuple[float, float] | list[int]]:
    """`ENVELOPE(layer,min,max:layer,id,id...)`: el* layers have a range, others a list of object ids."""
    out: dict = {}
    for part in text.strip().removeprefix("ENVELOPE(").removesuffix(")").split(":"):
        name, *values = (x.strip() for x in part.split(","))
        out[name] = (float(values[0]), float(values[1])) if name.startswith("el") else [int(x) for x in values]
    return out


def environmental_range(column, low: float, high: float):
    """low - 1e-7 <= value <= high + 1e-7; null and NaN are outside."""
    c = F.col(column)
    return F.coalesce(~F.isnan(c) & (c >= low - 1e-7) & (c <= high + 1e-7), F.lit(False))


def envelope(text: str):
    """Column: all parts of an envelope hold, for a table with a column for each layer."""
    test = F.lit(True)
    for name, want in parse_envelope(text).items():
        test = test & (environmental_range(name, *want) if isinstance(want, tuple) else F.coalesce(F.col(name).isin(want), F.lit(False)))
    return test


def facet(text: str):
    """Column of a facet filter: `field:value`, `field:"v"`, `field:*`, `field:[a TO b]`, a leading `-`, AND, OR, brackets."""
    tokens = re.findall(r'\(|\)|AND\b|OR\b|-?\w+:(?:"[^"]*"|\[[^\]]*\]|[^\s()]+)', text)

    def term(t: str):
        name, value = t.lstrip("-").split(":", 1)
        c = F.col(name)
        if value == "*":
            test = c.isNotNull()
        elif value.startswith("["):
            a, b = value[1:-1].split(" TO ")
            test = (F.lit(True) if a == "*" else c >= F.lit(float(a))) & (F.lit(True) if b == "*" else c <= F.lit(float(b)))
        else:
            test = c.cast("string") == value.strip('"')
        test = F.coalesce(test, F.lit(False))
        return ~test if t.startswith("-") else test

    def any_of():
        out = all_of()
        while tokens and tokens[0] == "OR":
            tokens.pop(0)
            out = out | all_of()
        return out

    def all_of():
        out = one()
        while tokens and tokens[0] not in ("OR", ")"):
            if tokens[0] == "AND":
                tokens.pop(0)
            out = out & one()
        return out

    def one():
        t = tokens.pop(0)
        if t != "(":
            return term(t)
        out = any_of()
        tokens.pop(0)
        return out

    return any_of()


def year_facet(text: str, year: str = "year"):
    """`[a TO b]`, `before` (to 1849) or a decade's first year followed by `s`, as a range of a year column."""
    if text == "before":
        return F.col(year) <= 1849
    if text.endswith("s"):
        return F.col(year).between(int(text[:-1]), int(text[:-1]) + 9)
    a, b = text.strip("[]").split(" TO ")
    return F.col(year).between(int(a), int(b))


def without_sensitive(occ: DataFrame, flag: str = "sensitive") -> tuple[DataFrame, DataFrame]:
    """Records without the flag, and the distinct species that have a record with it."""
    return occ.filter(F.col(flag).isNull()), occ.filter(F.col(flag).isNotNull()).select("species").distinct()


def matches(text: str, *columns: str):
    """Any column holds the text, whatever its case; % and _ in it are plain."""
    pattern = "%" + re.sub(r"([%_\\])", r"\\\1", text) + "%"
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return test


def domains_meet(a, b):
    """True if either list of domains is null, or the comma lists share one, whatever the case."""
    own = lambda c: F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))
    return F.coalesce(F.arrays_overlap(own(a), own(b)), F.lit(True))


def objects_of_field(objects: DataFrame, classes: DataFrame, fid: str, text: str = "", start: int = 0, size: int | None = None) -> DataFrame:
    """(pid, name) of a page of a field's objects whose name or description has the text, by pid; of a field without such objects the
    classes(fid, layer, value, name) of its grid whose name has it, by value, as `layer:value`."""
    page = lambda d: d.offset(start) if size is None else d.offset(start).limit(size)
    own = objects.filter(F.col("fid") == fid).filter(matches(text, "name", "descr"))
    found = page(own.orderBy("pid")).select(F.col("pid").cast("string").alias("pid"), "name")
    none = own.groupBy().agg((F.count("*") == 0).alias("none"))  # one row
    other = classes.filter(F.col("fid") == fid).filter(matches(text, "name")).crossJoin(F.broadcast(none)).filter("none")
    return found.unionByName(page(other.orderBy("value")).select(F.concat_ws(":", "layer", "value").alias("pid"), "name"))


def articles_in(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(id) of the articles of points(id, lon, lat) with a place in any of the polygons, each once."""
    return every_polygon(points.select("id", "lon", "lat"), rings).select("id").distinct()


def single_field(rings: DataFrame, names: DataFrame, area: DataFrame | None = None) -> DataFrame:
    """(pid, name, area) of a field's objects (rings): square degrees of each within an area (rings of one object or of a text), or of
    each whole one if there is none; holes do not count. Objects without an area there are left out."""
    if area is None:
        signed = F.when(F.col("ring") == 0, planar_area("xs", "ys")).otherwise(-planar_area("xs", "ys"))
        found = rings.groupBy("pid").agg(F.sum(signed).alias("area"))
    else:
        found = overlay_area(rings, area).groupBy(F.col("pid1").alias("pid")).agg(F.sum("area").alias("area"))
    return found.filter("area > 0").join(names.select("pid", "name"), "pid").select("pid", "name", "area")


def single_grid_field(cells: DataFrame, rings: DataFrame, res: float) -> DataFrame:
    """(value, cells, km2) of the classes of a grid whose cells' centres an area (rings) holds."""
    own = cells.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat")})
    return every_polygon(own, rings).groupBy("value").agg(F.count("*").alias("cells"), F.sum(geo.cell_area(res, "lat")).alias("km2"))


# -- look-ups and joins -------------------------------------------------------------------------------------------------


def search_ranked(df: DataFrame, text: str, limit: int, offset: int = 0, fields: list[str] | None = None) -> DataFrame:
    """Objects with the text in their name: by its place in the name, then name, then pid."""
    own = df.filter(matches(text, "name"))
    own = own if fields is None else own.filter(F.col("fid").isin(fields))
    return own.withColumn("at", F.locate(text.lower(), F.lower("name"))).orderBy("at", "name", "pid").offset(offset).limit(limit)


def catalogue_diff(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, status): only local, only remote, both."""
    a, b = local.select(key).distinct().withColumn("a", F.lit(1)), remote.select(key).distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("b").isNull(), "local").when(F.col("a").isNull(), "remote").otherwise("both")
    return a.join(b, key, "full").select(key, status.alias("status"))


#: Fields of one group and domain that are paired as one block.
BLOCK = 4096
#: Blocks of second fields that meet one row of a first field.
BAND = 8


def missing_pairs(fields: DataFrame, done: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id1, id2), id1 < id2, of intersecting fields with compatible domains of one group that are not done either way.

    fields(id, grp, domain, intersects): pairs are sought within groups, which bounds them. Domains are compared once for each two that
    there are; a group's fields of a domain are dealt to blocks. Second fields are packed, a row a block, and go to each block of first
    fields whose domain meets theirs; first fields have a row for each such domain, and for each BAND of its blocks, so that what a task
    holds of the pairs of one field is bounded. What is done stands as a list with the first field of a pair.
    """
    own = fields.filter("intersects and id is not null").select("id", "grp", "domain")
    each = own.select("domain").distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    meet = each.withColumnRenamed("domain", "d1").crossJoin(each.withColumnRenamed("domain", "d2")).filter(domains_meet(F.col("d1"), F.col("d2")))
    blocks = own.groupBy("grp", "domain").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    size = blocks.select(F.col("grp").alias("_g"), F.col("domain").alias("_d"), "blocks")
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = own.join(size, (F.col("grp") == F.col("_g")) & same("domain", "_d")).select("id", "grp", "domain", at.alias("at"))
    ends = done.filter("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    member = lambda k: own.select(F.col("id").alias(f"id{k}"), F.col("grp").alias(f"g{k}")).distinct()
    known = ends.join(member(1), "id1").join(member(2), "id2").filter("g1 = g2").groupBy(F.col("id1").alias("id")).agg(F.collect_set("id2").alias("known"))
    key = F.struct("grp", "d1", "d2", "at", "band").alias("key")
    first = dealt.join(known, "id", "left").join(meet, same("domain", "d1")).join(size, (F.col("grp") == F.col("_g")) & same("d2", "_d"))
    bands = F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BAND).cast("int"))).alias("band")
    first = first.select(F.col("id").alias("id1"), "known", "grp", "d1", "d2", "at", bands).select("id1", "known", key)
    packed = dealt.groupBy("grp", "domain", "at").agg(F.collect_list("id").alias("ids")).withColumn("band", F.floor(F.col("at") / BAND).cast("int"))
    second = packed.drop("at").join(meet, same("domain", "d2")).join(size, (F.col("grp") == F.col("_g")) & same("d1", "_d"))
    second = second.select("grp", "d1", "d2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "band", "ids").select(key, "ids")
    # merged, so that rows of first fields stream past packed blocks and not the other way round
    pairs = first.hint("merge").join(second, "key").select("id1", "known", F.explode("ids").alias("id2")).filter(F.col("id1") < F.col("id2"))
    return pairs.filter(F.col("known").isNull() | ~F.array_contains("known", F.col("id2"))).select("id1", "id2")


def plain(name):
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def match_names(names: DataFrame, objects: DataFrame) -> DataFrame:
    """(name, pid, how): exact name first, then the remainder by letters and digits alone; the lowest pid of each."""
    exact = names.join(objects.groupBy("name").agg(F.min("pid").alias("pid")), "name").withColumn("how", F.lit("exact"))
    rest = names.join(exact.select("name"), "name", "left_anti")
    loose = objects.groupBy(plain("name").alias("key")).agg(F.min("pid").alias("pid"))
    return exact.unionByName(rest.withColumn("key", plain("name")).join(loose, "key").drop("key").withColumn("how", F.lit("plain")))


def backfill_pid(rows: DataFrame, objects: DataFrame, geometry: str = "geom") -> DataFrame:
    """rows with pid: their own, or that of an object with equal geometry text, or a new one shared by equal geometries."""
    known = objects.groupBy(geometry).agg(F.min("pid").alias("known"))
    own = rows.join(known, geometry, "left").withColumn("pid", F.coalesce("pid", "known")).drop("known")
    new = own.filter("pid is null").select(geometry).distinct().withColumn("new", F.concat(F.lit("g"), F.md5(geometry)))
    return own.join(new, geometry, "left").withColumn("pid", F.coalesce(F.col("pid").cast("string"), "new")).drop("new")


def rematch(taxa: DataFrame, names: DataFrame, force: bool = False) -> DataFrame:
    """taxa with family and lsid from names(name, family, lsid, issue) where empty or forced; issue `excluded` blanks both."""
    n = names.select("name", F.col("family").alias("f"), F.col("lsid").alias("l"), "issue")
    out = taxa.join(n, "name", "left")
    new = lambda c, x: F.when(F.col("issue") == "excluded", None).when(F.lit(force) | F.col(c).isNull(), F.coalesce(x, c)).otherwise(F.col(c))
    return out.withColumns({"family": new("family", "f"), "lsid": new("lsid", "l")}).drop("f", "l", "issue")


# -- reports ------------------------------------------------------------------------------------------------------------


def log_counts(log: DataFrame, by: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Per group and month: records, records of each first category, distinct sessions and users; most first."""
    g = log.groupBy(*by, F.year("created").alias("year"), F.month("created").alias("month"))
    tool, area = (F.count_if(F.col("category1") == c) for c in ("Tool", "Area"))
    out = g.agg(F.count("*").alias("records"), tool.alias("tools"), area.alias("areas"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("user_id").alias("users"))
    out = out.orderBy(F.col("records").desc(), *by, "year", "month")
    return out if limit is None else out.offset(offset).limit(limit)


def aggregate_shapes(rings: DataFrame, name: str, description: list[str]) -> DataFrame:
    """(name, description, parts, km2, minx, miny, maxx, maxy, wkt): features with rings(pid, ring, xs, ys, name, ...) grouped to
    objects by name; the description joins several columns of the group, the features become the parts of one polygon."""
    first = Window.partitionBy(name).orderBy("pid")
    own = rings.withColumn("part", F.dense_rank().over(first) - 1)
    signed = F.when(F.col("ring") == 0, 1).otherwise(-1) * F.abs(geo.ring_area("xs", "ys")) / 1e6
    facts = own.withColumn("a", signed).groupBy(name, *(c for c in description if c != name)).agg(
        F.countDistinct("pid").alias("parts"), F.sum("a").alias("km2"), F.min(F.array_min("xs")).alias("minx"), F.min(F.array_min("ys")).alias("miny"), F.max(F.array_max("xs")).alias("maxx"), F.max(F.array_max("ys")).alias("maxy")
    )
    text = as_wkt(shapes(own.select(F.col(name).alias("pid"), "part", "ring", "xs", "ys"))).withColumnRenamed("pid", name)
    return facts.withColumn("description", F.concat_ws(", ", *description)).join(text, name)


def area_report(found: DataFrame, pid: int, distributions: DataFrame, articles: DataFrame, tabulated: DataFrame) -> DataFrame:
    """(item, n): the sizes of an area report's tables.

    found(pid, species, taxon): records in all areas; distributions and articles of the area only; tabulated: its overlaps.
    """
    item = lambda d, k, c: d.agg(c.alias("n")).select(F.lit(k).alias("item"), "n")
    own = found.filter(F.col("pid") == pid)
    endemic = own.select("taxon").distinct().join(found.filter(F.col("pid") != pid).select("taxon").distinct(), "taxon", "left_anti")
    parts = [
        item(own, "records", F.count("*")), item(own, "species", F.countDistinct("species")), item(endemic, "endemic", F.count("*")),
        item(distributions.filter("type = 'c'"), "checklists", F.countDistinct("wmsurl")), item(distributions.filter("type = 'e'"), "expert distributions", F.count("*")),
        item(articles, "articles", F.countDistinct("id")), item(tabulated, "tabulation", F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Columns that an activity report has at most.
MAX_KINDS = 1000


def user_activity(log: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """A row a user, most active first (place), a column for each category pair (all of the log, if none are named), zero filled, with the total."""
    pair = F.concat_ws("_", "category1", "category2")
    if kinds is None:
        kinds = [r.pair for r in log.select(pair.alias("pair")).distinct().orderBy("pair").limit(MAX_KINDS + 1).collect()]
        if len(kinds) > MAX_KINDS:
            raise ValueError(f"over {MAX_KINDS} kinds: name those wanted")
    out = log.withColumn("pair", pair).groupBy("user_id").pivot("pair", kinds).count().na.fill(0)
    out = out.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))
    return numbered(out, [F.col("total").desc(), F.col("user_id").asc()], "place").orderBy("place")


def infer_type(df: DataFrame, column: str) -> DataFrame:
    """One row (column, type): INT, LONG, DOUBLE or STRING, the narrowest that every non-blank value parses as."""
    v = F.when(F.trim(column) != "", F.trim(column))
    parsed = lambda t: F.count(F.expr(f"try_cast(trim({column}) as {t})"))
    n = df.agg(F.count(v).alias("n"), parsed("int").alias("i"), parsed("bigint").alias("l"), parsed("double").alias("d"))
    kind = F.when((F.col("n") == 0) | (F.col("d") < F.col("n")), "STRING").when(F.col("i") == F.col("n"), "INT").when(F.col("l") == F.col("n"), "LONG").otherwise("DOUBLE")
    return n.select(F.lit(column).alias("column"), kind.alias("type"))


def name_index(objects: DataFrame) -> DataFrame:
    """(name_lower, name_id): the distinct lower-case names of searchable objects, numbered in order."""
    return numbered(objects.filter("namesearch").select(F.lower("name").alias("name_lower")).distinct(), "name_lower", "name_id")
