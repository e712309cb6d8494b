"""Species and record aggregates over cells, areas and years."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.functions import geo


def gridded(occ: DataFrame, minx: float, miny: float, res: float, mode: str = "truncate") -> DataFrame:
    """occ with row (from the south) and col of its cell."""
    return occ.withColumns({"col": geo.cell_index("lon", F.lit(minx), res, mode), "row": geo.cell_index("lat", F.lit(miny), res, mode)})


def sites_by_species(occ: DataFrame, minx: float, miny: float, res: float, keep: Column | None = None) -> DataFrame:
    """(row, col, species, n). keep: a condition on the cell's centre (x, y)."""
    g = gridded(occ, minx, miny, res).withColumns({"x": minx + (F.col("col") + 0.5) * res, "y": miny + (F.col("row") + 0.5) * res})
    return (g if keep is None else g.filter(keep)).groupBy("row", "col", "species").agg(F.count("*").alias("n"))


def site_matrix(sites: DataFrame, species: list[str]) -> DataFrame:
    """A row a cell, a column for each species named (at most 10,000), zero filled."""
    if len(species) > 10_000:
        raise ValueError("over 10,000 species: use the long form")
    return sites.groupBy("row", "col").pivot("species", species).sum("n").na.fill(0)


def density(occ: DataFrame, minx: float, miny: float, res: float) -> DataFrame:
    """(row, col, n) with records given to the nearest cell."""
    return gridded(occ, minx, miny, res, "round").groupBy("row", "col").agg(F.count("*").alias("n"))


def _window(cells: DataFrame, size: int, rows: int, cols: int, wrap: bool = False) -> DataFrame:
    """Every cell once for each cell of the grid whose size x size window it is in; with wrap, the last column is beside the first."""
    if size % 2 == 0 or not 1 <= size <= 15:
        raise ValueError("the window is odd, 1 to 15")
    h = size // 2
    off = lambda: F.explode(F.sequence(F.lit(-h), F.lit(h)))
    out = cells.withColumn("dr", off()).withColumn("dc", off())
    col = F.col("col") + F.col("dc")
    out = out.withColumns({"row": F.col("row") + F.col("dr"), "col": F.pmod(col, F.lit(cols)) if wrap else col}).drop("dr", "dc")
    return out.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def _in_grid(size: int, rows: int, cols: int, wrap: bool = False) -> Column:
    """Cells of the window round (row, col) that the grid has."""
    h = size // 2
    side = lambda c, n: F.least(F.col(c) + h, F.lit(n - 1)) - F.greatest(F.col(c) - h, F.lit(0)) + 1
    return side("row", rows) * (F.lit(size) if wrap else side("col", cols))


def focal_mean(cells: DataFrame, size: int, rows: int, cols: int, wrap: bool = False) -> DataFrame:
    """(row, col, value): mean of n over the window, by the cells the grid has; cells with an empty window are left out.

    wrap: the grid goes round the world, so its first and last columns are neighbours; it has `size` columns at least.
    """
    return _window(cells, size, rows, cols, wrap).groupBy("row", "col").agg(F.sum("n").alias("s")).select("row", "col", (F.col("s") / _in_grid(size, rows, cols, wrap)).alias("value"))


def focal_richness(sites: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """(row, col, value): species of the window over its cells in the grid."""
    own = _window(sites.select("row", "col", "species").distinct(), size, rows, cols)
    return own.groupBy("row", "col").agg(F.countDistinct("species").alias("s")).select("row", "col", (F.col("s") / _in_grid(size, rows, cols)).alias("value"))


def points_to_grid(occ: DataFrame, res: float, size: int) -> DataFrame:
    """(row, col, density, richness) over the records' extent grown by a cell; without a record, an error."""
    e = occ.agg(*(f(c).alias(n) for n, f, c in (("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat")))).first()
    if e.x0 is None:
        raise ValueError("no records")
    import math

    minx, miny = math.floor(e.x0 / res) * res - res, math.floor(e.y0 / res) * res - res
    cols, rows = math.ceil((e.x1 + res - minx) / res), math.ceil((e.y1 + res - miny) / res)
    sites = sites_by_species(occ, minx, miny, res)
    dense = focal_mean(sites.groupBy("row", "col").agg(F.sum("n").alias("n")), size, rows, cols).withColumnRenamed("value", "density")
    return dense.join(focal_richness(sites, size, rows, cols).withColumnRenamed("value", "richness"), ["row", "col"], "full")


def world_cells(occ: DataFrame, res: float) -> DataFrame:
    """occ with lat_cell (up) and lon_cell (down) of the world grid, exact for decimal coordinates."""
    dec = lambda c: F.col(c).cast("decimal(12,8)") / F.lit(str(res)).cast("decimal(12,8)")
    return occ.withColumns({"lat_cell": F.ceil(dec("lat")).cast("int"), "lon_cell": F.floor(dec("lon")).cast("int")})


def world_counts(occ: DataFrame, res: float, mask: DataFrame | None = None) -> DataFrame:
    """(lat_cell, lon_cell, n); only cells of mask(lat_cell, lon_cell), if there is one."""
    n = world_cells(occ, res).groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("n"))
    return n if mask is None else n.join(mask.select("lat_cell", "lon_cell").distinct(), ["lat_cell", "lon_cell"], "left_semi")


def world_richness(occ: DataFrame, res: float) -> DataFrame:
    return world_cells(occ, res).groupBy("lat_cell", "lon_cell").agg(F.countDistinct("species").alias("species"))


def endemism(occ: DataFrame, res: float) -> DataFrame:
    """(lat_cell, lon_cell, value): mean over the cell's species of one over the cells that the species has."""
    own = world_cells(occ, res).select("lat_cell", "lon_cell", "species").distinct()
    ranges = own.groupBy("species").agg(F.count("*").alias("cells"))
    return own.join(ranges, "species").groupBy("lat_cell", "lon_cell").agg(F.avg(1 / F.col("cells")).alias("value"))


def shannon(occ: DataFrame, res: float) -> DataFrame:
    """(lat_cell, lon_cell, value): -sum p ln p over species' shares of the cell's records."""
    n = world_cells(occ, res).groupBy("lat_cell", "lon_cell", "species").agg(F.count("*").alias("n"))
    total = n.groupBy("lat_cell", "lon_cell").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.join(total, ["lat_cell", "lon_cell"]).groupBy("lat_cell", "lon_cell").agg((-F.sum(p * F.log(p))).alias("value"))


def double_gridding(occ: DataFrame, primary: float, secondary: float, years: int) -> DataFrame:
    """Per outer cell and year bin: species, distinct inner cells, records. Bins start at whole multiples of `years`."""
    at = lambda c, r: F.floor(F.col(c) / r).cast("int")
    g = occ.select("species", at("lon", secondary).alias("ox"), at("lat", secondary).alias("oy"), (F.floor(F.col("year") / years) * years).cast("int").alias("bin"), F.struct(at("lon", primary), at("lat", primary)).alias("inner"))
    return g.groupBy("ox", "oy", "bin").agg(F.countDistinct("species").alias("species"), F.countDistinct("inner").alias("bins"), F.count("*").alias("n"))


def double_gridding_species(occ: DataFrame, primary: float, secondary: float, years: int) -> DataFrame:
    """(ox, oy, bin, species, bins, n): of each species in an outer cell and year bin, its distinct inner cells and records."""
    at = lambda c, r: F.floor(F.col(c) / r).cast("int")
    g = occ.select("species", at("lon", secondary).alias("ox"), at("lat", secondary).alias("oy"), (F.floor(F.col("year") / years) * years).cast("int").alias("bin"), F.struct(at("lon", primary), at("lat", primary)).alias("inner"))
    return g.groupBy("ox", "oy", "bin", "species").agg(F.countDistinct("inner").alias("bins"), F.count("*").alias("n"))


def decade(year) -> Column:
    """Decade number: 1991 to 2000 is 200."""
    return F.ceil((F.col(year) if isinstance(year, str) else year) / 10).cast("int")


def richness_frequency(occ: DataFrame, res: float, group: str) -> DataFrame:
    """(group, richness, cells): how many cells have each species count, within each value of a column."""
    cells = world_cells(occ, res).groupBy(group, "lat_cell", "lon_cell").agg(F.countDistinct("species").alias("richness"))
    return cells.groupBy(group, "richness").agg(F.count("*").alias("cells"))


def decade_persistence(occ: DataFrame, res: float) -> DataFrame:
    """(decades, n): of species in cells, how many were seen in so many decades."""
    seen = world_cells(occ, res).groupBy("lat_cell", "lon_cell", "species").agg(F.countDistinct(decade("year")).alias("decades"))
    return seen.groupBy("decades").agg(F.count("*").alias("n"))


def tabulation_counts(hits: DataFrame) -> DataFrame:
    """(side, pid1, pid2, occurrences, species) of records with both pid1 and pid2: by pair, and by each side's pid."""
    g = hits.filter("pid1 is not null and pid2 is not null").groupingSets([("pid1", "pid2"), ("pid1",), ("pid2",)], "pid1", "pid2")
    return g.agg(F.count("*").alias("occurrences"), F.countDistinct("species").alias("species"), F.grouping_id().cast("int").alias("side"))


def matrix_totals(tab: DataFrame, value: str = "area") -> DataFrame:
    """(pid1, pid2, total): cells of the matrix, row and column totals (null on the other side) and the grand total."""
    return tab.cube("pid1", "pid2").agg(F.sum(value).alias("total"))


def tabulation_matrix(tab: DataFrame, species: DataFrame, value: str = "area") -> DataFrame:
    """(at, pid, cells, total, species): the matrix of tab(pid1, pid2, value): the side of more objects as rows (the first, of equals),
    the other as columns, both by pid; cells are null where a pair has none. After the rows come the columns' totals (pid null) and
    their numbers of species. species(side, pid1, pid2, species) as `tabulation_counts` gives it.

    A row's cells are gathered by partial aggregates; a row is as wide as the smaller side.
    """
    one = tab.agg((F.count_distinct("pid1") < F.count_distinct("pid2")).alias("turned")).first()["turned"]
    row, col = ("pid2", "pid1") if one else ("pid1", "pid2")
    sums = tab.groupBy(F.col(row).alias("pid"), F.col(col).alias("col")).agg(F.sum(value).alias("v"))
    columns = tab.agg(F.sort_array(F.collect_set(col)).alias("columns"))
    wide = lambda d: d.crossJoin(F.broadcast(columns)).withColumn("cells", F.transform("columns", lambda c: F.try_element_at("m", c)))  # noqa: E731  one row
    mapped = F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m")
    own = species.filter("side > 0").select(F.col("pid1").alias("p1"), F.col("pid2").alias("p2"), F.col("species").cast("double").alias("s"))
    side = lambda k: own.filter(F.col("p1" if k == "pid1" else "p2").isNotNull()).select(F.col("p1" if k == "pid1" else "p2").alias("key"), "s")
    rows = wide(sums.groupBy("pid").agg(mapped, F.sum("v").alias("total"))).join(side(row), F.col("pid") == F.col("key"), "left")
    rows = rows.select(F.row_number().over(Window.orderBy("pid")).alias("at"), "pid", "cells", "total", "s")
    last = wide(sums.groupBy("col").agg(F.sum("v").alias("v")).agg(mapped, F.sum("v").alias("total"))).select(F.lit(2**31 - 2).alias("at"), F.lit(None).cast(dict(rows.dtypes)["pid"]).alias("pid"), "cells", "total", F.lit(None).cast("double").alias("s"))
    kinds = wide(side(col).select(F.col("key").alias("col"), F.col("s").alias("v")).agg(mapped)).select(F.lit(2**31 - 1).alias("at"), F.lit(None).cast(dict(rows.dtypes)["pid"]).alias("pid"), "cells", F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("s"))
    return rows.unionByName(last).unionByName(kinds).withColumnRenamed("s", "species")


def percent_of_total(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("percent", F.col(value) * 100 / F.sum(value).over(Window.partitionBy()))


def binned(values: DataFrame, column: str, bins: int = 16) -> DataFrame:
    """values with bin 0..bins-1 of equal width from min to max: half-open, the last closed; nulls left out."""
    e = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if e.lo is None:
        return values.filter(F.lit(False)).withColumn("bin", F.lit(0))
    width = (e.hi - e.lo) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - e.lo) / width), F.lit(bins - 1))
    return values.filter(F.col(column).isNotNull()).withColumn("bin", at.cast("int"))


def taxon_frequency(occ: DataFrame, min_year: int) -> DataFrame:
    """(year, n, running) of records from min_year on."""
    n = occ.filter(F.col("year") >= min_year).groupBy("year").agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def frequency_ratio(a: DataFrame, b: DataFrame, min_year: int) -> DataFrame:
    """(year, n1, n2, ratio, running_ratio): running n1 over running n2, and its running sum; null where n2 has no record yet."""
    own = lambda d, n: d.filter(F.col("year") >= min_year).groupBy("year").agg(F.count("*").alias(n))
    both = own(a, "n1").join(own(b, "n2"), "year", "full").na.fill(0, ["n1", "n2"])
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    r = F.sum("n1").over(w) / F.nullif(F.sum("n2").over(w), F.lit(0))
    return both.withColumn("ratio", r).withColumn("running_ratio", F.sum("ratio").over(w))


def area_of_occupancy(occ: DataFrame, res: float) -> DataFrame:
    """(species, cells, km2): distinct lattice cells, each counted as (100 res)^2 km2."""
    own = occ.select("species", geo.snap("lon", res).alias("x"), geo.snap("lat", res).alias("y")).distinct()
    return own.groupBy("species").agg(F.count("*").alias("cells")).withColumn("km2", F.col("cells") * res * res * 10_000)


def compare_areas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(species, n1, n2, status): species of two sets of records, counts, and where they are."""
    own = lambda d, n: d.groupBy("species").agg(F.count("*").alias(n))
    both = own(a, "n1").join(own(b, "n2"), "species", "full").na.fill(0, ["n1", "n2"])
    return both.withColumn("status", F.when(F.col("n2") == 0, "only 1").when(F.col("n1") == 0, "only 2").otherwise("both"))


def compare_field(records: DataFrame) -> DataFrame:
    """(pid1, pid2, only1, only2, both) for every two areas of a field, pid1 < pid2, of records(pid, species): numbers of species.

    What two areas share is counted species by species; what only one has follows from the areas' own numbers, so nothing but
    shared species is paired."""
    own = records.select("pid", "species").distinct()
    n = own.groupBy("pid").agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed("pid", "pid1"), own.withColumnRenamed("pid", "pid2")
    both = a.join(b, "species").filter("pid1 < pid2").groupBy("pid1", "pid2").agg(F.count("*").alias("both"))
    areas = n.select(F.col("pid").alias("pid1"), F.col("n").alias("n1")).join(n.select(F.col("pid").alias("pid2"), F.col("n").alias("n2")), F.col("pid1") < F.col("pid2"))
    out = areas.join(both, ["pid1", "pid2"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.select("pid1", "pid2", (F.col("n1") - F.col("both")).alias("only1"), (F.col("n2") - F.col("both")).alias("only2"), "both")


@dataclass(frozen=True)
class Lattice:
    """Where a grid's cells are: its west and north edges, the size of a cell, rows and columns."""

    west: float
    north: float
    res: float
    rows: int
    cols: int

    def common(self, other: Lattice) -> tuple[float, float, float, float]:
        """(west, south, east, north) of the extent that two lattices share."""
        south, east = (lambda g: g.north - g.rows * g.res), (lambda g: g.west + g.cols * g.res)
        return max(self.west, other.west), max(south(self), south(other)), min(east(self), east(other)), min(self.north, other.north)


def common_cells(a: DataFrame, b: DataFrame, la: Lattice, lb: Lattice) -> DataFrame:
    """(row, col, a, b): values of two grids at the cells of the finer one (the first, of equals) whose centres are in the common extent.

    A cell of the finer grid has the value of the coarser cell that its centre is in, on an edge the one to the south and east. Each
    finer cell names its coarser one by arithmetic, so grids of any sizes and offsets meet in one equi-join of a row a cell.
    """
    fine, coarse, lf, lc = (a, b, la, lb) if la.res <= lb.res else (b, a, lb, la)
    names = ("a", "b") if la.res <= lb.res else ("b", "a")
    west, south, east, north = la.common(lb)
    lon, lat = F.lit(lf.west) + (F.col("row_col.col") + 0.5) * lf.res, F.lit(lf.north) - (F.col("row_col.row") + 0.5) * lf.res
    own = fine.select(F.struct("row", "col").alias("row_col"), F.col("value").cast("double").alias(names[0])).filter((lon >= west) & (lon <= east) & (lat >= south) & (lat <= north))
    cell = lambda x, n: F.least(F.floor(x), F.lit(n - 1)).cast("int")  # noqa: E731  a centre on the last edge is in the last cell
    own = own.withColumns({"row": cell((F.lit(lc.north) - lat) / lc.res, lc.rows), "col": cell((lon - F.lit(lc.west)) / lc.res, lc.cols)})
    other = coarse.select("row", "col", F.col("value").cast("double").alias(names[1]))
    return own.join(other, ["row", "col"]).select("row_col.row", "row_col.col", "a", "b")


def layer_distance(a: DataFrame, b: DataFrame, la: Lattice, lb: Lattice) -> DataFrame:
    """One row (distance): mean absolute difference of two grids' values, each min-max scaled by its own range (a grid of one value is 0
    throughout), at the cells of the finer grid in the common extent; null without one."""
    own = lambda d: d.filter("value is not null").crossJoin(F.broadcast(d.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))).select("row", "col", geo.min_max_scale("value", "lo", "hi").alias("value"))  # noqa: E731  one row
    return common_cells(own(a), own(b), la, lb).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("distance"))


def class_statistics(cells: DataFrame, res: float) -> DataFrame:
    """Per class value: cells, km2 and the box of its cells."""
    h = res / 2
    c = cells.withColumn("km2", geo.cell_area(res, "lat"))
    return c.groupBy("value").agg(F.count("*").alias("cells"), F.sum("km2").alias("km2"), (F.min("lon") - h).alias("minx"), (F.min("lat") - h).alias("miny"), (F.max("lon") + h).alias("maxx"), (F.max("lat") + h).alias("maxy"))


def species_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """(species, status) of two sets of records: only 1, only 2 or both."""
    own = lambda d, k: d.select("species").distinct().withColumn("k", F.lit(k))
    k = own(a, 1).unionByName(own(b, 2)).groupBy("species").agg(F.sum("k").alias("k"))
    return k.select("species", F.when(F.col("k") == 1, "only 1").when(F.col("k") == 2, "only 2").otherwise("both").alias("status"))


def endemic_species(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Species with a record inside and none outside."""
    return inside.select("species").distinct().join(outside.select("species").distinct(), "species", "left_anti")


def extent_intersection(boxes: DataFrame) -> DataFrame:
    """One row: the box common to all, and whether it holds anything."""
    e = boxes.agg(F.max("minx").alias("minx"), F.max("miny").alias("miny"), F.min("maxx").alias("maxx"), F.min("maxy").alias("maxy"))
    return e.withColumn("valid", (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))
