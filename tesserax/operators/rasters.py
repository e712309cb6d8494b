"""Grids as cell tables (row from the north, col, value)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators.components import components
from tesserax.operators.spatial import covered, first_polygon, in_bucket, meets_box, points_in_polygons, ring_edges, with_bucket
from tesserax.sources.scratch import materialise

#: Degrees of the buckets in which cells meet a region's edges.
BUCKET = 0.5


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """(row, col, one column a layer): all layers' values of a cell in one row; null where a layer has none."""
    return reduce(lambda a, b: a.join(b, ["row", "col"], "full"), (c.select("row", "col", F.col("value").alias(n)) for n, c in layers.items()))


def overlay_grids(a: DataFrame, b: DataFrame, res: float) -> DataFrame:
    """(v1, v2, cells, km2): common cells of two aligned grids by their pair of values."""
    both = a.select("row", "col", "lat", F.col("value").alias("v1")).join(b.select("row", "col", F.col("value").alias("v2")), ["row", "col"])
    return both.groupBy("v1", "v2").agg(F.count("*").alias("cells"), F.sum(geo.cell_area(res, "lat")).alias("km2"))


def standardise(cells: DataFrame, res: float, targets: list[float], west: float, north: float) -> DataFrame:
    """(target, row, col, value): cells on each target lattice that is not too fine, that is if the native cell is at most 1.2
    targets wide; the mean where several native cells fall into one. What is too fine is taken from resolution_for."""
    out = None
    for t in sorted(x for x in targets if res <= 1.2 * x):
        at = [F.floor((F.lit(north) - F.col("lat")) / t).cast("int").alias("row"), F.floor((F.col("lon") - west) / t).cast("int").alias("col")]
        one = cells.groupBy(*at).agg(F.avg("value").alias("value")).select(F.lit(t).alias("target"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the native cells are too coarse for every target")
    return out


def resolution_for(wanted: float, made: list[float]) -> float:
    """Of the resolutions that a layer was made in, the wanted one or the nearest finer; without a finer one, the finest."""
    return max((x for x in made if x <= wanted * (1 + 1e-9)), default=min(made))


def cut(layers: dict[str, DataFrame], mask: DataFrame | None = None) -> DataFrame:
    """(row, col, one column a layer) on the cells that all layers and the mask(row, col) have."""
    wide = reduce(lambda a, b: a.join(b, ["row", "col"]), (c.filter("value is not null").select("row", "col", F.col("value").alias(n)) for n, c in layers.items()))
    return wide if mask is None else wide.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")


def envelope_cells(layers: dict[str, DataFrame], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Cells where every layer is within its range, bounds widened by 1e-7."""
    own = {n: c.filter(F.col("value").between(ranges[n][0] - 1e-7, ranges[n][1] + 1e-7)) for n, c in layers.items()}
    return cut(own)


def envelope_summary(cells: DataFrame, places: DataFrame, res: float, cap: int | None = None) -> DataFrame:
    """One row: cells, km2, trimmed extent in cells, and the resolution, doubled until at most `cap` cells fill the extent."""
    own = cells.join(places.select("row", "col", "lat"), ["row", "col"])
    out = own.agg(F.count("*").alias("cells"), F.sum(geo.cell_area(res, "lat")).alias("km2"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
    size = (F.col("row1") - F.col("row0") + 1) * (F.col("col1") - F.col("col0") + 1)
    times = F.greatest(F.lit(0), F.ceil(F.log(2.0, size / float(cap)) / 2)) if cap else F.lit(0)
    return out.withColumn("res", res * F.pow(F.lit(2.0), times))


def region_mask(cells: DataFrame, rings: DataFrame, res: float) -> DataFrame:
    """(row, col, full): cells of which a region (rings) has a point, and whether it holds them wholly: then none of its edges meets them."""
    h = res / 2
    c = cells.select("row", "col", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    e = ring_edges(rings).select("x1", "y1", "x2", "y2")
    at = lambda v: F.floor(v / BUCKET).cast("int")
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - h), at(F.greatest(a, b) + h)))
    dealt = e.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))
    met = with_bucket(c, BUCKET).join(dealt, ["bx", "by"]).filter(meets_box("x1", "y1", "x2", "y2", F.col("lon") - h, F.col("lat") - h, F.col("lon") + h, F.col("lat") + h)).select("row", "col").distinct()
    inside = points_in_polygons(c, rings).select("lon", "lat").distinct()
    full = c.join(inside, ["lon", "lat"]).select("row", "col").join(met, ["row", "col"], "left_anti").withColumn("full", F.lit(True))
    return met.withColumn("full", F.lit(False)).unionByName(full)


def reclassify(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """cells with each value replaced by the lowest value of its label in classes(value, name)."""
    first = classes.groupBy("name").agg(F.min("value").alias("new"))
    table = classes.join(first, "name").select("value", "new")
    return cells.join(table, "value", "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def where_missing(cells: DataFrame, other: DataFrame, keep: bool) -> DataFrame:
    """cells that the other grid has no value for, or (keep) those it has one for."""
    return cells.join(other.filter("value is not null").select("row", "col"), ["row", "col"], "left_semi" if keep else "left_anti")


def sub_grid(cells: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return cells.filter(geo.in_box("lon", "lat", *map(F.lit, (minx, miny, maxx, maxy))))


def lattice(rings: DataFrame, step: float, size: float = 0.5) -> DataFrame:
    """(pid, lon, lat): the points from the south-west corner of each polygon's box on, by `step`, that the polygon holds, edges included.

    The box is gone over by columns of buckets, and of those only the ones that the polygon fills or that its edges meet."""
    own = covered(rings, size)
    corner = rings.groupBy("pid").agg(F.min(F.array_min("xs")).alias("minx"), F.min(F.array_min("ys")).alias("miny"))

    def at(low, bucket):
        first = F.greatest(F.lit(0), F.floor((F.col(bucket) * size - F.col(low)) / step))
        last = F.ceil(((F.col(bucket) + 1) * size - F.col(low)) / step)
        return F.filter(F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.col(low) + k * step), lambda x: F.floor(x / size) == F.col(bucket))

    points = own.join(corner, "pid").withColumn("lon", F.explode(at("minx", "bx"))).withColumn("lat", F.explode(at("miny", "by")))
    return points.filter(in_bucket("lon", "lat")).select("pid", "lon", "lat")


def rasterise(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """(row, col, pid): the lowest polygon at each cell's centre."""
    own = cells.select("row", "col", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return first_polygon(own, rings).filter("pid is not null").select("row", "col", "pid")


def regions(cells: DataFrame) -> DataFrame:
    """(row, col, value, region): cells of equal value joined edge to edge share the least of their cells' numbers."""
    number = F.shiftleft(F.col("row").cast("long"), 31) + F.col("col")
    own = materialise(cells.select("row", "col", "value", number.alias("id")))
    beside = [own.alias("a").join(own.alias("b"), (F.col("b.row") == F.col("a.row") + dr) & (F.col("b.col") == F.col("a.col") + dc) & (F.col("a.value") == F.col("b.value"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")) for dr, dc in ((0, 1), (1, 0))]
    found = components(reduce(DataFrame.unionByName, beside))
    return own.join(found, own.id == found.node, "left").select("row", "col", "value", F.coalesce("root", "id").alias("region"))


def region_edges(labelled: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2): sides of cells, in cell units from the north-west, that bound a region; interior on the right."""
    c = labelled.select("row", "col", "region")
    out = None
    for dr, dc, (x1, y1, x2, y2) in ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))):
        other = c.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), "region")
        side = c.join(other, ["row", "col", "region"], "left_anti")
        side = side.select("region", (F.col("col") + x1).alias("x1"), (F.col("row") + y1).alias("y1"), (F.col("col") + x2).alias("x2"), (F.col("row") + y2).alias("y2"))
        out = side if out is None else out.unionByName(side)
    return out


def region_rings(labelled: DataFrame, west: float, north: float, res: float) -> DataFrame:
    """(region, ring, xs, ys): closed outlines of regions in degrees, corners only; ring 0 is the shell, clockwise, others are holes.

    A region's polygon is one value, so its sides are one task's work. Where a region touches itself at a corner only, the
    outline turns so that the two cells stay apart and holes that touch there become one.
    """

    def run(key, pdf):
        by_start: dict = {}
        for x1, y1, x2, y2 in zip(*(pdf[c].tolist() for c in ("x1", "y1", "x2", "y2")), strict=True):
            by_start.setdefault((x1, y1), []).append((x2, y2))
        rings = []
        while by_start:
            start = min(by_start)
            at, way, ring = start, None, []
            while True:
                options = by_start[at]
                # the interior is on the right: of two ways on, the one that turns right stays with its cell
                k = 0
                if way is not None and len(options) > 1:
                    k = max(range(len(options)), key=lambda i: way[0] * (options[i][1] - at[1]) - way[1] * (options[i][0] - at[0]))
                nxt = options.pop(k)
                if not options:
                    del by_start[at]
                step = (nxt[0] - at[0], nxt[1] - at[1])
                if step != way:
                    ring.append(at)
                at, way = nxt, step
                if at == start:
                    break
            first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1])
            if way[0] * first[1] == way[1] * first[0]:  # the start is no corner
                ring = ring[1:]
            rings.append([*ring, ring[0]])
        rings.sort(key=lambda r: -abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))))
        rows = [(key[0], k, [west + x * res for x, _ in r], [north - y * res for _, y in r]) for k, r in enumerate(rings)]
        return pd.DataFrame(rows, columns=["region", "ring", "xs", "ys"])

    return region_edges(labelled).groupBy("region").applyInPandas(run, "region long, ring int, xs array<double>, ys array<double>")
