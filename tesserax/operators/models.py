"""Clusters and habitat models over cut layers, hulls of species' points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators.triangulation import delaunay, hull, triangulated  # noqa: F401


def classify(cells: DataFrame, columns: list[str], groups: int, seed: int = 1) -> DataFrame:
    """cells with group 0..groups-1 by k-means over the standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="_v").transform(cells)
    x = StandardScaler(inputCol="_v", outputCol="_x").fit(x).transform(x)
    model = KMeans(k=groups, seed=seed, featuresCol="_x", predictionCol="group").fit(x)
    return model.transform(x).drop("_v", "_x")


def group_means(cells: DataFrame, columns: list[str]) -> DataFrame:
    return cells.groupBy("group").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def habitat(cells: DataFrame, presences: DataFrame, columns: list[str], category: str | None = None, test_share: float = 0.5, seed: int = 1) -> DataFrame:
    """(row, col, score, test): suitability of every cell from a ridge logistic model of presence cells against all cells.

    presences(row, col); a hash of the cell deals presences into training and, with probability test_share, test.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    test = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1000)) < int(1000 * test_share)
    own = cells.join(presences.select("row", "col").distinct().withColumn("present", F.lit(1.0)), ["row", "col"], "left").na.fill(0.0, ["present"]).withColumn("test", test & (F.col("present") == 1))
    steps, inputs = [], list(columns)
    if category:
        steps = [StringIndexer(inputCol=category, outputCol="_i", handleInvalid="keep"), OneHotEncoder(inputCol="_i", outputCol="_h")]
        inputs.append("_h")
    steps += [VectorAssembler(inputCols=inputs, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="present", regParam=0.01, maxIter=25)]
    model = Pipeline(stages=steps).fit(own.filter(~F.col("test")))
    return model.transform(own).select("row", "col", vector_to_array("probability")[1].alias("score"), "test")


def extent_of_occurrence(occ: DataFrame) -> DataFrame:
    """(species, points, km2): convex hull of each species' points; under three points, or points on a line, 0.

    Of a species' points on one meridian only the southernmost and northernmost count; hulls of those are made within
    partitions and of these again, so a species' group holds hull points only. Rows without a coordinate are left out; a
    species without any has no points and 0; a null species is one like others.
    """

    def partial(batches):
        for pdf in batches:
            for s, g in pdf.groupby("species", sort=False, dropna=False):
                h = hull(g[["lon", "lat"]].to_numpy())
                yield pd.DataFrame({"species": s if isinstance(s, str) else None, "lon": h[:, 0], "lat": h[:, 1]})

    def merged(key, pdf):
        h = hull(pdf[["lon", "lat"]].to_numpy())
        h = np.vstack([h, h[:1]])
        return pd.DataFrame({"species": [key[0]], "xs": [h[:, 0].tolist()], "ys": [h[:, 1].tolist()]})

    ends = placed(occ).groupBy("species", "lon").agg(F.array_distinct(F.array(F.min("lat"), F.max("lat"))).alias("ys"))
    parts = ends.select("species", "lon", F.explode("ys").alias("lat")).mapInPandas(partial, "species string, lon double, lat double")
    rings = parts.groupBy("species").applyInPandas(merged, "species string, xs array<double>, ys array<double>")
    area = F.when(F.size("xs") > 3, F.abs(geo.ring_area("xs", "ys")) / 1e6).otherwise(0.0)
    return every_species(occ, rings.select("species", (F.size("xs") - 1).alias("points"), area.alias("km2")))


def placed(occ: DataFrame) -> DataFrame:
    """(species, lon, lat) of records with both coordinates."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return occ.select("species", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter(ok("lon") & ok("lat"))


def every_species(occ: DataFrame, found: DataFrame) -> DataFrame:
    """found(species, ...) with a row of zeros for each species of occ that it lacks."""
    own = occ.select(F.col("species").alias("_s")).distinct()
    out = own.join(found, F.col("_s").eqNullSafe(F.col("species")), "left").withColumn("species", F.col("_s")).drop("_s")
    return out.na.fill(0, [c for c in found.columns if c != "species"])


def kept_triangles(occ: DataFrame, alpha: float, edges: int) -> DataFrame:
    """Rows of `triangulated` of the triangles of alpha_triangles. The mean edge of all comes before the test."""
    points = placed(occ).select("species", (F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat")).distinct()
    own = triangulated(points)
    edge = lambda a, b: F.sqrt((F.col(f"x{a}") - F.col(f"x{b}")) * (F.col(f"x{a}") - F.col(f"x{b}")) + (F.col(f"y{a}") - F.col(f"y{b}")) * (F.col(f"y{a}") - F.col(f"y{b}")))
    lengths = [edge(1, 2), edge(2, 3), edge(3, 1)]
    # an edge is of two triangles, or of one and of those around all
    twice, ends = F.coalesce(sum(lengths[1:], lengths[0]), F.col("x1")), F.when(F.col("x3").isNull(), F.col("y1")).otherwise(3.0)
    mean = own.groupBy(F.col("species").alias("_s")).agg((F.sum(twice) / F.sum(ends)).alias("mean"))
    kept = own.filter("x3 is not null").join(F.broadcast(mean), F.col("species").eqNullSafe(F.col("_s")))
    return kept.filter(F.greatest(*lengths[:edges], F.lit(0.0)) <= F.col("mean") * alpha)


def alpha_triangles(occ: DataFrame, alpha: float = 2.0, edges: int = 3) -> DataFrame:
    """(species, xs, ys): the closed triangles of a Delaunay triangulation of a species' distinct points of which the first
    `edges` edges (3: all) are at most alpha times as long as the mean edge. Points on one circle are all joined with the least of them."""
    return kept_triangles(occ, alpha, edges).select("species", F.array("x1", "x2", "x3", "x1").alias("xs"), F.array("y1", "y2", "y3", "y1").alias("ys"))


def alpha_hull(occ: DataFrame, alpha: float = 2.0, edges: int = 3) -> DataFrame:
    """(species, triangles, km2): number and area on the sphere of alpha_triangles, which make up the hull. Rows without a
    coordinate are left out; a species without a triangle has 0."""
    km2 = geo.triangle_area("x1", "y1", "x2", "y2", "x3", "y3") / 1e6
    found = kept_triangles(occ, alpha, edges).groupBy("species").agg(F.count("*").alias("triangles"), F.sum(km2).alias("km2"))
    return every_species(occ, found)


def point_radius_area(occ: DataFrame, radius: float, res: float, fine: float) -> DataFrame:
    """(species, km2): area within `radius` metres of the species' occupied cells' corners, on a lattice of `fine` degrees.

    A fine cell counts if its centre is within the radius, so the error is under a fine cell along each circle.
    """
    seeds = placed(occ).select("species", geo.snap("lon", res).alias("x"), geo.snap("lat", res).alias("y")).distinct()
    reach = radius / geo.RADIUS * 180 / 3.141592653589793
    wide = F.lit(reach) / F.cos(geo.rad("y"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / fine).cast("int"), F.floor(hi / fine).cast("int")))
    near = seeds.withColumn("r", span(F.col("y") - reach, F.col("y") + reach)).withColumn("c", span(F.col("x") - wide, F.col("x") + wide))
    centre = near.withColumns({"cx": (F.col("c") + 0.5) * fine, "cy": (F.col("r") + 0.5) * fine})
    inside = centre.filter(geo.sphere_distance("x", "y", "cx", "cy") <= radius).select("species", "r", "c", "cy").distinct()
    return inside.groupBy("species").agg(F.sum(geo.cell_area(fine, "cy")).alias("km2"))
