"""Folders of grids as one, ASCII grids, samples of grids, and columns coded as numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserax.sources.grid_source import read_grids
from tesserax.sources.headers import parse_header
from tesserax.sources.records import numbered

def read_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A directory of grids of one resolution as one: cells(row, col, lon, lat, value) and one row of its extent, resolution, size and least
    and greatest value. A place in several tiles has the value of the first, by name, that holds it."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    raw = spark.read.format("binaryFile").load(f"{path}/*.grd").select(name.alias("layer"), F.col("content").cast("string").alias("header"))

    @F.pandas_udf("struct<minx: double, maxy: double, res: double, rows: int, cols: int>")
    def parsed(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: parse_header(t)[k] for k in ("minx", "maxy", "res", "rows", "cols")} for t in text])

    h = raw.select("layer", parsed("header").alias("h")).select("layer", "h.*")
    whole = h.agg(F.min("minx").alias("minx"), F.max("maxy").alias("maxy"), F.max(F.col("minx") + F.col("cols") * F.col("res")).alias("maxx"), F.min(F.col("maxy") - F.col("rows") * F.col("res")).alias("miny"), F.min("res").alias("res"))
    whole = whole.withColumns({"rows": F.round((F.col("maxy") - F.col("miny")) / F.col("res")).cast("int"), "cols": F.round((F.col("maxx") - F.col("minx")) / F.col("res")).cast("int")})
    own = read_grids(spark, path).crossJoin(F.broadcast(whole.select(F.col("minx").alias("_x"), F.col("maxy").alias("_y"), F.col("res").alias("_r"))))  # one row
    own = own.withColumns({"row": F.floor((F.col("_y") - F.col("lat")) / F.col("_r")).cast("int"), "col": F.floor((F.col("lon") - F.col("_x")) / F.col("_r")).cast("int")})
    cells = own.groupBy("row", "col").agg(F.min_by(F.struct("lon", "lat", "value"), "layer").alias("c")).select("row", "col", "c.*")
    return cells, whole.join(F.broadcast(cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))))


def sampled(cells: DataFrame, extent: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, value) of a collection at the centres of rows x cols equal parts of its extent (one row, as read_tiles gives it)."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = extent.withColumn("r", spread(rows)).withColumn("c", spread(cols))
    at = at.select("r", "c", F.floor((F.col("r") + 0.5) / rows * F.col("rows")).cast("int").alias("row"), F.floor((F.col("c") + 0.5) / cols * F.col("cols")).cast("int").alias("col"))
    return at.join(cells.select("row", "col", "value"), ["row", "col"]).select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def ascii_grid(cells: DataFrame, rows: int, cols: int, minx: float, miny: float, res: float, nodata: str = "-9999") -> DataFrame:
    """(at, value): an ASCII grid's header lines and rows from the north, in the order of `at`; whole numbers without a point."""
    spine = cells.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"))
    text = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    by_col = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", text.alias("t")))).alias("m"))
    full = spine.join(by_col, "row", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata))), " ")
    head = [f"ncols {cols}", f"nrows {rows}", f"xllcorner {minx}", f"yllcorner {miny}", f"cellsize {res}", f"NODATA_value {nodata}"]
    top = cells.sparkSession.createDataFrame([(k - len(head), t) for k, t in enumerate(head)], "at int, value string")
    return top.unionByName(full.select(F.col("row").alias("at"), line.alias("value")))


def decimated(cells: DataFrame, every: int) -> DataFrame:
    """Each `every`-th cell of a grid, both ways."""
    return cells.filter((F.col("row") % every == 0) & (F.col("col") % every == 0))


def coded(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df with a column's values as numbers from 0 in their order, null as null; and the dictionary (code, value)."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    codes = numbered(values, "value", "code", 0).select("code", "value")
    own = codes.select(F.col("value").alias("_value"), F.col("code").cast("int").alias("_code"))
    kept = [F.col("_code").alias(c) if c == column else F.col(c) for c in df.columns]
    return df.join(own, df[column] == own._value, "left").select(*kept), codes
