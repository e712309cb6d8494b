"""Record sources: delimited occurrence files, normalisers, numbering, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserax.sources.scratch import materialise


def numbered(df: DataFrame, order: str | list, name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """df with gapless numbers in the order of a column or several: counts of ranges first, then numbers within each.

    The ranges are written with their numbers, since their sampled bounds differ from one evaluation to the next.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = order if isinstance(order, list) else [order]
    ranged = materialise(df.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_p").orderBy(*by)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_k", F.row_number().over(own)).join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(name, (F.col("_b") + F.col("_k") + (start - 1)).cast("long")).drop("_p", "_k", "_b")


def read_occurrences(spark: SparkSession, path: str, facet_field: str = "names_and_lsid", bbox: tuple | None = None, keep: Column | None = None, include_year: bool = True) -> DataFrame:
    """(lon, lat, species[, year]) of a delimited file with a header, columns found by name.

    Rows whose coordinates do not parse are dropped; a year that does not parse is 0. bbox: minx, miny, maxx, maxy.
    keep: a condition on lon and lat, such as a region test.
    """
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    out = raw.select(number("longitude").alias("lon"), number("latitude").alias("lat"), F.col(facet_field).alias("species"), *([F.coalesce(F.expr("try_cast(year as short)"), F.lit(0).cast("short")).alias("year")] if include_year else []))
    out = out.filter("lon is not null and lat is not null")
    if bbox:
        out = out.filter(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return out if keep is None else out.filter(keep)


def by_longitude(occ: DataFrame, slices: int = 360) -> DataFrame:
    """Records in longitude order over range partitions, one degree to a slice by default."""
    return occ.repartitionByRange(slices, "lon").sortWithinPartitions("lon")


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """(species, lat, lon) of tab separated, pipe quoted text (lsid, name, latitude, longitude): rows without a latitude go, the key is
    name, pipe, lsid with commas as spaces."""
    raw = spark.read.csv(path, sep="\t", quote="|", header=True)
    own = raw.filter("latitude is not null and trim(latitude) <> ''")
    key = F.translate(F.concat_ws("|", "name", "lsid"), ",", " ")
    return own.select(key.alias("species"), F.expr("try_cast(latitude as double)").alias("lat"), F.expr("try_cast(longitude as double)").alias("lon"))


def species_dictionary(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(species, species_id) and (lon, lat, point_id): both distinct and numbered from 0 in their order."""
    return numbered(occ.select("species").distinct(), "species", "species_id", 0), numbered(occ.select("lon", "lat").distinct(), ["lon", "lat"], "point_id", 0)


def with_references(occ: DataFrame) -> DataFrame:
    """occ with the numbers of its species and of its place instead of both."""
    species, points = species_dictionary(occ)
    return occ.join(species, "species").join(points, ["lon", "lat"]).drop("species", "lon", "lat")


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """df, dealt and sorted beforehand, with whether each row comes in order: after the row before it in its partition, and
    a partition's first row after all rows of the partitions before."""
    key = F.struct(*columns)
    own = materialise(df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "dealt")
    before = F.lag(key).over(Window.partitionBy("_p").orderBy("_m"))
    ends = own.groupBy("_p").agg(F.max(key).alias("_high"))
    highest = F.max("_high").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    own = own.withColumn("_before", before).join(F.broadcast(ends.select("_p", highest.alias("_highest"))), "_p")
    ok = (F.col("_before").isNull() | (F.col("_before") <= key)) & (F.col("_highest").isNull() | (F.col("_highest") <= key))
    return own.withColumn("in_order", ok).drop("_p", "_m", "_before", "_highest")


#: Header terms of occurrence uploads and the names they are known by.
TERMS = {"scientific name": "scientificName", "species": "scientificName", "lat": "decimalLatitude", "latitude": "decimalLatitude", "lon": "decimalLongitude", "lng": "decimalLongitude", "longitude": "decimalLongitude", "date": "eventDate", "year": "year"}


def ingest_upload(df: DataFrame, order: str, user_id: str, dataset: str) -> DataFrame:
    """df with headers renamed by TERMS, occurrenceID numbered in the order of a column, userId and datasetName set."""
    out = numbered(df, order, "occurrenceID")
    out = out.withColumnsRenamed({c: TERMS[c.lower()] for c in df.columns if c.lower() in TERMS})
    return out.withColumns({"userId": F.lit(user_id), "datasetName": F.lit(dataset)})


def harvest_tracks(df: DataFrame, mapping: dict[str, str], order: str, geometry: str | None = None) -> DataFrame:
    """Mapped columns (empty text as null), type `t`, spcode numbered from 5,000,000; with a geometry column (WKT), its bounding box."""
    own = df.select(order, *(F.when(F.trim(F.col(src).cast("string")) != "", F.col(src)).alias(to) for src, to in mapping.items()), *([F.col(geometry).alias("_wkt")] if geometry else []))
    if geometry:
        numbers = F.regexp_extract_all("_wkt", F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)).cast("array<double>")
        axis = lambda k: F.filter("_n", lambda v, i: i % 2 == k)
        own = own.withColumn("_n", numbers).withColumns({"minx": F.array_min(axis(0)), "miny": F.array_min(axis(1)), "maxx": F.array_max(axis(0)), "maxy": F.array_max(axis(1))}).drop("_n", "_wkt")
    return numbered(own, order, "spcode", 5_000_000).withColumn("type", F.lit("t"))


def replace_by_key(existing: DataFrame, loaded: DataFrame, key: str, order: str, geometry: str) -> DataFrame:
    """existing without the loaded keys, and the last loaded row (by order) of each key that has a geometry."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    new = loaded.filter(F.col(geometry).isNotNull()).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def article_locations(articles: DataFrame) -> DataFrame:
    """(id, lon, lat) of articles with locations, whose coordinates are coords.lon, coords.lat or longitude, latitude."""
    own = articles.filter(F.col("locations").isNotNull()).select("id", F.explode("locations").alias("p"))
    return own.select("id", F.coalesce("p.coords.lon", "p.longitude").alias("lon"), F.coalesce("p.coords.lat", "p.latitude").alias("lat"))
