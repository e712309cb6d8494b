"""What several corpus operators share: tables, shared scratch tables, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserax.sources.files import qualified, store

#: ASCII white space, the word separator of every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, with its scheme, so that tasks that open files themselves
    find it where Spark does; where it is unset, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.environ.get("TESSERAX_SCRATCH") or tempfile.mkdtemp(prefix="tesserax-")
        os.environ["TESSERAX_SCRATCH"] = where
    return qualified(spark, where.rstrip("/"))


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserax/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(where: str):
    """(file system, path in it) of a folder or file below shared_dir that tasks write and read themselves."""
    return store(where)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
