"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tesserax.sources.files import qualified


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path, with its scheme, below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = os.environ.get("TESSERAX_SHARED") or tempfile.mkdtemp(prefix="tesserax-")
        os.environ["TESSERAX_SHARED"] = top
    return qualified(spark, f"{top.rstrip('/')}/tesserax/{uuid.uuid4().hex}/{name}")


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet and read back: its lineage ends, and no executor holds the only copy."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
