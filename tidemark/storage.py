"""Where steps that many models read are written: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without one a local folder serves a local master only: executors elsewhere could not read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own()


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
