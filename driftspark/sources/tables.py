"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = f"/tmp/checkpoints/{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and Spark runs on this machine alone."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (told or _OWN).rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it is made once, whoever reads it, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
