"""The shared working folder and the one way this library cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share (``spark.checkpoint.dir``)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{configured.rstrip('/')}/geoscore/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application stored, once no result still reads them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store_once(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches must see one and the same evaluation (a sampled range split) or where a loop
    would grow the plan. The table outlives lost executors; :func:`clear_scratch` removes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
