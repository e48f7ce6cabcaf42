"""Folders for intermediate tables that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder below the warehouse in local mode; on a cluster that is an
    error, as no folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{root.rstrip('/')}/corpusmill"


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and the files survive the loss of any executor."""
    path = new_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
