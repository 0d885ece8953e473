"""The folder that driver and executors share for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, only a local master gets a temporary one; a cluster's machines share no such folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = getattr(spark.sparkContext, "_plumbline_dir", None)
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext._plumbline_dir = own
    return own


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read again: computed once, in the same order for whatever reads it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
