"""Tables in the folder that driver and executors share: what several later steps read is worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a fresh folder in local mode (tests), and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = context._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lexforge-"))
            own = context._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: a short plan, and no lost executor costs more than a read."""
    path = f"{folder(df.sparkSession)}/lexforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
