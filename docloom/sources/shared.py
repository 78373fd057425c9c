"""Tables of intermediate results in the folder that executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session has none, one in
    the working directory if Spark is local, as in tests, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = os.path.join(os.getcwd(), "spark-warehouse", "shared")
    return root.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet under the shared folder, and read again."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
