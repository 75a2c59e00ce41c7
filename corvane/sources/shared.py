"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="corvane-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table that outlives executors: cuts the lineage of iterative operators."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()  # Spark's cleaner then removes the shuffle files that nothing refers to
    return df.sparkSession.read.schema(df.schema).parquet(path)
