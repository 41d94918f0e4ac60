"""A folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode, where that is unset, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="maxfold-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/maxfold-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a new path and read back: computed once, and its plan ends there."""
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
