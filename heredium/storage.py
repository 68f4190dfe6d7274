"""Cutting lineage through a written table in the session's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where the session names none, a local one in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-heredium-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet: later steps reuse them, prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/heredium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
