"""Folders for what queries write: in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):  # executors would each write to their own disk
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
