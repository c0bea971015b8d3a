"""Intermediate tables that later jobs read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where none is set and everything runs on one machine, a temporary one is made."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
        folder = tempfile.mkdtemp(prefix="waymark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder: made once, and the same for all readers."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
