"""Checkpoints: results that are used several times are written once to the shared folder, and plans start anew from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written by a reliable checkpoint to the folder that spark.checkpoint.dir names; a temporary one only in single-process local mode."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="meshjoin-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
