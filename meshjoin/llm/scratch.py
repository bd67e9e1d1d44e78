"""Shared-folder scratch tables that cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in single-process local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="meshjoin-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Names tables of one run under the shared folder, writes them as Parquet and rereads them.

    A table is written once and every consumer reads the same rows, so ids drawn while writing stay
    stable and a lost executor costs the rerun of single tasks only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.kept: list[str] = []
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        self.kept.append(name)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no lazy frame will read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does on garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()
