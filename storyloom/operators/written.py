"""Intermediate tables of iterative operators: Parquet under ``spark.checkpoint.dir``, the folder that driver and executors share.

They cut lineage and survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only in local mode with none set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="storyloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Tables:
    """Tables of one call, by name; writing a name again makes a new table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{folder_of(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
            if path is not None:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
