"""A table of computed vectors that knows what they were computed from.

Rows are (key, signature, made_at, value); a row is valid if its signature is that of what would be computed now. Rows
are only ever added; the newest of a key counts, and ``compacted`` drops the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(*parts: Column) -> Column:
    """SHA-256 over what a value depends on, each part with its length, so that no two lists of parts read alike; null is a part of its own."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]), 256)


class Cache:
    """A folder of Parquet files, a new one for each update; ``schema`` is that of the values."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = "array<float>"):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"key string, signature string, made_at timestamp, value {schema}"

    def rows(self) -> DataFrame:
        """All rows of this moment. Each update is read by its own name: Spark takes two reads of one folder for the same, whatever it held at the time."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = sorted(f.getPath().toString() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*held)

    def newest(self) -> DataFrame:
        """One row for each key: the last made; ties: the greatest signature."""
        row = F.struct("key", "signature", "made_at", "value")
        return self.rows().groupBy("key").agg(F.max_by(row, F.struct("made_at", "signature")).alias("r")).select("r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted(key, signature, ...) that have no valid value. Rows without a key are never held."""
        return wanted.join(self.newest().select("key", "signature"), ["key", "signature"], "left_anti")

    def valid(self, wanted: DataFrame) -> DataFrame:
        """wanted(key, signature, ...) with value, where it is valid."""
        return wanted.join(self.newest().select("key", "signature", "value"), ["key", "signature"])

    def add(self, made: DataFrame) -> None:
        """made(key, signature, value); written under a name of its own, so that a failed update leaves nothing."""
        made.select(F.col("key").cast("string"), "signature", F.current_timestamp().alias("made_at"), "value").write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def filled(self, wanted: DataFrame, compute) -> DataFrame:
        """wanted with values; only those missing go through ``compute(rows) -> rows(key, signature, value)``."""
        self.add(compute(self.missing(wanted)))
        return self.valid(wanted)

    def compacted(self, folder: str) -> Cache:
        """The newest rows alone, in another folder."""
        out = Cache(self.spark, folder, self.schema.split("value ", 1)[1])
        self.newest().write.parquet(f"{out.folder}/{uuid.uuid4().hex}")
        return out
