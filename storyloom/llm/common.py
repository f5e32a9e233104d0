"""Shared ground of the corpus operators: the tables of a scale factor, written intermediate tables, shipping of code.

Intermediate tables are Parquet under ``spark.checkpoint.dir``, the folder that driver and executors share.
They cut lineage and survive lost executors.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII blanks. ``bytes.split()`` splits on the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(name: str) -> None:
    """Executors get this module's functions inside the task, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode with none set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="storyloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: The folders of intermediate tables that this driver has made and not deleted.
_MADE: list[str] = []


def made() -> int:
    """A mark for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, mark: int) -> None:
    """Deletes the intermediate tables made since the mark; no result may read them any more."""
    while len(_MADE) > mark:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written intermediate tables of one call; ``drop`` frees those that no result reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}
        _MADE.append(self.folder)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> Iterator[None]:
    """What is executed inside ships texts to Python in batches of so many rows and bytes at most.

    A task holds a batch several times: as it grows and as it is sent, and in Python that one and the next. Spark's own
    bounds (10,000 rows, 64 MB) stand again afterwards; smaller bounds of the session stay.
    """
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in most}
    number = lambda x: int(x.rstrip("bB"))
    try:
        for k, n in most.items():
            old = number(before[k])
            spark.conf.set(k, n if old <= 0 else min(n, old))
        yield
    finally:
        for k, old in before.items():
            spark.conf.set(k, old)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[new], *[np.add.reduceat(c[order], new) if len(new) else c for c in counts]


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The id, the text (null: empty) and further columns, under fixed names; other columns go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in more])



def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it is counted, so that a broadcast never grows with the data unseen."""
    return df.limit(rows + 1).count() <= rows


def without_ids(docs: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """docs without the doc_ids of ``ids``: by broadcast up to ``most`` ids, by shuffle beyond. Null ids stay."""
    return docs.join(F.broadcast(ids) if fits_broadcast(ids, most) else ids, "doc_id", "left_anti")


def one_row_of_each_id(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs in which rows of one doc_id are one row: that of the smallest text (null first), then of the smallest JSON form. Rows without an id stay."""
    again = scratch.write("again", docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return docs
    row = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.coalesce(F.col("text"), F.lit("")), F.to_json(row))
    least = docs.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return without_ids(docs, again).unionByName(least)


by_value(__name__)
