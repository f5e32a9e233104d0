"""Snapshots of a project's files: which are kept, which files changed, and copies that share unchanged ones."""

from __future__ import annotations

import hashlib
import os
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED = (".storyloom_backups", ".git", "__pycache__", "node_modules")
STAMP = "yyyyMMdd-HHmmss"


def excluded(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in names]))


def retained(snapshots: DataFrame, now: Column) -> DataFrame:
    """snapshots(name) with keep: all of the last 4 hours, the last of each hour of the last 24, the last of each day before; names without a time stay."""
    at = F.try_to_timestamp(F.substring("name", 1, 15), F.lit(STAMP))
    rows = snapshots.withColumn("__at", at).withColumn("__age", now.cast("timestamp").cast("double") - F.col("__at").cast("double"))
    bucket = F.when(F.col("__age") <= 86_400, F.date_format("__at", "yyyyMMddHH")).otherwise(F.date_format("__at", "yyyyMMdd"))
    # Only those over 4 hours old compete for a bucket.
    old = F.coalesce(F.col("__age") > 14_400, F.lit(False))
    w = Window.partitionBy("__old", "__bucket").orderBy(F.desc("name"))
    ranked = rows.withColumn("__old", old).withColumn("__bucket", F.when(old, bucket)).withColumn("__rank", F.row_number().over(w))
    return ranked.withColumn("keep", ~F.col("__old") | (F.col("__rank") == 1)).drop("__at", "__age", "__old", "__bucket", "__rank")


def last_snapshot(snapshots: DataFrame) -> DataFrame:
    """(name): the greatest name."""
    return snapshots.agg(F.max("name").alias("name"))


def changes(files: DataFrame, before: DataFrame) -> DataFrame:
    """files(path, size, changed, digest) with unchanged: of one size in both, and of one time or digest; excluded paths are left out."""
    old = before.select("path", F.col("size").alias("__size"), F.col("changed").alias("__changed"), F.col("digest").alias("__digest"))
    same = (F.col("size") == F.col("__size")) & ((F.col("changed") == F.col("__changed")) | (F.col("digest") == F.col("__digest")))
    return files.where(~excluded(F.col("path"))).join(old, "path", "left").withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("__size", "__changed", "__digest")


def digest(path: Path) -> str:
    h = hashlib.blake2b(digest_size=16)
    with path.open("rb") as f:
        while some := f.read(1 << 20):
            h.update(some)
    return h.hexdigest()


class Snapshots:
    """Snapshots of a local project folder; unchanged files are hard links to the last one."""

    def __init__(self, root: str, folder: str | None = None):
        self.root = Path(root)
        self.folder = Path(folder) if folder else self.root / EXCLUDED[0]

    def names(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if p.is_dir()) if self.folder.exists() else []

    def take(self, label: str = "", now: datetime | None = None) -> Path:
        before = self.names()
        old = self.folder / before[-1] if before else None
        name = f"{(now or datetime.now()):%Y%m%d-%H%M%S}_{label.replace('/', '_').replace(chr(92), '_')}_{os.getpid()}"
        new = self.folder / name
        for source in sorted(p for p in self.root.rglob("*") if p.is_file()):
            at = source.relative_to(self.root)
            if set(at.parts) & set(EXCLUDED) or self.folder in source.parents:
                continue
            target, last = new / at, old / at if old else None
            target.parent.mkdir(parents=True, exist_ok=True)
            if last is not None and last.exists() and self._same(source, last):
                try:
                    os.link(last, target)
                    continue
                except OSError:
                    pass
            shutil.copy2(source, target)
        return new

    @staticmethod
    def _same(a: Path, b: Path) -> bool:
        x, y = a.stat(), b.stat()
        return x.st_size == y.st_size and (x.st_mtime_ns == y.st_mtime_ns or digest(a) == digest(b))

    def prune(self, spark, now: datetime | None = None) -> list[str]:
        """Deletes what ``retained`` does not keep; the deleted names."""
        rows = spark.createDataFrame([(n,) for n in self.names()], "name string")
        gone = [r.name for r in retained(rows, F.lit(f"{now or datetime.now():%Y-%m-%d %H:%M:%S}").cast("timestamp")).where("NOT keep").collect()]
        for n in gone:
            shutil.rmtree(self.folder / n, ignore_errors=True)
        return sorted(gone)
