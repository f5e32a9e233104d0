"""Embedding whitening: covariance by MLlib's RowMatrix over exactly centred rows, components from a local eigh.

An entry c becomes the integer x = floor(1024 c) + 100000, so that sums and deviations are exact. Rows are centred in
integers, (n x - S) / n, before anything is multiplied; ``RowMatrix.computeGramianMatrix`` adds up their products over
the cluster, and only the width x width matrix reaches the driver. The components go to the tasks as a broadcast of
width x ``components`` doubles.

What takes no part: rows whose vector is null, empty, or holds a null, a NaN, an infinity or an entry of 2^38 and more
(a long can't hold their exact deviations). If vectors have several widths, those of the most frequent one are kept
(ties: the smaller). Null ids and repeated rows stay as they are. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, table

SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 38)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows that take part, with their entries as integers; x is an array of longs."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def exact_sums(rows: DataFrame) -> tuple[int, int, list[int], int]:
    """(width, n, sum of each dimension, greatest absolute entry) of the kept width. Each task sends a row for each width that it met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            for width in np.unique(sizes).tolist():
                some = x if (sizes == width).all() else x.filter(pa.array(sizes == width))
                m = some.flatten().to_numpy().reshape(-1, width)
                mine = held.setdefault(width, [0, [0] * width, 0])
                mine[0] += len(m)
                for low in range(0, len(m), 1 << 14):  # 2^14 entries under 2^49 fit a long
                    mine[1] = [a + b for a, b in zip(mine[1], m[low : low + (1 << 14)].sum(0).tolist(), strict=True)]
                mine[2] = max(mine[2], int(np.abs(m).max()))
        for width, (n, sums, most) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([n]), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))), pa.array([most])], ["width", "n", "sums", "most"])

    parts = rows.select("x").mapInArrow(add, "width long, n long, sums array<decimal(38,0)>, most long")
    each = parts.select("width", "n", "most", F.posexplode("sums").alias("i", "s"))
    places = each.groupBy("width", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most"))
    widths = places.groupBy("width").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
    found = widths.orderBy(F.desc("n"), "width").limit(1).collect()
    if not found:
        return 0, 0, [], 0
    return found[0].width, found[0].n, [int(s.s) for s in found[0].sums], found[0].most


@dataclass
class Whitening:
    """n, sums and trace of the fit list, and its components: eigenvectors as columns, with their eigenvalues."""

    n: int
    sums: list[int]
    most: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def flat(self) -> np.ndarray:
        """Which components have no variance but rounding: nothing can be whitened by them."""
        return self.values <= self.trace * self.width * np.finfo(float).eps


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of rows(id, x); None if there are none."""
    width, n, sums, most = exact_sums(rows)
    if not n:
        return None
    kind = "long" if n * most < 1 << 61 else "decimal(38,0)"  # n x - S is exact in either
    total = F.array(*[F.lit(Decimal(s) if kind != "long" else s).cast(kind) for s in sums])
    away = F.zip_with("x", total, lambda x, s: (F.lit(n).cast("long") * x.cast(kind) - s).cast("double") / float(n))
    centred = rows.where(F.size("x") == width).select(array_to_vector(away).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, width).computeGramianMatrix().toArray()
    v = (gram + gram.T) / (2 * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, most, float(np.trace(v)), np.maximum(values[order], 0.0), vectors[:, order])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of rows(id, x) of the model's width.

    deviation is exact: the sum over dimensions of (n x - S)^2; null if a long can't hold it. whitened has a number for
    each component, null for one without variance.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Whitening = held.value
        small = m.n * m.most < 1 << 61
        turn = m.vectors / np.sqrt(np.where(m.flat, 1.0, m.values))
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            away = m.n * x - np.array(m.sums, np.int64) if small else m.n * x.astype(object) - np.array(m.sums, object)
            if small and float(np.abs(away).max()) ** 2 * m.width < 2.0**62:
                deviation = (away * away).sum(1)
            else:
                exact = away.astype(object)
                deviation = np.array([d if d < 1 << 63 else None for d in (exact * exact).sum(1)], object)
            w = (away.astype(float) / m.n) @ turn
            told = [[None if f else y for y, f in zip(row, m.flat, strict=True)] for row in w.tolist()] if m.flat.any() else list(w)
            yield pd.DataFrame({"id": frame["id"], "deviation": pd.array(deviation, "Int64"), "whitened": told})

    kind = dict(rows.dtypes)["id"]
    return rows.where(F.size("x") == model.width).mapInPandas(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n, centred) minus the identity, over components with variance."""
    places = np.flatnonzero(~model.flat).tolist()
    if not places:
        return 0.0
    w = lambda k: F.get("whitened", F.lit(k))
    told = whitened.agg(*[(F.covar_pop(w(i), w(j)) - float(i == j)).alias(f"c{i}_{j}") for i in places for j in places if i <= j]).first()
    return max(abs(x) for x in told)


def whitened_rows(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Without rows that take part the result is empty. Fewer dimensions than ``components`` give as many components. Where
    all vectors are equal nothing is whitened: whitened is null, explained 0 and identity_error 0.
    """
    spark = rows.sparkSession
    found = integer_vectors(rows, id_col, vector_col)
    kind = dict(found.dtypes)["id"]
    model = fit(found, components)
    if model is None:
        return spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    told = Scratch(spark, "whitening").write("whitened", whiten(found, model))
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values])
    each = told.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(id_col, (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(float(identity_error(told, model))).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` whitened by up to eight components; nulls, ties and empty tables as in ``whitened_rows``."""
    return whitened_rows(table(spark, sf_dir, "embeddings"))


by_value(__name__)
