"""Nearest neighbours of many queries: exact, or by an inverted-list index with measured recall.

Rows are (id, v, ...), queries (id, v); similarity is the cosine at nine digits, ties go to the smallest id. Null, empty
and zero vectors take no part. Repeated ids are rows of their own among the rows, and one query among the queries (the
smallest vector).

A search is a join of blocks: rows of a list in blocks of up to CHUNK, the queries that look into the list in blocks of
up to CHUNK, each pair a matrix product that tells the k best of its rows for each of its queries; the best of these
follow by query. A list that holds most of the rows is just many blocks. The exact search is one of a single list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, norm
from .search import matches
from .vectors import against, over_norm
from .written import Tables

CHUNK, SAMPLE, ASKED, ROUNDS = 4096, 20_000, 256, 15


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("v").isNotNull() & (F.coalesce(norm(F.col("v")), F.lit(0.0)) > 0))


def packed(rows: DataFrame, name: str, sizes: DataFrame) -> DataFrame:
    """(list, <name>_chunk, <name>_ids, <name>_data): unit vectors of rows(list, id, v) in blocks, each of CHUNK rows on average."""
    chunk = F.pmod(F.xxhash64("id", "v"), F.col(f"{name}_chunks")).cast("int").alias(f"{name}_chunk")
    dealt = rows.join(sizes, "list").select("list", chunk, F.col("id").cast("long").alias("id"), l2_normalize(F.col("v")).alias("v"))
    return dealt.groupBy("list", f"{name}_chunk").agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_data"))


def chunks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(f"{name}_chunks"))


def best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row of sims, ties by id."""
    order = np.argsort(ids, kind="stable")
    at = np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]
    return order[at]


def search_lists(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, sim): the k best of rows(list, id, v) for each of asked(list, id, v), over the lists that it is asked in."""
    row_sizes, asked_sizes = chunks(rows, "row"), chunks(asked, "ask")
    questions = packed(asked, "ask", asked_sizes).join(row_sizes, "list").withColumn("row_chunk", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)))
    pairs = questions.join(packed(rows, "row", row_sizes), ["list", "row_chunk"]).select("ask_ids", "ask_data", "row_ids", "row_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q, x, ids, y = (batch.column(c)[r].values.to_numpy() for c in range(4))
                sims = (x.reshape(len(q), -1) @ y.reshape(len(ids), -1).T).round(9)
                at = best(sims, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, at.shape[1])), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(sims, at, 1).ravel())], ["query", "id", "sim"])

    found = pairs.mapInArrow(run, "query long, id long, sim double")
    top = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "id"))), 1, k).alias("top"))
    return top.select("query", F.explode("top").alias("t")).select("query", F.col("t.id").alias("id"), (-F.col("t.far")).alias("sim"))


def questions_of(queries: DataFrame) -> DataFrame:
    return sound(queries).groupBy("id").agg(F.min("v").alias("v"))


def exact_search(rows: DataFrame, queries: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
    """(query, id, sim): the k rows of greatest cosine for each query among those that match the filters."""
    one = lambda df: df.withColumn("list", F.lit(0))
    return search_lists(one(sound(rows.where(matches(filters or {})))), one(questions_of(queries)), k)


def trained(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where((np.bincount(own, minlength=lists) > 0)[:, None], over_norm(total), c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest lists hold this share of the k nearest sampled rows, of up to ASKED of them.

    The whole table's neighbours are closer than the sample's, so that they lie in the nearest lists more often.
    """
    q = x[: min(ASKED, len(x))]
    near = best(q @ x.T, np.arange(len(x)), k)
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    own = (x @ c.T).argmax(1)
    ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


@dataclass
class Index:
    """rows(list, id, v, ...), every row in the list of its nearest centroid; centroids(label, n, c); probes: lists that a query looks into."""

    rows: DataFrame
    centers: DataFrame
    probes: int

    def save(self, folder: str) -> None:
        """Parquet: rows sorted by list in each file, so that a reader of few lists skips the rest."""
        self.rows.repartitionByRange("list", "id").sortWithinPartitions("list").write.parquet(f"{folder}/rows")
        self.centers.withColumn("probes", F.lit(self.probes)).write.parquet(f"{folder}/centers")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        centers = spark.read.parquet(f"{folder}/centers")
        first = centers.select("probes").first()
        return Index(spark.read.parquet(f"{folder}/rows"), centers.drop("probes"), first.probes if first else 1)

    def add(self, rows: DataFrame) -> Index:
        """The index with more rows, under the centroids that it has."""
        return Index(self.rows.unionByName(listed(rows, self.centers, 1), allowMissingColumns=True), self.centers, self.probes)

    def search(self, queries: DataFrame, k: int = 10, filters: dict | None = None, probes: int | None = None) -> DataFrame:
        """(query, id, sim): the k best of the rows that match the filters, in the lists nearest to each query."""
        asked = listed(questions_of(queries), self.centers, probes or self.probes)
        return search_lists(self.rows.where(matches(filters or {})), asked, k)


def listed(rows: DataFrame, centers: DataFrame, probes: int) -> DataFrame:
    """rows(id, v, ...) with ``list``, once for each of the nearest lists. Sound rows only."""

    def tell(x, _, labels, n, c):
        order = np.argsort(labels, kind="stable")
        sims = (x @ c[order].T).round(9)
        at = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        ends = pa.array(np.arange(len(x) + 1) * at.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, -np.take_along_axis(sims, at, 1).ravel()), pa.ListArray.from_arrays(ends, labels[order][at].ravel().astype(np.int64))

    keyed = sound(rows).withColumn("vector", F.xxhash64("v"))
    each = keyed.select(F.col("id").cast("long").alias("id"), F.col("vector").alias("label"), "v").dropDuplicates(["id", "label"])
    near, whole = against(each, centers, tell, "far array<double>, list array<bigint>")
    near = near.withColumn("lists", F.arrays_zip("far", "list"))
    if not whole:
        near = near.groupBy("part", "place", "id", "label").agg(F.slice(F.array_sort(F.flatten(F.collect_list("lists"))), 1, probes).alias("lists"))
    near = near.select("id", F.col("label").alias("vector"), F.explode("lists.list").alias("list"))
    return keyed.join(near, ["id", "vector"]).drop("vector")


def build(rows: DataFrame, lists: int | None = None, recall: float = 0.95, k: int = 10) -> Index:
    """An index of all rows(id, v, ...).

    Centroids are fitted on a bounded sample, the SAMPLE rows of smallest hash of their id. lists: the root of the number
    of rows unless given, at most a quarter of the sample. probes: what the sample needs for ``recall``.
    """
    spark, found = rows.sparkSession, sound(rows)
    some = found.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow()  # partial top-k in every task
    if not some.num_rows:
        return Index(found.withColumn("list", F.lit(0).cast("long")), spark.createDataFrame([], "label long, n double, c array<double>"), 1)
    x = over_norm(np.array(some["v"].to_pylist(), float))
    lists = max(1, min(lists or round(found.count() ** 0.5), -(-len(x) // 4)))
    c = trained(x, lists)
    centers = spark.createDataFrame([(i, 1.0, v) for i, v in enumerate(c.tolist())], "label long, n double, c array<double>")
    return Index(Tables(spark, "index").write("rows", listed(found, centers, 1)), centers, probes_needed(x, c, k, recall))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of exact(query, id, sim) that found(query, id, sim) holds, or rows as near as its farthest."""
    worst = exact.groupBy("query").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    held = found.join(worst, "query").where(F.col("sim") >= F.col("least")).groupBy("query").agg(F.count("*").alias("held"))
    both = worst.join(held, "query", "left")
    return both.agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("held", F.lit(0)), F.col("n"))) / F.sum("n")).alias("recall"))
