"""Greedy batching by a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import folded


def token_batches(rows: DataFrame, budget: int) -> DataFrame:
    """(key, pos, batch): rows(key, pos, tokens) in order; a batch is closed when the next row would pass the budget.

    A row over the budget stands alone. The fold passes over sorted rows and holds two numbers of a key.
    """

    def step():
        batch, used = [0], [0]

        def fold(key, row):
            if row is None:
                return
            if used[0] > 0 and used[0] + row["tokens"] > budget:
                batch[0], used[0] = batch[0] + 1, 0
            used[0] += row["tokens"]
            yield (key, row["id"], batch[0])

        return fold

    named = rows.select("key", F.col("pos").cast("long").alias("id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    return folded(named, ["id", "tokens"], step, f"key {dict(rows.dtypes)['key']}, pos long, batch int")


def batch_totals(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, batch, n, tokens) of batches(key, pos, batch) over rows(key, pos, tokens)."""
    return batches.join(rows.select("key", "pos", "tokens"), ["key", "pos"]).groupBy("key", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
