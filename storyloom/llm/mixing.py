"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated chances.

Tokens are summed by cell (source, language, topic). The driver holds the observed cells as a sparse list, not their
product, so that every category keeps its own share, however many there are. The weights are raked
in turn to the target shares of each dimension; each document stays with the chance of its cell, decided by a hash of
its id: a document's fate depends on nothing else, and repeated runs agree.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DIMENSIONS = ("source", "lang", "topic")
BROADCAST = 500_000  #: cells that are sent to all tasks; more are joined by a shuffle
TEMPER, BUDGET, SEED = 0.7, 0.6, 20241


def topic_of(text: Column) -> Column:
    """A topic by plain marks of the text, the first that holds; another column can be given in its place."""
    has = lambda *marks: reduce(or_, [F.contains(text, F.lit(m)) for m in marks])
    marks = [
        ("noise", has("%%%", "$$$")),
        ("table", has(" | ", "\t")),
        ("code", has("();", "def ", "{\n")),
        ("numbers", text.rlike(r"^[0-9\s.,;:/-]+$")),
        ("licensed", has("licens", "Licens", "copyright", "Copyright", "lizenz", "Lizenz", "licencia", "Licencia")),
        ("contact", has("@") & text.rlike(r"[A-Za-z0-9._]@[A-Za-z0-9]+\.[A-Za-z]")),
        ("web", has("://", "www.")),
        ("dialogue", has("“", "«", "„")),
        ("list", has("\n- ", "\n* ")),
        ("short", F.length(text) < 300),
    ]
    out = F.lit("prose")
    for name, holds in reversed(marks):
        out = F.when(holds, name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rake(tokens: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """``rake_cells`` of all cells of a table: tokens has an axis for each dimension."""
    weights, chance = rake_cells(tokens.ravel(), list(np.indices(tokens.shape).reshape(tokens.ndim, -1)), targets, budget, rounds)
    return weights.reshape(tokens.shape), chance.reshape(tokens.shape)


def rake_cells(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Weights of cells and chances of documents.

    tokens: of each cell; places: for each dimension the cells' categories; targets: shares of each dimension's
    categories, of which those of empty categories are dealt to the others. Weights are raked to the shares of one
    dimension after the other until all hold, and keep the sum of tokens. The chances are the weights times the largest
    factor for which no more than budget * sum(tokens) tokens are expected and no chance passes 1.
    """
    total = tokens.sum()
    weights = np.ones(len(tokens))
    if total == 0:
        return weights, weights * budget
    full = []
    for place, share in zip(places, targets, strict=True):
        held = np.bincount(place, tokens, len(share)) > 0
        share = np.where(held, share, 0)
        full.append(share / share.sum() if share.sum() else held / held.sum())
    for _ in range(rounds):
        for place, share in zip(places, full, strict=True):
            have = np.bincount(place, tokens * weights, len(share))
            weights = weights * np.where(have > 0, share * total / np.where(have > 0, have, 1), 1)[place]
        if max(residuals(tokens * weights, places, full)) < 1e-9:
            break
    most = weights[tokens > 0].max(initial=0)
    return weights, np.minimum(weights * min(budget, 1 / most if most else 1), 1)


def tempered_targets(tokens: np.ndarray, places: list[np.ndarray], given: list[np.ndarray | None], sizes: list[int], temper: float, budget: float, steps: int = 12) -> list[np.ndarray]:
    """Shares for each dimension: the given ones; else the own ones, moved towards their power ``temper`` as far as the budget allows.

    That is as far as no cell's weight times the budget passes 1, found by bisection to a part of 2^-steps.
    """
    own = [np.bincount(p, tokens, n) / max(tokens.sum(), 1e-300) for p, n in zip(places, sizes, strict=True)]
    aims = [x**temper / max((x**temper).sum(), 1e-300) for x in own]
    at = lambda part: [g if g is not None else (1 - part) * x + part * a for g, x, a in zip(given, own, aims, strict=True)]

    def fits(part: float) -> bool:
        return rake_cells(tokens, places, at(part), budget, 300)[0][tokens > 0].max(initial=0) * budget <= 1

    low, high = 0.0, 1.0
    if all(g is not None for g in given) or fits(1.0):
        return at(1.0)
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return at(low)


def residuals(tokens: np.ndarray, places: list[np.ndarray], shares: list[np.ndarray]) -> list[float]:
    """For each dimension the largest difference between a category's share of tokens and the wanted one."""
    return [float(np.abs(np.bincount(place, tokens, len(share)) / max(tokens.sum(), 1e-300) - share).max(initial=0)) for place, share in zip(places, shares, strict=True)]


def mixed(documents: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: int = SEED, topic: Column | None = None) -> DataFrame:
    """For each row of documents: doc (its columns), source, lang, topic, n_tokens, weight, chance, residual and kept.

    documents(doc_id, text, source, lang). targets: wanted shares of tokens for each dimension, for which the budget gives
    way; a dimension that is not given gets its own shares, moved towards their power ``temper``, which lifts small
    categories, as far as the budget allows. Null or empty text: no tokens.
    A null category is the empty one. Rows that share an id share their fate within a cell; null ids count as one id.
    residual: by how much the expected share of any category misses the wanted one, at most: 0 unless the observed cells
    can't meet all marginals at once. Columns of documents stay in ``doc``, whatever their names.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.struct("*").alias("doc"), F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(topic if topic is not None else topic_of(text), F.lit("")).alias("topic"), token_count(text).alias("n_tokens"))
    scratch = Scratch(spark, "mixing")
    rows = scratch.write("rows", rows)  # topics and tokens are told once, not for the sums and again for the rows
    sums = scratch.write("cells", rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    cells = sums.orderBy(*DIMENSIONS).toArrow()
    tokens, places, given, sizes = cells["tokens"].to_numpy().astype(float), [], [], []
    for d in DIMENSIONS:
        coded = cells[d].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        places.append(coded.indices.to_numpy().astype(np.int64))
        sizes.append(len(names))
        given.append(np.array([targets[d].get(x, 0.0) for x in names]) if targets and d in targets else None)
    wanted = tempered_targets(tokens, places, given, sizes, temper, budget)
    weights, chances = rake_cells(tokens, places, wanted, budget)
    held = [np.where(np.bincount(p, tokens, len(w)) > 0, w, 0) for p, w in zip(places, wanted, strict=True)]
    missed = max(residuals(tokens * chances, places, [w / max(w.sum(), 1e-300) for w in held]), default=0.0)
    known = spark.createDataFrame(pa.table({**{d: cells[d] for d in DIMENSIONS}, "weight": weights, "chance": chances}))
    rows = rows.join(F.broadcast(known) if len(tokens) <= BROADCAST else known, list(DIMENSIONS), "left").select("doc", "doc_id", *DIMENSIONS, "n_tokens", "weight", "chance", F.lit(missed).alias("residual"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.withColumn("kept", draw < F.col("chance"))


def sample(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; see ``mixed`` for nulls, ties and repeated rows."""
    return mixed(documents).where("kept").select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, repeated rows and empty tables as in ``mixed``."""
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("chance", 9).alias("probability"), F.round("residual", 6).alias("residual"), "kept")
