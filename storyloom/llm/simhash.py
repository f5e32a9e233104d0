"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at up to ``distance`` differing bits. Bits are grouped into parts, correlated ones
together; thresholds t_i of the parts with sum(t_i) = distance - parts + 1 (-1: part unused) are allotted by dynamic
programming on estimated candidate counts. Two fingerprints within the distance then differ in some part i by t_i or
less: each part is probed with all its flips of up to t_i bits, and what meets is verified on all 64 bits.

Copies fold into one fingerprint first. Where over ``CROWD`` fingerprints share a part's bits, pairs are not listed:
two fingerprints are within the distance exactly if their balls of half that radius share a point, so that each crowd
member is linked to the smallest member at each point of its ball. That is exact and linear in the crowd.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, one_row_of_each_id, table, text_of, without_ids
from .graph import components

BITS, SEED, CROWD = 64, 42, 32


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in over half the XXH64 hashes of the word shingles, repeats included; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    total, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    for first in range(0, n, 1 << 16):
        some = [words[first + k : min(n, first + (1 << 16)) + k] for k in range(shingle)] if len(words) >= shingle else [[w] for w in words]
        h = np.array([hashed(x, SEED) for x in map(b" ".join, zip(*some, strict=False))], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return text_of(documents).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both set: over all of them, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1), np.int64)  # the last row and column count as always set
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8"))
            for k in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    out = np.zeros((BITS + 1, BITS + 1), np.int64)
    for i, j, n in prints.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return int(out[BITS, BITS]), out[:BITS, :BITS]


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    def flips(self) -> list[int]:
        """Masks of up to ``threshold`` bits of the part, as signed longs."""
        masks = [sum(1 << b for b in some) for k in range(self.threshold + 1) for some in itertools.combinations(self.bits, k)]
        return [signed(m) for m in masks]

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of equal size, each grown around the bit most correlated with the rest by the closest ones."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        group = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        while len(group) < want:
            group.append(max((b for b in left if b not in group), key=lambda b: (close[b, group].mean(), -b)))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def candidates(n: int, p: np.ndarray, bits: list[int], threshold: int) -> float:
    """Estimated pairs that agree on the bits but for ``threshold`` of them, from how often each bit is set."""
    if threshold < 0:
        return 0.0
    chance = np.array([1.0] + [0.0] * threshold)  # of so many differing bits
    for q in 2 * p[bits] * (1 - p[bits]):
        chance = chance * (1 - q) + np.concatenate([[0], chance[:-1]]) * q
    return n * (n - 1) / 2 * float(chance.sum())


def allot(n: int, both: np.ndarray, distance: int, pair: float = 0.1) -> list[Part]:
    """The parts and thresholds of least estimated cost: a unit for each probe sent, ``pair`` for each pair verified."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[Part]] = (math.inf, [])
    for parts in range(2, distance + 2) if distance else [1]:
        groups = group_bits(n, both, parts)
        cost = lambda g, t: (n * (t > 0) * sum(math.comb(len(g), k) for k in range(t + 1)) + n + candidates(n, p, g, t) * pair) if t >= 0 else 0.0
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of t_i + 1 so far
        for g in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in plans.items():
                for t in range(-1, distance - used + 1):
                    new = (c + cost(g, t), [*ts, t])
                    if used + t + 1 not in after or new < after[used + t + 1]:
                        after[used + t + 1] = new
            plans = after
        c, ts = plans[distance + 1]  # sum of (t_i + 1) over the parts: distance + 1
        if c < best[0]:
            best = (c, [Part(tuple(g), t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def links(nodes: DataFrame, parts: list[Part], distance: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that leave the components of all links as they are."""
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(p.mask)).alias("key")) for k, p in enumerate(parts)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")
    crowded = scratch.write("crowded", keyed.groupBy("part", "key").count().where(F.col("count") > CROWD).select("part", "key"))
    none = crowded.limit(1).count() == 0
    crowd = None if none else scratch.write("crowd", keyed.join(crowded, ["part", "key"]).select("fp").distinct())
    probes = keyed if none else keyed.join(crowd, "fp", "left_anti")
    flips = F.coalesce(*[F.when(F.col("part") == k, F.array(*[F.lit(m) for m in p.flips()])) for k, p in enumerate(parts)])
    probes = probes.select(F.col("fp").alias("a"), "part", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    here = keyed.select(F.col("fp").alias("b"), "part", "key")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    if none:
        close = close & (F.col("a") < F.col("b"))
    found = probes.join(here, (probes["part"] == here["part"]) & (probes["key"] == here["key"]) & close).select("a", "b")
    if none:
        return found
    balls = [signed(sum(1 << b for b in some)) for k in range(distance // 2 + 1) for some in itertools.combinations(range(BITS), k)]
    points = crowd.select("fp", F.explode(F.transform(F.array(*[F.lit(m) for m in balls]), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # no more than the points of a ball
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return found.union(stars.distinct())


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """A row for each row of documents(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have fingerprint 0 and link like any other. A null doc_id is never a component_id,
    unless no member has an id. Repeated rows stay repeated. ``distance`` is even.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    spark = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write("prints", fingerprints(documents, shingle))
    nodes = scratch.write("nodes", prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n, both = bit_statistics(nodes)
    edges = scratch.write("edges", links(nodes, allot(n, both, distance), distance, scratch).distinct())
    if edges.limit(1).count():
        labels = components(edges, scratch)
        named = scratch.write("named", nodes.join(labels.withColumnRenamed("node", "fp"), "fp").select("fp", "label", "first"))
        smallest = scratch.write("smallest", named.groupBy("label").agg(F.min("first").alias("component_id")))
        joined = scratch.write("joined", named.join(smallest, "label").select("fp", "component_id"))
        owners = scratch.write("owners", nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    else:
        owners = nodes.withColumnRenamed("first", "component_id")
    return prints.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """documents without those that link to one of a smaller doc_id.

    Rows that share an id count as one document, of which the row with the smallest text stays. Rows without an id stay.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "simhash-keep")
    documents = one_row_of_each_id(documents, scratch)
    found = near_duplicates(documents, shingle, distance).where("doc_id IS NOT NULL AND component_id <> doc_id").select("doc_id")
    return without_ids(documents, scratch.write("gone", found))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, ties and empty tables as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


by_value(__name__)
