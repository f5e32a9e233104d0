"""Merkle manifest of a data set: trees of three children by combineByKey, proofs by links back from the root.

A leaf is the SHA-256 of a document's fields. Each source is a tree over its leaves in ascending doc_id; the sources'
subroots are the leaves of one more tree, whose root names the data set. A run of three consecutive nodes (the last run:
fewer) has as parent the SHA-256 of their digests as hex text.

Up: nodes are combined by the key (tree, block), a block being BLOCK = 3^8 consecutive nodes. A combiner holds the
digests that have come in, by level and place. As soon as a parent has as many children as the size of its level gives
it, it is told, and counts as a child of its own parent, so that a task closes all that it can before the shuffle, and
only the open frontiers of its blocks meet others' there. Roots of blocks are the next round's nodes. Down: a block
keeps its nodes; with the proof of its root, told in the round above, it gives the proofs of all its nodes.

Rows of one source and doc_id stand in the order of their leaves; identical ones are leaves of their own. A null source
is a tree of its own, before all others; null doc_ids come first. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, table

ARITY, LEVELS = 3, 8
BLOCK, ROWS = ARITY**LEVELS, 1 << 18
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "tree long, block long, n long, is_root boolean, digest binary, nodes binary, doc_ids binary, null_ids binary, has_altered binary, altered binary"
PROOFS = "doc_id long, leaf string, altered string, place long, size long, tree long, trees long, subroot string, proof string"


def field(c: Column) -> Column:
    """A field as its UTF-8 length, a colon and its value; null: a hyphen."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, altered: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, altered): digests as 32 bytes. altered: (condition, text) tells which rows' text to replace; else null.

    The columns are, in this order, the id, the source, further fields, and the text.
    """
    head = [field(F.col(c)) for c in columns[:-1]]
    digest = lambda text: F.unhex(F.sha2(F.concat(*head, field(text)).cast("binary"), 256))
    other = F.when(altered[0], digest(altered[1])) if altered else F.lit(None).cast("binary")
    return documents.select(F.col(columns[0]).cast("long").alias("doc_id"), F.col(columns[1]).cast("string").alias("source"), digest(F.col(columns[-1])).alias("leaf"), other.alias("altered"))


def placed_leaves(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``leaves`` with tree (their source's number in order), place in it and n, its size. No window: ranges and prefix sums.

    Equal rows may be many; a number of their own spreads them over ranges. Each range tells one row about its first and
    last source to the driver, which adds them up.
    """
    spark = found.sparkSession
    plain = scratch.write("leaves", found.withColumn("twin", F.monotonically_increasing_id()))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("twin").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plain.count() // ROWS))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        some = pa.Table.from_batches(held)
        n = some.num_rows
        codes = some["source"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[:n])
        sizes = np.diff(np.append(new, n))
        d = np.repeat(np.arange(len(new)), sizes)
        out = some.append_column("part", pa.array(np.full(n, TaskContext.get().partitionId()), pa.int64()))
        out = out.append_column("d", pa.array(d, pa.int64())).append_column("k", pa.array(np.arange(n) - new[d], pa.int64())).append_column("m", pa.array(sizes[d], pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    schema = "doc_id long, source string, leaf binary, altered binary"
    ranged = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("twin")
    numbered = scratch.write("numbered", ranged.mapInArrow(number, f"{schema}, part long, d long, k long, m long"))
    scratch.drop("leaves")
    last = F.max(F.struct("d", "k"))
    ends = numbered.groupBy("part").agg(F.min_by("source", "d").alias("first"), F.max_by("source", "d").alias("final"), F.count_if(F.col("d") == 0).alias("n_first"), last["d"].alias("d"), last["k"].alias("k")).collect()
    told, totals, tree, count, before = [], {}, -1, 0, None
    for e in sorted(ends, key=lambda r: r.part):  # one row for each range
        goes_on = tree >= 0 and e.first == before
        base, carry = (tree, count) if goes_on else (tree + 1, 0)
        tree = base + e.d
        count = carry + e.n_first if e.d == 0 else e.k + 1
        before = e.final
        totals[base] = carry + e.n_first
        totals[tree] = count
        told.append((e.part, base, carry, base, tree))
    edges = spark.createDataFrame([(p, b, c, totals[f], totals[t], t - b) for p, b, c, f, t in told], "part long, base long, carry long, n_head long, n_tail long, last long")
    size = F.when(F.col("d") == 0, F.col("n_head")).when(F.col("d") == F.col("last"), F.col("n_tail")).otherwise(F.col("m"))
    place = F.col("k") + F.when(F.col("d") == 0, F.col("carry")).otherwise(0)
    return numbered.join(F.broadcast(edges), "part").select((F.col("base") + F.col("d")).alias("tree"), place.alias("place"), size.alias("n"), F.col("leaf").alias("digest"), "doc_id", "altered")


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def insert(nodes: dict, counts: dict, n: int, level: int, k: int, digest: bytes) -> None:
    """A digest comes in; parents that are complete by it are told, one after the other. n: the size of level 0."""
    size = -(-n // ARITY**level)
    while True:
        nodes[level, k] = digest
        if size == 1 or level == LEVELS:
            return
        p = k // ARITY
        have, arity = counts.get((level, p), 0) + 1, min(ARITY, size - ARITY * p)
        counts[level, p] = have
        if have < arity:
            return
        digest = parent([nodes[level, ARITY * p + j] for j in range(arity)])
        level, k, size = level + 1, p, -(-size // ARITY)


def create(node: tuple) -> tuple:
    """A combiner: size of the level, nodes and numbers of children by (level, place), and what leaves carry by place."""
    return add((node[0], {}, {}, {}), node)


def add(held: tuple, node: tuple) -> tuple:
    n, place, digest, carried = node
    insert(held[1], held[2], n, 0, place, digest)
    if carried is not None:
        held[3][place] = carried
    return held


def merge(a: tuple, b: tuple) -> tuple:
    """Complete runs of b are taken over as they are; what is open is inserted, which may complete runs of both."""
    n, nodes, counts, carried = a
    for (level, p), have in b[2].items():
        size = -(-n // ARITY**level)
        arity = min(ARITY, size - ARITY * p)
        for k in range(ARITY * p, ARITY * p + arity):
            if (level, k) in b[1]:
                if have == arity:
                    nodes[level, k] = b[1][level, k]
                else:
                    insert(nodes, counts, n, level, k, b[1][level, k])
        if have == arity:
            counts[level, p] = have
    carried.update(b[3])
    return a


def finished(item: tuple) -> tuple:
    """A block as a row of BLOCKS: its nodes level by level, without its root unless it has one node."""
    (tree, block), (n, nodes, _, carried) = item
    top = max(nodes)
    low = [k for k in sorted(nodes) if k != top] or [top]
    is_root = -(-n // ARITY ** top[0]) == 1
    some = [carried[k] for k in sorted(carried)]
    ids = np.array([i or 0 for i, _ in some], "<i8").tobytes()
    return tree, block, n, is_root, bytearray(nodes[top]), bytearray(b"".join(nodes[k] for k in low)), bytearray(ids), bytearray(i is None for i, _ in some), bytearray(x is not None for _, x in some), bytearray(b"".join(x for _, x in some if x))


def rounds(nodes: DataFrame, most: int, scratch: Scratch, name: str, parts: int) -> list[DataFrame]:
    """The blocks of each round over nodes(tree, place, n, digest[, doc_id, altered]); most: the size of the largest tree."""
    out, leaf = [], "doc_id" in nodes.columns
    spark = nodes.sparkSession
    while True:
        pairs = nodes.rdd.map((lambda r: ((r[0], r[1] // BLOCK), (r[2], r[1], bytes(r[3]), (r[4], r[5] and bytes(r[5]))))) if leaf else (lambda r: ((r[0], r[1] // BLOCK), (r[2], r[1], bytes(r[3]), None))))
        combined = pairs.combineByKey(create, add, merge, parts).map(finished)
        out.append(scratch.write(f"{name}-{len(out)}", spark.createDataFrame(combined, BLOCKS, verifySchema=False)))
        if most <= BLOCK:
            return out
        most, leaf, parts = -(-most // BLOCK), False, max(1, parts // 16)
        nodes = out[-1].where("NOT is_root").select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest")


def block_proofs(block: int, n: int, nodes: bytes, above: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(place, digest, siblings up to the root) of each node of a block's lowest level; above: the siblings from its root on."""
    width, start, at, levels = n, block * BLOCK, 0, []
    high = min(start + BLOCK, n)
    while at < len(nodes):
        m = high - start
        levels.append((start, width, [nodes[at + 32 * k : at + 32 * k + 32] for k in range(m)]))
        at += 32 * m
        start, high, width = start // ARITY, -(-high // ARITY), -(-width // ARITY)
    tails = {levels[-1][0] // ARITY if len(levels[-1][2]) > 1 or levels[-1][1] > 1 else levels[-1][0]: above}
    for start, width, some in reversed(levels):
        if width == 1:  # a tree of one node: it has no siblings here
            continue
        mine = {}
        for p in range(start // ARITY, -(-(start + len(some)) // ARITY)):
            run = some[ARITY * p - start : ARITY * p - start + ARITY]
            for j in range(len(run)):
                mine[ARITY * p + j] = b"".join(run[:j] + run[j + 1 :]) + tails[p]
        tails = mine
    start, _, some = levels[0]
    for j, digest in enumerate(some):
        yield start + j, digest, tails[start + j]


def proofs_below(blocks: DataFrame, above: DataFrame, roots: DataFrame | None) -> DataFrame:
    """blocks with ``above``, the proof of their root, and their tree's ``subroot``: from the round above, or for roots from ``roots``(tree, above)."""
    inner = blocks.where("NOT is_root").join(above.withColumnRenamed("place", "block"), ["tree", "block"]) if above is not None else None
    ends = blocks.where("is_root")
    ends = ends.join(roots, "tree") if roots is not None else ends.withColumn("above", F.lit(b""))
    ends = ends.withColumn("subroot", F.col("digest"))
    return ends if inner is None else inner.select(ends.columns).unionByName(ends)


def proofs_within(blocks: DataFrame) -> DataFrame:
    """(tree, place, above, subroot) of all nodes of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree, block, n, nodes, above, subroot = (batch.column(c)[r].as_py() for c in ("tree", "block", "n", "nodes", "above", "subroot"))
                rows = [(tree, place, proof, subroot) for place, _, proof in block_proofs(block, n, nodes, above)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["tree", "place", "above", "subroot"])

    return blocks.mapInArrow(run, "tree long, place long, above binary, subroot binary")


def all_proofs(tables: list[DataFrame], roots: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The lowest round's blocks with the proofs of their roots, from the highest round down."""
    above = None
    for k in range(len(tables) - 1, 0, -1):
        above = scratch.write(f"{name}-{k}", proofs_within(proofs_below(tables[k], above, roots)))
    return proofs_below(tables[0], above, roots)


def merkle(found: DataFrame) -> tuple[str | None, DataFrame]:
    """The root and a row of PROOFS for each row of ``leaves``: place and size in its tree, the tree's number, all trees, subroot and proof.

    proof: the digests (hex text) of the siblings, level by level from the leaf to the root, each level left to right.
    """
    spark = found.sparkSession
    scratch = Scratch(spark, "merkle")
    nodes = scratch.write("placed", placed_leaves(found, scratch))
    scratch.drop("numbered")
    size = nodes.agg(F.max("tree"), F.max("n"), F.count("*")).first()
    if size[0] is None:
        return None, spark.createDataFrame([], PROOFS)
    trees, parts = size[0] + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[2] // ROWS))
    ups = rounds(nodes, size[1], scratch, "up", parts)
    scratch.drop("placed")
    subroots = reduce(DataFrame.unionByName, [t.where("is_root").select("tree", "digest") for t in ups])
    tops = rounds(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest"), trees, scratch, "top", max(1, -(-trees // ROWS)))
    root = bytes(tops[-1].where("is_root").select("digest").first()[0]).hex()
    of_trees = scratch.write("trees", proofs_within(all_proofs(tops, None, scratch, "down-top")).select(F.col("place").alias("tree"), "above"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree, block, n, nodes, above, subroot, ids, nulls, has, altered = (batch.column(c)[r].as_py() for c in ("tree", "block", "n", "nodes", "above", "subroot", "doc_ids", "null_ids", "has_altered", "altered"))
                ids, at, rows, sub = np.frombuffer(ids, "<i8").tolist(), 0, [], subroot.hex()
                for j, (place, digest, proof) in enumerate(block_proofs(block, n, nodes, above)):
                    other = None
                    if has[j]:
                        other, at = altered[at : at + 32].hex(), at + 32
                    rows.append((None if nulls[j] else ids[j], digest.hex(), other, place, n, tree, trees, sub, proof.hex()))
                for low in range(0, len(rows), 2_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 2_000], strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], PROOFS.replace(" long", "").replace(" string", "").split(", "))

    return root, all_proofs(ups, of_trees, scratch, "down").mapInArrow(run, PROOFS)


def folded(digest: str, place: int, size: int, tree: int, trees: int, proof: str) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for k, n in ((place, size), (tree, trees)):
        while n > 1:
            run = min(ARITY, n - ARITY * (k // ARITY))
            split, end = at + 64 * (k % ARITY), at + 64 * (run - 1)
            digest = hashlib.sha256((proof[at:split] + digest + proof[split:end]).encode()).hexdigest()
            at, k, n = end, k // ARITY, -(-n // ARITY)
    return digest


def verify(proofs: DataFrame) -> DataFrame:
    """Rows of PROOFS with folded_root: what the altered leaf, or else the leaf, and its siblings give."""
    names = [*proofs.columns, "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [folded(other or leaf, *rest) for leaf, other, *rest in zip(*(batch.column(c).to_pylist() for c in ("leaf", "altered", "place", "size", "tree", "trees", "proof")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names)

    return proofs.mapInArrow(run, f"{PROOFS}, folded_root string")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: leaves, roots, digests of proofs, and whether a copy that lost line ends is noticed; nulls, ties and empty tables as above."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")), F.lit(False))
    root, proofs = merkle(leaves(docs, altered=(tampered, F.replace("text", F.lit("\n"), F.lit("")))))
    return verify(proofs).select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


by_value(__name__)
