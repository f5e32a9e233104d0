"""Embedding analytics: centroids, medoids, coherence, silhouettes, votes, nearest neighbours.

Rows are (id, label, v) with v an array of doubles. Means of similarities need no pairs: with unit vectors the mean
similarity of v to a label is v · sum / n, so that one sum for each label and a narrow pass give them. Nearest
neighbours, whose contract is all pairs, are matrix products of blocks. Null vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import TINY, cosine, dot, l2_normalize, norm
from .written import Tables

BLOCK, PART, CENTERS, GROUP = 2048, 16, 10_000, 20_000


def unit(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("v").isNotNull()).withColumn("v", l2_normalize(F.col("v")))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each width; null entries count as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        some = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, some.flatten().fill_null(0.0).to_numpy().astype(float).reshape(len(at), width)


def over_norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), TINY)


def sums(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, n, sum): rows and the (weighted) sum of each place; n is the sum of weights if there are any.

    Each task adds up arrays by label, BLOCK labels at a time, and only these sums shuffle.
    """
    kind = dict(rows.dtypes)["label"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            labels, n, total = zip(*[(k[0], x[0], x[1]) for k, x in held.items()], strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(labels, labelled), pa.array(n, pa.float64()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], ["label", "n", "sum"])

        for batch in batches:
            labelled = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            w = batch.column(2).fill_null(0.0).to_numpy(zero_copy_only=False)
            for at, x in matrices(batch.column(1)):
                known: dict = {}
                codes = np.array([known.setdefault(names[k], len(known)) for k in at], int)
                order = np.argsort(codes, kind="stable")
                firsts = np.searchsorted(codes[order], np.arange(len(known)))
                weighted = np.add.reduceat(x[order] * w[at][order, None], firsts) if x.shape[1] else np.zeros((len(known), 0))
                counts = np.add.reduceat(w[at][order], firsts)
                for label, k in known.items():
                    mine = held.setdefault((label, x.shape[1]), [0.0, 0.0])
                    mine[0] += counts[k]
                    mine[1] = mine[1] + weighted[k]
                if len(held) > BLOCK:
                    yield out()
        if held:
            yield out()

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    found = rows.where(F.col("v").isNotNull()).select("label", "v", w.alias("w"))
    parts = found.mapInArrow(add, f"label {kind}, n double, sum array<double>")
    each = parts.select("label", F.posexplode("sum").alias("i", "x"), "n").groupBy("label", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return each.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))


def centroids(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, centroid): the (weighted) mean of each place, summed before the shuffle."""
    return sums(rows, weight).select("label", F.transform("sum", lambda x: x / F.col("n")).alias("centroid"))


def few(groups: DataFrame) -> pa.Table | None:
    """A table of groups on the driver, if they are CENTERS at most."""
    found = groups.limit(CENTERS + 1).toArrow()
    return found if found.num_rows <= CENTERS else None


def own_terms(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, id, s, vv, n): of each unit vector v, v · sum and n of its label, and v · v. Up to CENTERS labels go to tasks as a matrix."""
    u = unit(rows)
    groups = sums(u, weight)
    held = few(groups)
    if held is None:
        return u.join(groups, "label").select("label", "id", dot(F.col("v"), F.col("sum")).alias("s"), dot(F.col("v"), F.col("v")).alias("vv"), "n")
    place = {label: k for k, label in enumerate(held["label"].to_pylist())}
    known = rows.sparkSession.sparkContext.broadcast((place, held["n"].to_numpy(), [np.array(s, float) for s in held["sum"].to_pylist()]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, total = known.value
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for at, x in matrices(batch.column(2)):
                x, codes = over_norm(x), np.array([place[labels[k]] for k in at], int)
                s = np.array([v @ total[c][: len(v)] for v, c in zip(x, codes, strict=True)], float)
                some = batch.select([0, 1]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(s), pa.array((x * x).sum(1)), pa.array(n[codes])], ["label", "id", "s", "vv", "n"])

    kinds = dict(rows.dtypes)
    return rows.where(F.col("v").isNotNull()).select("label", "id", "v").mapInArrow(tell, f"label {kinds['label']}, id {kinds['id']}, s double, vv double, n double")


def medoids(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, medoid): the member of greatest (weighted) mean similarity to all, itself included; ties: the smallest id."""
    means = own_terms(rows, weight).select("label", "id", F.round(F.col("s") / F.col("n"), 9).alias("mean"))
    return means.groupBy("label").agg(F.max_by("id", F.struct("mean", -F.col("id"))).alias("medoid"))


def coherence(rows: DataFrame) -> DataFrame:
    """(label, coherence): the greatest mean similarity of a member to the others; a single member has 1."""
    mean = (F.col("s") - F.col("vv")) / (F.col("n") - 1)
    return own_terms(rows).groupBy("label").agg(F.coalesce(F.max(F.when(F.col("n") > 1, mean)), F.lit(1.0)).alias("coherence"))


def coherent_labels(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """rows of the labels whose coherence is at least that."""
    return rows.join(coherence(rows).where(F.col("coherence") >= least).select("label"), "label", "left_semi")


def coherent_members(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, label) of a greedy clique of each label: in order of mean similarity (itself counts as 1), a member stays if it is that similar to all that stay.

    A fold over sorted rows, which holds the vectors that stay; ties of the mean at nine digits: the smallest id.
    """
    means = own_terms(rows).groupBy("label", "id").agg(F.min(F.round((F.col("s") - F.col("vv") + 1) / F.col("n"), 9)).alias("mean"))
    kinds, n = dict(rows.dtypes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where(F.col("v").isNotNull()).select("label", "id", "v").join(means, ["label", "id"]).repartition(n, "label").sortWithinPartitions("label", F.desc("mean"), "id").select("label", "id", "v")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held, many = object(), np.empty((0, 0)), 0
        for batch in batches:
            stay = []
            for k, (own, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                v = np.array(v, float)
                if own != label:
                    label, held, many = own, np.empty((16, len(v))), 0
                size = np.linalg.norm(v)
                v = v / (size if size > 0 else 1)
                if not many or (held[:many] @ v >= least).all():
                    stay.append(k)
                    if many == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[many] = v
                    many += 1
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(stay, pa.int64())), batch.column(0).take(pa.array(stay, pa.int64()))], ["id", "label"])

    return ordered.mapInArrow(keep, f"id {kinds['id']}, label {kinds['label']}")


def against(rows: DataFrame, groups: DataFrame, tell, schema: str) -> tuple[DataFrame, bool]:
    """``tell(x, labels, groups' labels, n, matrix)`` of unit rows(id, label, v) and groups(label, n, c): columns of ``schema``.

    Each row comes back with (part, place), which number it, id and label. Up to CENTERS groups are one matrix in every
    task, and each row is told once. More are dealt in blocks: blocks of rows meet all blocks of groups by an equal key,
    salted so that a few blocks of groups still keep all tasks busy; a row is then told once for each block of groups,
    and the second value is False: the caller takes the best over (part, place). Labels are whole numbers.
    """
    names = [x.strip().rsplit(" ", 1)[0] for x in schema.split(",")]
    held, own = few(groups.select("label", "n", "c")), rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("label").cast("long"), "v")
    head = "part long, place long, id long, label long"

    def batch_of(block, ids, labels, told) -> pa.RecordBatch:
        k = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.arange(k)), pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), *told], ["part", "place", "id", "label", *names])

    if held is not None:
        if not held.num_rows:
            return rows.sparkSession.createDataFrame([], f"{head}, {schema}"), True
        known = rows.sparkSession.sparkContext.broadcast((held["label"].to_numpy(), held["n"].to_numpy(), np.array(held["c"].to_pylist(), float)))

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(low, BLOCK)
                    x = over_norm(np.array(some.column(2).to_pylist(), float))
                    yield batch_of(0, some.column(0), some.column(1), tell(x, some.column(1).to_numpy(zero_copy_only=False), *known.value))

        return own.mapInArrow(narrow, f"{head}, {schema}"), True
    spark = rows.sparkSession
    count = -(-groups.count() // BLOCK)
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // count))
    packed = groups.select("label", "n", "c", F.pmod(F.xxhash64("label"), F.lit(count)).alias("key")).groupBy("key").agg(F.collect_list(F.struct("label", "n", "c")).alias("members"))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = blocks(own).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, labels, width, data, members = (batch.column(c)[r].as_py() for c in ("block", "ids", "labels", "width", "data", "members"))
                x = np.frombuffer(data).reshape(-1, width)
                told = tell(x, np.array(labels), np.array([m["label"] for m in members]), np.array([m["n"] for m in members], float), np.array([m["c"] for m in members], float))
                yield batch_of(block, ids, labels, told)

    return dealt.join(packed, ["key", "salt"]).select("block", "ids", "labels", "width", "data", "members").mapInArrow(wide, f"{head}, {schema}"), False


def best_group(x: np.ndarray, labels: np.ndarray, c: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The label of greatest product and this, at nine digits; ties: the smallest label."""
    order = np.argsort(labels, kind="stable")
    sims = (x @ c[order].T).round(9)
    at = sims.argmax(1)
    return pa.array(labels[order][at].astype(np.int64)), pa.array(sims[np.arange(len(x)), at])


def nearest_centroid(rows: DataFrame, centers: DataFrame, least: float | None = None) -> DataFrame:
    """(id, label, best, sim): the centroid of greatest cosine; ties: the smallest label; under ``least``: no row. Any number of centroids."""
    own = centers.select("label", F.lit(1.0).alias("n"), l2_normalize(F.col("centroid")).alias("c"))
    told, whole = against(rows, own, lambda x, _, labels, n, c: best_group(x, labels, c), "best long, sim double")
    if not whole:
        told = told.groupBy("part", "place", "id", "label").agg(F.max(F.struct("sim", -F.col("best"))).alias("top")).select("id", "label", (-F.col("top.col2")).alias("best"), F.col("top.sim").alias("sim"))
    kinds = dict(rows.dtypes)
    best = told.select(F.col("id").cast(kinds["id"]), F.col("label").cast(kinds["label"]), F.col("best").cast(dict(centers.dtypes)["label"]), "sim")
    return best if least is None else best.where(F.col("sim") >= least)


def weighted_vote(votes: DataFrame, key: str) -> DataFrame:
    """votes(key, pos, speaker, sim): the speaker of greatest summed similarity; ties: the first voted. Enrolled: two votes or more."""
    each = votes.groupBy(key, "speaker").agg(F.round(F.sum("sim"), 9).alias("total"), F.count("*").alias("n"), F.min("pos").alias("first"), F.avg("sim").alias("mean"))
    top = each.groupBy(key).agg(F.max(F.struct("total", -F.col("first"), "speaker", "mean")).alias("top"), F.sum("n").alias("votes"))
    return top.select(key, F.col("top.speaker").alias("speaker"), F.col("top.total").alias("total"), F.round("top.mean", 6).alias("mean"), "votes", (F.col("votes") >= 2).alias("enrolled"))


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean cosine silhouette without noise (-1); members of single-row clusters count 0; under two clusters, or all single: 0. Any number of clusters."""
    known = rows.where("label <> -1")
    groups = sums(unit(known)).withColumnRenamed("sum", "c")

    def tell(x, own, labels, n, total):
        s, mine = x @ total.T, own[:, None] == labels[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(n > 1, np.maximum(1 - (s - (x * x).sum(1)[:, None]) / (n - 1), 0.0), np.nan)
            outer = np.where(mine, np.inf, np.maximum(1 - s / n, 0.0)).min(1)
        a = np.where(mine, inner, -np.inf).max(1)  # nan: alone; -inf: its own cluster is in another block
        return pa.array(a, mask=~np.isfinite(a)), pa.array(outer, mask=np.isinf(outer))

    each, whole = against(known, groups, tell, "a double, b double")
    if not whole:
        each = each.groupBy("part", "place").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return each.agg(F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("silhouette"))


def blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, labels, width, data): unit vectors in matrices of up to BLOCK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                some = batch.slice(low, BLOCK)
                x = np.array(some.column(2).to_pylist(), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "labels", "width", "data"])
                k += 1

    found = rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("label").cast("long"), "v")
    return found.mapInArrow(run, "block long, ids array<long>, labels array<long>, width int, data binary")


def block_pairs(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(pairs)`` of a task over its pairs of blocks; it yields record batches of the schema.

    A pair is (key, x, ids, labels), the same of the other block, and whether both are one; each two blocks meet once, in
    one order. Blocks are written first, so that their numbers stand wherever they are read, and read again as often as
    they are needed: no pair is shuffled. A part holds PART blocks at most, and a task the pairs of two parts: n^2 / 2
    products in all, which is the contract of who calls this. Rows without an id make no pair.
    """
    known = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).select("id", "label", "v")
    count = max(1, -(-known.count() // BLOCK))
    one = Tables(rows.sparkSession, "pairs").write("blocks", blocks(known.repartition(max(min(count, PART), -(-count // PART)))))
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    # Of two blocks either may come first: by parity, so that both halves of the square have as much to do.
    even = F.pmod(F.col("block") + F.col("block2"), F.lit(2)) == 0
    pairs = one.join(two, (F.col("block") == F.col("block2")) | ((F.col("block") != F.col("block2")) & ((F.col("block") < F.col("block2")) == even)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def side(batch: pa.RecordBatch, r: int, end: str) -> tuple:
            x = np.frombuffer(batch.column(f"data{end}")[r].as_buffer()).reshape(-1, batch.column(f"width{end}")[r].as_py())
            return batch.column(f"block{end}")[r].as_py(), x, *(whole_numbers(batch.column(f"{c}{end}")[r].values) for c in ("ids", "labels"))

        for batch in batches:
            for r in range(batch.num_rows):
                left, right = side(batch, r, ""), side(batch, r, "2")
                yield *left, *right, left[0] == right[0]

    return pairs.mapInArrow(lambda batches: run(each(batches)), schema)


def whole_numbers(values: pa.Array) -> np.ndarray:
    """Numbers; objects if there are nulls."""
    return np.array(values.to_pylist(), object) if values.null_count else values.to_numpy()


def nearest_neighbours(rows: DataFrame) -> DataFrame:
    """(id, label, id2, label2, sim): the other row of greatest cosine; ties at nine digits: the smallest id."""

    def best(pairs):
        held: dict[int, list] = {}  # of each block that the task met: ids, labels, and the best so far
        for i, x, ids, labels, j, y, ids2, labels2, same in pairs:
            # In order of ids, so that the first of equals is the smallest.
            (x, ids, labels), (y, ids2, labels2) = ((m[o], k[o], c[o]) for m, k, c, o in ((x, ids, labels, np.argsort(ids, kind="stable")), (y, ids2, labels2, np.argsort(ids2, kind="stable"))))
            sims = x @ y.T
            np.round(sims, 9, out=sims)
            if same:
                np.fill_diagonal(sims, -2.0)
            for block, axis, own, mine, other, theirs in ((i, 1, ids, labels, ids2, labels2), (j, 0, ids2, labels2, ids, labels))[: 1 if same else 2]:
                at = sims.argmax(axis)
                top = sims[np.arange(len(at)), at] if axis else sims[at, np.arange(len(at))]
                now = [own, mine, top, other[at], theirs[at]]
                if block in held:
                    before = held[block]
                    better = (top > before[2]) | ((top == before[2]) & (now[3] < before[3]))
                    now[2:] = (np.where(better, n, k) for n, k in zip(now[2:], before[2:], strict=True))
                held[block] = now
        for own, mine, top, other, theirs in held.values():
            keep = top > -1.5
            yield pa.RecordBatch.from_arrays([*(pa.array(a[keep], pa.int64()) for a in (own, mine, other, theirs)), pa.array(top[keep])], ["id", "label", "id2", "label2", "sim"])

    found = block_pairs(rows, best, "id long, label long, id2 long, label2 long, sim double")
    top = found.groupBy("id", "label").agg(F.max(F.struct("sim", -F.col("id2"), "label2")).alias("top"))
    return top.select("id", "label", (-F.col("top.col2")).alias("id2"), F.col("top.label2").alias("label2"), F.col("top.sim").alias("sim"))


def neighbour_purity(rows: DataFrame) -> DataFrame:
    """purity: the share of rows whose nearest other row has their label (-1 is noise: not judged, but a neighbour)."""
    return nearest_neighbours(rows).where("label <> -1").agg(F.round(F.avg((F.col("label") == F.col("label2")).cast("double")), 6).alias("purity"))


def purity_grade(purity: Column) -> Column:
    """What the purity says of the embeddings."""
    return F.when(purity >= 0.8, "good").when(purity >= 0.5, "marginal").otherwise("poor")


def pair_diagnostics(rows: DataFrame) -> DataFrame:
    """(kind, n, least, most, mean, p5, p25, p50, p75, p95): similarities of all pairs within a label and between labels.

    Sums, extremes and a histogram of steps of 0.0001, from which the percentiles are read, add up over the pairs of blocks. Without a label a row is like no other.
    """

    def tell(pairs):
        # By kind: how many and the sum by step from -1 to 1, and the extremes; told once for a task.
        held = {kind: [np.zeros(20_003, np.int64), np.zeros(20_003), np.inf, -np.inf] for kind in ("within", "between")}
        for _, x, _, labels, _, y, _, labels2, same in pairs:
            sims = x @ y.T
            alike = (labels[:, None] == labels2[None, :]) & (labels != None)[:, None]  # noqa: E711
            first = np.triu(np.ones(sims.shape, bool), 1) if same else True
            for kind, own in held.items():
                s = sims[(alike if kind == "within" else ~alike) & first]
                if len(s):
                    step = np.rint(s * 10_000).astype(np.int64) + 10_001
                    own[0] += np.bincount(step, minlength=20_003)
                    own[1] += np.bincount(step, s, minlength=20_003)
                    own[2:] = min(own[2], s.min()), max(own[3], s.max())
        for kind, (n, total, low, high) in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), *(pa.array(a) for a in (at - 10_001, n[at], total[at], np.full(len(at), low), np.full(len(at), high)))], ["kind", "step", "n", "total", "low", "high"])

    steps = block_pairs(rows, tell, "kind string, step long, n long, total double, low double, high double")
    hist = steps.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    w = Window.partitionBy("kind")
    upto = hist.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    p = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("step") / 10_000)).alias(f"p{round(100 * q)}")
    return upto.groupBy("kind").agg(F.sum("n").alias("n"), F.min("low").alias("least"), F.max("high").alias("most"), (F.sum("total") / F.sum("n")).alias("mean"), *[p(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


def cluster_quality(rows: DataFrame, centers: DataFrame, enrolled: str | None = None) -> DataFrame:
    """Of each label: counts, quartiles of the similarity to its centroid (of the enrolled rows), the greatest of all rows.

    Also intra (mean similarity of the pairs within it; null for one row) and nearest (similarity of the closest other
    centroid; null without another one). Any number of labels.
    """
    on = F.col(enrolled) if enrolled else F.lit(True)
    own = centers.select("label", l2_normalize(F.col("centroid")).alias("c"))
    scored = unit(rows).withColumn("on", on).join(own, "label").select("label", "on", dot(F.col("v"), F.col("c")).alias("sim"), dot(F.col("v"), F.col("v")).alias("vv"))
    sim = F.when(F.col("on"), F.col("sim"))
    q = lambda p: F.round(F.percentile(sim, p), 6)
    out = scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if("on").alias("n_enrolled"), F.round(F.avg(sim), 6).alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.round(F.min(sim), 6).alias("least"), F.round(F.max("sim"), 6).alias("most"), F.sum("vv").alias("vv"))
    pairs = sums(unit(rows)).select("label", dot(F.col("sum"), F.col("sum")).alias("ss"), F.col("n").alias("m"))

    def tell(x, mine, labels, n, c):
        sims = np.where(mine[:, None] == labels[None, :], -np.inf, x @ c.T).max(1)
        return (pa.array(sims, mask=np.isinf(sims)),)

    near, whole = against(own.select(F.col("label").alias("id"), "label", F.col("c").alias("v")), own.withColumn("n", F.lit(1.0)), tell, "sim double")
    near = (near if whole else near.groupBy("label").agg(F.max("sim").alias("sim"))).select(F.col("label").cast(dict(centers.dtypes)["label"]), F.round("sim", 6).alias("nearest"))
    intra = F.round(F.when(F.col("m") > 1, (F.col("ss") - F.col("vv")) / (F.col("m") * (F.col("m") - 1))), 6).alias("intra")
    return out.join(pairs, "label").join(near, "label").select("label", "n", "n_enrolled", "mean", "median", "p25", "p75", "least", "most", intra, "nearest")


def norm_outliers(rows: DataFrame, k: float = 5.0) -> DataFrame:
    """rows with keep: not under median - k * 1.4826 * MAD of the norms of their label, where it has over 3 rows."""
    w = Window.partitionBy("label")
    n = rows.withColumn("norm", norm(F.col("v"))).withColumn("mid", F.median("norm").over(w)).withColumn("size", F.count("*").over(w))
    n = n.withColumn("mad", F.median(F.abs(F.col("norm") - F.col("mid"))).over(w))
    bar = F.col("mid") - k * 1.4826 * F.col("mad")
    return n.withColumn("keep", (F.col("size") <= 3) | (F.col("mad") < 1e-10) | (bar <= 0) | (F.col("norm") >= bar))


def singleton_fraction(rows: DataFrame) -> DataFrame:
    """fraction: rows alone in their cluster, of all rows that are not noise; none: 0."""
    sizes = rows.where("label <> -1").groupBy("label").count()
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("count") == 1, 1).otherwise(0)) / F.sum("count"), F.lit(0.0)).alias("fraction"))


def size_statistics(rows: DataFrame, places: tuple[int, ...] = (1, 5, 10, 20, 30)) -> DataFrame:
    """top_k: the k-th largest cluster for each place, null if there are fewer; partial top-k in every task."""
    sizes = rows.where("label <> -1").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(max(places))
    down = F.sort_array(F.collect_list("n"), asc=False)
    return sizes.agg(down.alias("all")).select(*[F.get("all", F.lit(k - 1)).alias(f"top_{k}") for k in places])


def clustering_row(rows: DataFrame, persistence: float = 0.0) -> DataFrame:
    """noise_fraction, n_clusters, max_cluster_ratio (0 for one cluster), mean_persistence within 0 and 1."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    real = F.when(F.col("label") >= 0, F.col("n"))
    ratio = F.when(F.count(real) > 1, F.max(real) / F.sum(real)).otherwise(0.0)
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("noise_fraction"), F.count(real).alias("n_clusters"), ratio.alias("max_cluster_ratio"), F.lit(min(max(persistence, 0.0), 1.0)).alias("mean_persistence"))


def vote_consistency(rows: DataFrame) -> DataFrame:
    """disagreement and separation of rows(id, label, segment, v): windows against the vote of their segment.

    Centroids of labels are unit means; a segment's label is the weighted vote of its windows' nearest centroids.
    disagreement: the share of windows with another one, over the root of the number of labels; separation: the
    silhouette of the voted labels.
    """
    known = rows.where("label <> -1")
    near = nearest_centroid(rows, centroids(unit(known)))
    near = rows.select("id", "segment", "v").join(near.select("id", "best", "sim"), "id")
    voted = weighted_vote(near.select("segment", F.col("id").alias("pos"), F.col("best").alias("speaker"), "sim"), "segment")
    both = near.join(voted.select("segment", F.col("speaker").alias("voted")), "segment")
    n = known.select("label").distinct().count()
    rate = both.agg((F.coalesce(F.avg((F.col("best") != F.col("voted")).cast("double")), F.lit(0.0)) / float(max(n, 1)) ** 0.5).alias("disagreement"))
    return rate.join(silhouette(both.select("id", F.col("voted").alias("label"), "v")).withColumnRenamed("silhouette", "separation"))


def zscores(rows: DataFrame, metrics: dict[str, tuple[float, bool]]) -> DataFrame:
    """rows with score: the weighted sum of z-scores; metrics: name -> (weight, higher is better). No spread: 0."""
    stats = rows.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    parts = [F.when(F.col(f"std_{m}") < 1e-12, 0.0).otherwise((F.col(m) - F.col(f"mean_{m}")) / F.col(f"std_{m}")) * (w if up else -w) for m, (w, up) in metrics.items()]
    return rows.join(F.broadcast(stats)).withColumn("score", sum(parts[1:], parts[0])).select(*rows.columns, "score")


def best_candidate(rows: DataFrame) -> DataFrame:
    """The sweep row of greatest (score, sep, -disagree, nn_purity, silhouette, -n_noise); ties: the first pos."""
    key = F.struct("score", "sep", -F.col("disagree"), "nn_purity", "silhouette", -F.col("n_noise"), -F.col("pos"))
    return rows.agg(F.max_by(F.struct(*rows.columns), key).alias("r")).select("r.*")


def metric_ranks(rows: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """rows with rank_m, from 1, for each metric (True: the greatest first); ties: by pos. For a sweep's few rows."""
    w = lambda m, up: Window.orderBy(F.desc(m) if up else F.asc(m), "pos")
    return rows.select("*", *[F.row_number().over(w(m, up)).alias(f"rank_{m}") for m, up in metrics.items()])


def metric_spans(rows: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """(metric, least, most, best_pos): the span of each metric and its best row."""
    best = lambda m, up: (F.max_by if up else F.min_by)("pos", F.struct(m, -F.col("pos") if up else F.col("pos")))
    one = rows.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.min(m).cast("double").alias("least"), F.max(m).cast("double").alias("most"), best(m, up).alias("best_pos")) for m, up in metrics.items()]).alias("all"))
    return one.select(F.inline("all"))


def loud_enough(windows: DataFrame, threshold_db: float = -40.0) -> DataFrame:
    """windows(..., rms_db) with ``embeds``: whether a vector is made of it. Silence (null) and quiet windows stay, without one."""
    return windows.withColumn("embeds", F.coalesce(F.col("rms_db") >= threshold_db, F.lit(False)))


def of_long_utterances(windows: DataFrame, utterances: DataFrame, least: float) -> DataFrame:
    """windows(utterance, ...) of utterances(utterance, start, end) that last ``least`` seconds; 0 or less: all windows."""
    if least <= 0:
        return windows
    return windows.join(utterances.where(F.col("end") - F.col("start") >= least).select("utterance"), "utterance", "left_semi")


def window_weights(windows: DataFrame, threshold_db: float = -40.0) -> DataFrame:
    """windows(utterance, win, start, end, rms_db, utt_start, utt_end) with weight: energy above the threshold times a bell around the middle, summing to one; without energy all are equal."""
    length, middle = F.col("utt_end") - F.col("utt_start"), (F.col("utt_start") + F.col("utt_end")) / 2
    sigma = F.when(length < 1e-6, 1.0).otherwise(length / 4)
    raw = F.greatest(F.coalesce("rms_db", F.lit(threshold_db)) - threshold_db, F.lit(0.0)) * F.exp(-0.5 * F.pow(((F.col("start") + F.col("end")) / 2 - middle) / sigma, 2))
    w = Window.partitionBy("utterance")
    both = windows.select("*", raw.alias("_raw")).select("*", F.sum("_raw").over(w).alias("_sum"), F.count("*").over(w).alias("_n"))
    return both.withColumn("weight", F.when(F.col("_sum") < 1e-10, 1 / F.col("_n")).otherwise(F.col("_raw") / F.col("_sum"))).drop("_raw", "_sum", "_n")


def diversity_target(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(label, n, target): how many rows to select: more the less similar they are (mean of pairs, negative ones as 0)."""
    u = unit(rows)
    own = u.groupBy("label").agg(F.sum(dot(F.col("v"), F.col("v"))).alias("vv"))
    both = sums(u).join(own, "label")
    mean = F.greatest((dot(F.col("sum"), F.col("sum")) - F.col("vv")) / (F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    target = F.greatest(F.lit(least), F.least(F.lit(most), least + F.bround((most - least) * (1 - F.pow(mean, 2.2))).cast("int")))
    return both.select("label", F.col("n").cast("long").alias("n"), F.when(F.col("n") < 2, least).otherwise(target).cast("int").alias("target"))


def diverse_places(x: np.ndarray, count: int, anchors: bool = False) -> list[int]:
    """Greedy max-min selection of ``count`` rows in order, starting at the first; ties: the lowest place.

    anchors: the first and the last are taken, and the search starts with the second.
    """
    n = len(x)
    if n <= count or (anchors and n <= 2):
        return list(range(n))
    if anchors and count <= 2:
        return [0, n - 1][: max(count, 0)] if count else []
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(size > 0, size, 1)
    chosen = [0, n - 1, 1] if anchors else [0]
    near = (u @ u[chosen].T).max(1).round(12)
    while len(chosen) < count:
        open_ = np.setdiff1d(np.arange(n), chosen)
        k = int(open_[near[open_].argmin()])
        chosen.append(k)
        near = np.maximum(near, (u @ u[k]).round(12))
    return sorted(chosen)


def select_diverse(rows: DataFrame, count: int, anchors: bool = False) -> DataFrame:
    """(label, id) of up to ``count`` rows of each label in order of id, by greedy max-min cosine diversity. Ids are unique in a label.

    Labels of up to GROUP rows are a group in a task; larger ones are selected in rounds over all their rows, one for
    each further choice, with the same result.
    """
    found = rows.where(F.col("v").isNotNull()).select("label", "id", "v")
    kinds = dict(found.dtypes)

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return table.select(["label", "id"]).take(diverse_places(np.array(table["v"].to_pylist(), float), count, anchors))

    groups = lambda df: df.groupBy("label").applyInArrow(pick, f"label {kinds['label']}, id {kinds['id']}")
    large = found.groupBy("label").count().where(F.col("count") > GROUP).select("label")
    if not large.limit(1).count():
        return groups(found)
    tables = Tables(rows.sparkSession, "diverse")
    large = tables.write("large", large)
    return groups(found.join(large, "label", "left_anti")).union(diverse_rounds(found.join(large, "label", "left_semi"), count, anchors, tables))


def diverse_rounds(rows: DataFrame, count: int, anchors: bool, tables: Tables) -> DataFrame:
    """The same selection for labels of more than ``count`` rows: each round takes, of each label, the row least similar to those taken."""
    ends = rows.groupBy("label").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    second = rows.join(ends, "label").where(F.col("id") > F.col("first")).groupBy("label").agg(F.min("id").alias("id"))
    first = ends.select("label", F.col("first").alias("id"))
    start = first.union(ends.select("label", F.col("last"))) if anchors else first
    chosen = start.union(second.select("label", "id")) if anchors and count > 2 else start
    if count <= (2 if anchors else 1):
        return chosen if count >= (2 if anchors else 1) else chosen.limit(0)
    unit_ = tables.write("unit", unit(rows))
    told = lambda now, taken: now.join(taken.select("label", F.col("v").alias("__v"), F.col("id").alias("__id")), "label").select("label", "id", "v", F.greatest("near", F.round(dot(F.col("v"), F.col("__v")), 12)).alias("near"), (F.col("taken") | (F.col("id") == F.col("__id"))).alias("taken"))
    now = unit_.select("label", "id", "v", F.lit(-2.0).alias("near"), F.lit(False).alias("taken"))
    taken = unit_.join(chosen, ["label", "id"])
    now = told(now, taken).groupBy("label", "id").agg(F.first("v").alias("v"), F.max("near").alias("near"), F.max("taken").alias("taken"))
    now = tables.write("near", now)
    for _ in range(count - (3 if anchors else 1)):
        best = tables.write("best", now.where("NOT taken").groupBy("label").agg(F.min_by(F.struct("id", "v"), F.struct("near", "id")).alias("r")).select("label", "r.id", "r.v"))
        after = tables.write("near", told(now, best))
        tables.drop(now)
        now = after
    return now.where("taken").select("label", "id")


def average_linkage(x: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers (by first member) of rows that average-linkage clustering by cosine distance joins up to ``cut``."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.maximum(size, 1e-10)
    far = 1 - u @ u.T
    np.fill_diagonal(far, np.inf)
    members = {k: [k] for k in range(len(x))}
    while len(members) > 1:
        a, b = divmod(int(far.argmin()), len(x))
        if far[a, b] > cut:
            break
        na, nb = len(members[a]), len(members[b])
        far[a] = (na * far[a] + nb * far[b]) / (na + nb)
        far[:, a] = far[a]
        far[a, a] = np.inf
        far[b, :] = far[:, b] = np.inf
        members[a] += members.pop(b)
    out = [0] * len(x)
    for n, group in enumerate(sorted(members.values(), key=min)):
        for k in group:
            out[k] = n
    return out


def merge_local_speakers(local: DataFrame, similarity: float = 0.75) -> DataFrame:
    """(key, chunk, speaker, global): local speakers(key, chunk, speaker, v) of a recording under common names SPEAKER_00, ...

    A recording's local speakers are one group in memory. Those without a vector keep no row: ``global_turns`` gives them their local name.
    """

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("speaker", "ascending")])
        names = [f"SPEAKER_{k:02d}" for k in average_linkage(np.array(table["v"].to_pylist(), float), 1 - similarity)]
        return table.select(["key", "chunk", "speaker"]).append_column("global", pa.array(names, pa.string()))

    kinds = dict(local.dtypes)
    return local.where(F.col("v").isNotNull()).select("key", "chunk", "speaker", "v").groupBy("key").applyInArrow(join, f"key {kinds['key']}, chunk {kinds['chunk']}, speaker string, global string")


def global_turns(turns: DataFrame, names: DataFrame) -> DataFrame:
    """turns(key, chunk, speaker, ...) under common names; a speaker that has none keeps its local one."""
    found = turns.join(names.select("key", "chunk", "speaker", F.col("global").alias("_global")), ["key", "chunk", "speaker"], "left")
    return found.select(*[F.coalesce("_global", "speaker").alias("speaker") if c == "speaker" else F.col(c) for c in turns.columns])


def similarity(a: Column, b: Column) -> Column:
    """Cosine, 0 for vectors of other sizes or without length."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), cosine(a, b)).otherwise(0.0)
