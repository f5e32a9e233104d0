"""Density clustering: hierarchical clusters of mutual reachability, selected by excess of mass; exact, and no step collects the points.

1. Equal vectors are one point with a weight.
2. Core distances: blocks of points meet in pairs, once; each task tells the nearest points of all the pairs it has.
3. Minimum spanning tree: an edge is of it if it is the lightest that leaves a component. Lists of nearest points tell that
   while it is lighter than all that they may lack. A search then finds the lightest edges of the components that are left, the
   largest one aside, from the points whose lists may lack them only.
4. Condensed tree: edges are merged from light to heavy in stages. A stage's components, of GROUP edges at most, are
   merged in tasks of their own, and are single nodes for the next stage.
5. A cluster is selected if its stability is at least that of what is selected below it. The root is never selected.

All orders are total (weight, then both ids), so that ties have one result. Null vectors are noise (-1), and so are all
rows if there are fewer than the least size. Vectors are of one width. Ids are whole numbers; rows that share id and vector count twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import Tables

BLOCK, PART, GROUP, TINY = 2048, 32, 1 << 18, 1e-10
CHUNK, NEAR, HITS = 512, 8, 1 << 15  # rows of a product; points listed beyond those of the core distance; pairs told exactly at a time
EDGES = "a long, b long, w double"


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows, at nine digits; the same from either side and in any block."""
    far = np.sqrt(((x - y) ** 2).sum(1)).round(9)
    return np.where(np.isnan(far), np.inf, far)


def products(x: np.ndarray, y: np.ndarray, near: float) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first row, squared distances of CHUNK rows to all of y, by how much they are off at most), by matrix products.

    In single precision if what that is off doesn't count beside ``near``, a squared distance that is looked for.
    """
    sound = x[np.isfinite(x).all(1)]
    middle = sound.mean(0) if len(sound) else 0.0
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    off = 4 * (x.shape[1] + 8) * (np.max(xx, where=np.isfinite(xx), initial=0.0) + np.max(yy, where=np.isfinite(yy), initial=0.0))
    single = off * 6e-8 < near / 1000 < np.inf
    kind, off = (np.float32, off * 6e-8) if single else (np.float64, off * 1.2e-16)
    left, right = np.column_stack([-2 * x, xx, np.ones(len(x))]).astype(kind), np.column_stack([y, np.ones(len(y)), yy]).astype(kind).T
    for r in range(0, len(x), CHUNK):
        yield r, left[r : r + CHUNK] @ right, off


def reach(bar: np.ndarray, off: float) -> np.ndarray:
    """Up to what product a pair may be as near as the bar."""
    return (bar + 2e-9) ** 2 * (1 + 1e-12) + off


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask that holds few: eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    at = np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)
    return np.divmod(np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])]), mask.shape[1])


def block_pairs(points: DataFrame, columns: list[str], run, schema: str, tables: Tables, others: DataFrame | None = None) -> DataFrame:
    """``run(pairs)`` of a task over its pairs of blocks of points(id, v, ...); it yields record batches of the schema.

    A pair is (key, vectors, *columns), the same of the other block, and whether both are one; each two blocks meet once.
    With ``others`` each block of points meets each of theirs. Blocks are written once and read as often as they are needed,
    so that no pair is shuffled. A part holds PART blocks at most, and a task the pairs of two parts, for which it tells its
    result once.
    """

    def blocks(of: DataFrame) -> DataFrame:
        count = max(1, -(-of.count() // BLOCK))
        parts = max(min(count, PART), -(-count // PART))
        made = [F.flatten(F.collect_list("v")).alias("v"), *[F.collect_list(c).alias(c) for c in columns]]
        dealt = of.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).repartition(parts, "block")
        return tables.write("blocks", dealt.groupBy("block").agg(*made))

    one, alone = blocks(points), others is None
    two = one if alone else blocks(others)
    two = two.select(*[F.col(c).alias(f"{c}2") for c in two.columns])
    # Of two blocks either may come first: by parity, so that both halves of the square have as much to do.
    even = F.pmod(F.col("block") + F.col("block2"), F.lit(2)) == 0
    once = (F.col("block") == F.col("block2")) | ((F.col("block") != F.col("block2")) & ((F.col("block") < F.col("block2")) == even))
    one = one.hint("shuffle_replicate_nl")
    pairs = one.join(two, once) if alone else one.crossJoin(two)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def side(batch: pa.RecordBatch, r: int, end: str) -> tuple:
            v, *more = (batch.column(f"{c}{end}")[r].values.to_numpy() for c in ("v", *columns))
            return batch.column(f"block{end}")[r].as_py(), v.reshape(len(more[0]), -1), *more

        for batch in batches:
            for r in range(batch.num_rows):
                left, right = side(batch, r, ""), side(batch, r, "2")
                yield *left, *right, alone and left[0] == right[0]

    return pairs.mapInArrow(lambda batches: run(each(batches)), schema)


class Nearest:
    """The nearest points of each row of a block, as far as they were met."""

    def __init__(self, ids: np.ndarray, most: int):
        self.ids, self.most = ids.copy(), most  # copies: it outlives the batch of the pair
        self.far = np.full((len(ids), most), np.inf)
        self.other, self.weight = np.full((len(ids), most), -1), np.ones((len(ids), most), np.int64)
        self.bar = np.full(len(ids), np.inf)  # the farthest of them

    def limit(self, rows: slice, square: np.ndarray, off: float) -> np.ndarray:
        """Up to what product a pair counts for each row; the product's own least ones where too few points were met."""
        limit = reach(self.bar[rows], off)
        if square.shape[1] > self.most and np.isinf(limit).any():
            limit = np.minimum(limit, reach(np.sqrt(np.maximum(np.partition(square, self.most - 1, axis=1)[:, self.most - 1] + off, 0.0)), off))
        return limit.astype(square.dtype)

    def add(self, rows: np.ndarray, far: np.ndarray, other: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((far, rows))
        rows, far, other, weight = (c[order] for c in (rows, far, other, weight))
        touched, first, of = np.unique(rows, return_index=True, return_inverse=True)
        place = np.arange(len(rows)) - first[of]
        keep = place < self.most
        at = of[keep], place[keep]
        shape = (len(touched), self.most)
        new = np.full(shape, np.inf), np.full(shape, -1), np.ones(shape, np.int64)
        for table, c in zip(new, (far, other, weight), strict=True):
            table[at] = c[keep]
        both = [np.concatenate([old[touched], n], axis=1) for old, n in zip((self.far, self.other, self.weight), new, strict=True)]
        least = np.argpartition(both[0], self.most - 1, axis=1)[:, : self.most]
        self.far[touched], self.other[touched], self.weight[touched] = (np.take_along_axis(c, least, 1) for c in both)
        self.bar[touched] = self.far[touched].max(1)

    def told(self) -> pa.RecordBatch:
        upto = pa.array(np.arange(len(self.ids) + 1, dtype=np.int32) * self.most)
        return pa.RecordBatch.from_arrays([pa.array(self.ids), *[pa.ListArray.from_arrays(upto, pa.array(c.reshape(-1))) for c in (self.far, self.other, self.weight)]], ["id", "far", "other", "weight"])


def core_distances(points: DataFrame, least: int, tables: Tables) -> DataFrame:
    """points(id, v, n) with core, near and low.

    core: the distance to the least-th other point, counted with weights; the farthest if there are fewer. near: the nearest
    points (far, other, weight). low: no other point is nearer than that; infinite if near has all of them.
    """
    most = least + NEAR

    def run(pairs) -> Iterator[pa.RecordBatch]:
        held: dict[int, Nearest] = {}  # of each block that the task met
        for i, v, ids, n, j, v2, ids2, n2, same in pairs:
            for block, its in ((i, ids), (j, ids2)):
                if block not in held:
                    held[block] = Nearest(its, most)
            mine, theirs = held[i], held[j]
            for r, square, off in products(v, v2, min(float(np.median(x.bar)) ** 2 for x in (mine, theirs))):
                rows = slice(r, r + len(square))
                if same:
                    square[np.arange(len(square)), np.arange(r, r + len(square))] = np.inf
                limit, limit2 = mine.limit(rows, square, off), None if same else theirs.limit(slice(None), square.T, off)
                found = square <= limit[:, None]
                if not same:
                    found |= square <= limit2[None, :]
                at, to = hits(found)
                for k in range(0, len(at), HITS):
                    a, b = at[k : k + HITS], to[k : k + HITS]
                    one, its = a + r, square[a, b] <= limit[a]
                    far = exact(v[one], v2[b])
                    mine.add(one[its], far[its], ids2[b[its]], n2[b[its]])
                    if not same:
                        its = square[a, b] <= limit2[b]
                        theirs.add(b[its], far[its], ids[one[its]], n[one[its]])
        for block in held.values():
            yield block.told()

    told = block_pairs(points.select("id", "v", "n"), ["id", "n"], run, "id long, far array<double>, other array<long>, weight array<long>", tables)
    met = F.filter(F.flatten(F.collect_list(F.arrays_zip("far", "other", "weight"))), lambda x: x["far"] < float("inf"))
    near = told.groupBy("id").agg(F.slice(F.array_sort(met), 1, most).alias("near"))
    # Goes on until so many points are counted, and keeps the last finite distance.
    start = F.struct((F.lit(least).cast("long") - F.col("n") + 1).alias("need"), F.lit(0.0).alias("d"))
    step = lambda s, x: F.when(s["need"] > 0, F.struct((s["need"] - x["weight"]).alias("need"), x["far"].alias("d"))).otherwise(s)
    low = F.when(F.size("near") < most, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["far"])
    return points.join(near, "id").select("id", "v", "n", F.aggregate("near", start, step)["d"].alias("core"), "near", low.alias("low"))


def certain(edges: pa.Table, components: pa.Table) -> pa.Table:
    """Of up to GROUP listed edges those that are lightest for a component, and what the components are then.

    From light to heavy, each edge whose weight is less than the low of either side: lighter edges of that side, listed or
    not, are within it.
    """
    low, parent, keep = dict(zip(components["node"].to_pylist(), components["low"].to_pylist(), strict=True)), {}, []
    rows = sorted(zip(*(edges[c].to_pylist() for c in ("w", "a", "b", "u", "t")), strict=True))
    for w, a, b, u, t in rows:
        u, t = find(parent, u), find(parent, t)
        if u != t and w < max(low[u], low[t]):
            parent[u] = t
            low[t] = min(low[u], low[t])
            keep.append((a, b, w, None, None))
    out = keep + [(None, None, None, x, find(parent, x)) for x in list(parent)]
    return pa.Table.from_arrays([pa.array([k[c] for k in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["a", "b", "w", "node", "root"])


LEAVING = "node long, w double, a long, b long, t long"


def leaving(open_: DataFrame, points: DataFrame, tables: Tables) -> DataFrame:
    """(node, w, a, b, t): for each component of open_(id, v, core, node, bar) the lightest edge from there that leaves it, if it isn't
    heavier than the bar; by task. t is the component of points(id, v, core, node) that it leads to."""

    def run(pairs) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}

        def tell(i, j, a, b) -> None:
            """Pairs of rows a of the block i and b of j."""
            (v, ids, core, node), (v2, ids2, core2, node2) = i, j
            w = np.maximum(exact(v[a], v2[b]), np.maximum(core[a], core2[b]))
            lo, hi = np.minimum(ids[a], ids2[b]), np.maximum(ids[a], ids2[b])
            order = np.lexsort((hi, lo, w, node[a]))
            names, first = np.unique(node[a][order], return_index=True)
            for name, k in zip(names.tolist(), order[first].tolist(), strict=True):
                edge = float(w[k]), int(lo[k]), int(hi[k]), int(node2[b[k]])
                if edge[0] < np.inf and (name not in best or edge < best[name]):
                    best[name] = edge

        for _, v, ids, core, node, bar, _, v2, ids2, core2, node2, _, _ in pairs:
            i, j = (v, ids, core, node), (v2, ids2, core2, node2)
            names, of = np.unique(node, return_inverse=True)
            bars = lambda: np.minimum(bar, np.array([best[x][0] if x in best else np.inf for x in names.tolist()])[of])  # noqa: B023, E731
            now = bars()
            for r, square, off in products(v, v2, float(np.median(now)) ** 2):
                rows = slice(r, r + len(square))
                other = node[rows, None] != node2[None, :]
                hit = (square <= reach(now[rows], off).astype(square.dtype)[:, None]) & other
                if np.count_nonzero(hit) > HITS:  # the bars are too high yet: each row's likely best lowers them first
                    likely = np.where(other, np.maximum(square, core2[None, :] ** 2), np.inf).argmin(1)
                    a = np.flatnonzero(other[np.arange(len(square)), likely])
                    tell(i, j, a + r, likely[a])
                    now = bars()
                    hit &= square <= reach(now[rows], off).astype(square.dtype)[:, None]
                at, to = hits(hit)
                for k in range(0, len(at), HITS):
                    tell(i, j, at[k : k + HITS] + r, to[k : k + HITS])
                if len(at):
                    now = bars()
        if best:
            cols = list(zip(*[(name, *edge) for name, edge in best.items()], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["node", "w", "a", "b", "t"])

    return block_pairs(open_, ["id", "core", "node", "bar"], run, LEAVING, tables, points.withColumn("bar", F.lit(0.0)))


def block_trees(points: DataFrame, tables: Tables) -> DataFrame:
    """Edges of the minimum spanning tree of points(id, v, core, near, low), by mutual reachability."""
    listed = points.select("id", "core", F.explode("near").alias("x")).select("id", "core", "x.far", "x.other")
    ends = listed.join(points.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    edges = ends.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest("core", "core2", "far").alias("w")).distinct()
    live = tables.write("live", edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("t")))
    state = tables.write("state", points.select("id", F.col("id").alias("node"), "low"))
    found = []

    def lightest() -> DataFrame:
        """(node, w, a, b, t): the lightest listed edge of each component that has one."""
        both = live.select("w", "a", "b", F.col("u").alias("node"), "t").union(live.select("w", "a", "b", F.col("t").alias("node"), F.col("u").alias("t")))
        return both.groupBy("node").agg(F.min(F.struct("w", "a", "b", "t")).alias("e")).select("node", "e.*")

    def components() -> DataFrame:
        return tables.write("components", state.groupBy("node").agg(F.min("low").alias("low"), F.count("*").alias("size")))

    def searched(now: DataFrame) -> DataFrame:
        """The lightest edge of each component but the largest."""
        largest = now.orderBy(F.desc("size"), "node").first()["node"]
        known = tables.write("known", lightest().where(F.col("node") != largest))
        bars = now.where(F.col("node") != largest).join(known, "node", "left").select("node", F.coalesce("w", F.lit(float("inf"))).alias("bar"))
        named = points.select("id", "v", "core").join(state, "id")
        open_ = tables.write("open", named.join(bars, "node").where("low <= bar").select("id", "v", "core", "node", "bar"))
        told = known.union(leaving(open_, named.select("id", "v", "core", "node"), tables)) if open_.limit(1).count() else known
        chosen = tables.write("chosen", told.groupBy("node").agg(F.min(F.struct("w", "a", "b", "t")).alias("e")).select("node", "e.*"))
        if chosen.limit(1).count():
            return chosen
        # No distance between them is a number.
        lone = now.where(F.col("node") != largest).select("node", F.lit(float("inf")).alias("w"), F.lit(largest).alias("t"))
        return tables.write("chosen", lone.select("node", "w", F.least("node", "t").alias("a"), F.greatest("node", "t").alias("b"), "t"))

    def renamed(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """State and edges with the components' new names."""
        named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = live.join(named("u"), "u", "left").join(named("t"), "t", "left").select("a", "b", "w", F.coalesce("u_root", "u").alias("u"), F.coalesce("t_root", "t").alias("t")).where("u <> t")
        pair = [F.least("u", "t").alias("u"), F.greatest("u", "t").alias("t")]
        after = tables.write("live", moved.groupBy(*pair).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "u", "t"))
        return tables.write("state", state.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("node"), "low")), after

    while True:
        now, chosen = components(), None
        if now.limit(2).count() < 2:
            break
        if live.limit(GROUP + 1).count() > GROUP:
            chosen = tables.write("chosen", lightest().join(now.select("node", "low"), "node").where("w < low").drop("low"))
            if not chosen.limit(1).count():
                chosen = searched(now)
        else:
            within = live.select(F.col("u").alias("node")).union(live.select(F.col("t").alias("node"))).distinct()
            some = now.join(within, "node").select("node", "low", F.lit(0).alias("of_nodes"))
            told = tables.write("certain", live.withColumn("of_edges", F.lit(0)).groupBy("of_edges").cogroup(some.groupBy("of_nodes")).applyInArrow(certain, EDGES + ", node long, root long"))
            found.append(told.where("node IS NULL").select("a", "b", "w"))
            state, live = renamed(told.where("node IS NOT NULL").select("node", "root"))
            now = components()
            if now.limit(2).count() < 2:
                break
            chosen = searched(now)
        found.append(chosen.select("a", "b", "w").distinct())
        back = chosen.select(F.col("node").alias("t"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        mutual = F.coalesce((F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), F.lit(False)) & (F.col("node") < F.col("t"))  # of two that chose each other the smaller is the root
        parents = now.select("node").join(chosen, "node", "left").join(back, "t", "left").select("node", F.when(mutual | F.col("t").isNull(), F.col("node")).otherwise(F.col("t")).alias("root"))
        state, live = renamed(followed(parents, tables))
    tree = found[0]
    for part in found[1:]:
        tree = tree.union(part)
    return tables.write("tree", tree)


def find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def followed(parent: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of parent(node, root) by pointer jumping; roots are their own parents."""
    now = tables.write("parents", parent)
    while True:
        after = tables.write("parents", now.join(now.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        done = not after.where("moved").limit(1).count()
        tables.drop(now)
        now = after.drop("moved")
        if done:
            return now


NODE = "node long, size long, open string, total double, below double"
MERGED = "kind string, node long, size long, open string, total double, below double, flagged boolean"


def merged(nodes: pa.Table, edges: pa.Table, least: int) -> pa.Table:
    """Merges a component's nodes along its edges, from light to heavy.

    A node is open if it holds a cluster that has not yet met another one: ``total`` adds up, over its points, 1 / w
    where each leaves, and ``below`` is the stability selected under it. Rows by kind: "node" what the component is now;
    "cluster" a cluster that ended (open: its name, below: its stability, flagged: it beats what is below it) and
    "parent" its successor's name in open for the cluster named in the row before; "of" the cluster that a node's points fell into.
    """
    state, parent, out = {}, {}, []
    for node, size, open_, total, below in zip(*(nodes[c].to_pylist() for c in ("node", "size", "open", "total", "below")), strict=True):
        state[node] = [size, open_, total, below, [] if open_ else [node]]
    rows = sorted(zip(*(edges[c].to_pylist() for c in ("w", "a", "b", "u", "t")), strict=True))
    for w, a, b, u, t in rows:
        u, t = find(parent, u), find(parent, t)
        x, y = state.pop(u), state.pop(t)
        rate, name = 1 / max(w, TINY), f"{a}:{b}"
        size = x[0] + y[0]
        if x[1] and y[1]:
            below = 0.0
            for z in (x, y):
                stability = z[2] - z[0] * rate
                out.append(("cluster", None, z[0], z[1], stability, z[3], stability >= z[3]))
                out.append(("parent", None, None, z[1] + ">" + name, None, None, None))
                below += max(stability, z[3])
            new = [size, name, size * rate, below, []]
        elif x[1] or y[1]:
            big, small = (x, y) if x[1] else (y, x)
            out += [("of", k, None, big[1], None, None, None) for k in small[4]]
            new = [size, big[1], big[2] + small[0] * rate, big[3], []]
        elif size >= least:
            out += [("of", k, None, name, None, None, None) for k in x[4] + y[4]]
            new = [size, name, size * rate, 0.0, []]
        else:
            new = [size, None, 0.0, 0.0, x[4] + y[4]]
        parent[u] = t
        state[t] = new
    first = min(nodes["node"].to_pylist())
    for size, open_, total, below, _ in state.values():
        out.append(("node", first, size, open_, total, below, None))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
    return pa.Table.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["kind", "node", "size", "open", "total", "below", "flagged"])


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) over edges(u, t): the smallest node of each component.

    Each node follows its smallest neighbour down to one that has none smaller; what they lead to are the nodes of the next round.
    """
    live, names = tables.write("pairs", edges.select("u", "t").union(edges.select(F.col("t").alias("u"), F.col("u").alias("t")))), None
    while True:
        roots = followed(live.groupBy(F.col("u").alias("node")).agg(F.least(F.min("t"), F.col("node")).alias("root")), tables)
        far = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        names = roots if names is None else tables.write("roots", names.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
        named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = live.join(named("u"), "u").join(named("t"), "t").where("u_root <> t_root")
        live = tables.write("pairs", moved.select(F.col("u_root").alias("u"), F.col("t_root").alias("t")).distinct())
        if not live.limit(1).count():
            return names


def stage(nodes: DataFrame, edges: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """The lightest edges whose components have GROUP edges at most, with the component of each of their nodes; None: all edges are one."""
    if edges.limit(GROUP + 1).count() <= GROUP:
        return edges, None
    share = 0.5
    while True:
        bar = edges.approxQuantile("w", [share], 0.0 if share < 0.01 else 0.001)[0]
        some = edges.where(F.col("w") <= bar)
        roots = components(some, tables)
        largest = some.join(roots.withColumnRenamed("node", "u"), "u").groupBy("root").count().agg(F.max("count")).first()[0]
        if largest <= GROUP:
            return some, roots
        share /= 2
        if share < 1e-6:  # more than GROUP edges of one weight in one component: any of them go first
            some = edges.orderBy("w", "a", "b").limit(GROUP)
            return tables.write("first", some), components(some, tables)


def clusters(rows: DataFrame, least_size: int = 5, least_samples: int | None = None) -> DataFrame:
    """(id, label) of rows(id, v): label is the smallest id of the cluster, -1 for noise.

    least_samples: of how many other points the distance to the last is the core distance; least_size - 1 unless given.
    """
    spark = rows.sparkSession
    tables, samples = Tables(spark, "density"), least_samples or max(least_size - 1, 1)
    known = rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    points = tables.write("points", known.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    noise = lambda df: df.select("id", F.lit(-1).cast("long").alias("label"))
    if points.limit(2).count() < 2:
        return noise(rows)
    # Two vectors of one smallest id are two points: a number of their own replaces it.
    twins = points.groupBy("id").count().where("count > 1").limit(1).count()
    if twins:
        points = tables.write("numbered", points.withColumn("id", F.monotonically_increasing_id()))
    cored = tables.write("cored", core_distances(points, samples, tables))
    tree = block_trees(cored, tables)
    fresh = F.when(F.col("n") >= least_size, F.concat(F.col("id"), F.lit(":"), F.col("id")))
    nodes = tables.write("nodes", cored.select(F.col("id").alias("node"), F.col("n").alias("size"), fresh.alias("open"), F.when(fresh.isNotNull(), F.col("n") / TINY).otherwise(0.0).alias("total"), F.lit(0.0).alias("below")))
    falls = [nodes.where("open IS NOT NULL").select(F.col("node").alias("point"), F.col("open").alias("cluster"))]
    waiting = tables.write("waiting", nodes.where("open IS NULL").select(F.col("node").alias("point"), "node"))
    edges, ended = tree.select("w", "a", "b", F.col("a").alias("u"), F.col("b").alias("t")), []
    while True:
        some, roots = stage(nodes, edges, tables)
        if roots is None:
            grouped_nodes, grouped_edges = nodes.withColumn("of_nodes", F.lit(0)), some.withColumn("of_edges", F.lit(0))
        else:
            grouped_nodes, grouped_edges = nodes.join(roots.select("node", F.col("root").alias("of_nodes")), "node"), some.join(roots.select(F.col("node").alias("u"), F.col("root").alias("of_edges")), "u")
        told = tables.write("merged", grouped_nodes.groupBy("of_nodes").cogroup(grouped_edges.groupBy("of_edges")).applyInArrow(lambda n, e: merged(n, e, least_size), MERGED))
        ended.append(told)
        assigned = told.where("kind = 'of'").select("node", F.col("open").alias("cluster"))
        falls.append(tables.write("falls", waiting.join(assigned, "node").select("point", "cluster")))
        if roots is None:
            break
        now = told.where("kind = 'node'").select("node", "size", "open", "total", "below")
        rest = waiting.join(assigned, "node", "left_anti").join(roots, "node", "left").select("point", F.coalesce("root", "node").alias("node"))
        waiting = tables.write("waiting", rest)
        left = edges.join(some.select("a", "b"), ["a", "b"], "left_anti")
        named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        edges = tables.write("edges", left.join(named("u"), "u", "left").join(named("t"), "t", "left").select("w", "a", "b", F.coalesce("u_root", "u").alias("u"), F.coalesce("t_root", "t").alias("t")))
        nodes = tables.write("nodes", nodes.join(roots, "node", "left_anti").select(now.columns).union(now))
    chosen = tables.write("chosen", selected(ended, tables))
    each = falls[0]
    for part in falls[1:]:
        each = each.union(part)
    of_point = each.join(chosen, "cluster").select(F.col("point").alias("id"), "top")
    member = known.join(points.select("v", F.col("id").alias("point")), "v").join(of_point.withColumnRenamed("id", "point"), "point").select("id", "v", "top")
    member = tables.write("member", member)
    names = member.groupBy("top").agg(F.min("id").alias("label"))
    labelled = member.join(names, "top").groupBy("id", "v").agg(F.min("label").alias("label"))
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return own.join(labelled, ["id", "v"], "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def sweep(rows: DataFrame, sizes: tuple[int, ...] = (5, 8, 10)) -> DataFrame:
    """(candidate, id, label): the clusters of rows(id, v) for each least size, to be rated by ``vectors.clustering_row`` and its like."""
    out = None
    for k, n in enumerate(sizes):
        one = clusters(rows, n).select(F.lit(k).alias("candidate"), "id", "label")
        out = one if out is None else out.union(one)
    return out


def selected(ended: list[DataFrame], tables: Tables) -> DataFrame:
    """(cluster, top): of each cluster the highest selected one that holds it; none: no row. Pointer jumping up the tree of clusters."""
    all_ = ended[0]
    for part in ended[1:]:
        all_ = all_.union(part)
    links = all_.where("kind = 'parent'").select(F.split("open", ">").alias("p")).select(F.get("p", F.lit(0)).alias("cluster"), F.get("p", F.lit(1)).alias("up"))
    flags = all_.where("kind = 'cluster'").select(F.col("open").alias("cluster"), "flagged")
    now = tables.write("tops", flags.join(links, "cluster").select("cluster", "up", F.when(F.col("flagged"), F.col("cluster")).alias("top")))
    while now.where("up IS NOT NULL").limit(1).count():
        far = now.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("top").alias("higher"))
        now = tables.write("tops", now.join(far, "up", "left").select("cluster", F.col("far").alias("up"), F.coalesce("higher", "top").alias("top")))
    return now.where("top IS NOT NULL").select("cluster", "top")
