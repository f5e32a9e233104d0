"""Density clusters against a plain version that works from the heaviest edge down."""

import numpy as np
import pytest

from storyloom.operators import density


def plain(rows, least, samples):
    """Labels by id: full matrix, minimum spanning tree, recursive splits."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    n = len(rows)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    core = np.sort(far, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[a, b], *sorted((ids[a], ids[b])), a, b) for a in range(n) for b in range(a))
    parent, tree = list(range(n)), []

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for e in edges:
        u, t = find(e[3]), find(e[4])
        if u != t:
            parent[u] = t
            tree.append(e)
    labels = dict.fromkeys(ids, -1)

    def sides(points, edge, below):
        near = {p: [] for p in points}
        for e in below:
            near[e[3]].append(e[4])
            near[e[4]].append(e[3])
        seen, todo = {edge[3]}, [edge[3]]
        while todo:
            for q in near[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return seen, points - seen

    def grow(points, tree, birth):
        """(stability selected, clusters selected) of a cluster that begins at the rate ``birth``."""
        stability, all_points = 0.0, points
        while True:
            if not tree:
                return stability, [all_points]
            edge, rate = tree[-1], 1 / max(tree[-1][0], density.TINY)
            a, b = sides(points, edge, tree[:-1])
            inner = lambda side: [e for e in tree[:-1] if e[3] in side]  # noqa: B023, E731
            if len(a) >= least and len(b) >= least:
                stability += len(points) * (rate - birth)
                parts = [grow(s, inner(s), rate) for s in (a, b)]
                below = sum(p[0] for p in parts)
                return (below, parts[0][1] + parts[1][1]) if below > stability else (stability, [all_points])
            if len(a) < least and len(b) < least:
                return stability + len(points) * (rate - birth), [all_points]
            big, small = (a, b) if len(a) >= least else (b, a)
            stability += len(small) * (rate - birth)
            points, tree = big, inner(big)

    # The root itself is not selected: only what its first true split gives.
    points, rest = set(range(n)), tree
    while rest and len(points) >= least:
        edge = rest[-1]
        a, b = sides(points, edge, rest[:-1])
        inner = lambda side: [e for e in rest[:-1] if e[3] in side]  # noqa: B023, E731
        if len(a) >= least and len(b) >= least:
            for s in (a, b):
                for found in grow(s, inner(s), 1 / max(edge[0], density.TINY))[1]:
                    for k in found:
                        labels[ids[k]] = min(ids[j] for j in found)
            break
        big = a if len(a) >= least else b
        if len(big) < least:
            break
        points, rest = big, inner(big)
    return labels


def blobs(seed, n=150, width=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width)) * 4
    return [(int(i), (centers[rng.integers(6)] + rng.normal(size=width) * rng.choice([0.3, 1.0])).tolist() if rng.random() < 0.85 else (rng.normal(size=width) * 8).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,block,group", [(1, 1024, 1 << 18), (2, 40, 1 << 18), (3, 40, 60), (4, 64, 25)])
def test_clusters_against_plain(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "GROUP", group)
    rows = blobs(seed)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {r.id: r.label for r in density.clusters(df, 6, 4).collect()}
    assert got == plain(rows, 6, 4) and len(set(got.values())) > 2


def test_clusters_of_sample_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v")
    got = {r.id: r.label for r in density.clusters(rows, 5).collect()}
    assert got == plain([(r.id, r.v) for r in rows.collect()], 5, 4)


def test_clusters_of_equal_and_few_vectors(spark):
    some = lambda rows, least=3: {(r.id, r.label) for r in density.clusters(spark.createDataFrame(rows, "id long, v array<double>"), least).collect()}
    assert some([]) == set() and some([(1, [0.0]), (2, None)]) == {(1, -1), (2, -1)}
    same = [(k, [0.0, 0.0]) for k in range(5)] + [(10 + k, [9.0, 9.0]) for k in range(4)] + [(20, [100.0, 0.0]), (21, None)]
    assert some(same) == {(k, 0) for k in range(5)} | {(10 + k, 10) for k in range(4)} | {(20, -1), (21, -1)}


def test_sweep_and_its_bound(spark, monkeypatch):
    from storyloom import models

    rows = blobs(5, 80)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in density.sweep(df, (4, 9)).collect():
        got.setdefault(r.candidate, {})[r.id] = r.label
    assert got == {0: plain(rows, 4, 3), 1: plain(rows, 9, 8)}
    make = lambda **_: lambda vectors: ([0] * len(vectors), 1.0)
    assert models.sweep(df, make, [{}]).count() == 80
    monkeypatch.setattr(models, "POINTS", 79)
    with pytest.raises(ValueError, match="density.sweep"):
        models.sweep(df, make, [{}])


def test_tasks_tell_their_pairs_once(spark, tmp_path, monkeypatch):
    """What leaves the tasks grows with points and parts, not with pairs of blocks; also where blocks aren't broadcast."""
    monkeypatch.setattr(density, "BLOCK", 10)
    monkeypatch.setattr(density, "PART", 8)
    rows = blobs(7, 240)
    points = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, v array<double>, n long")
    told = []
    pairs = density.block_pairs
    monkeypatch.setattr(density, "block_pairs", lambda *a: told.append(pairs(*a)) or told[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = density.Tables(spark, "density")
        cored = tables.write("cored", density.core_distances(points, 5, tables))
        edges = density.block_trees(cored, tables)
        tasks = [x.rdd.getNumPartitions() for x in told]
        parts = max(tasks) ** 0.5
        assert told[0].count() <= 2 * 240 * parts  # 240 rows by 24 blocks before
        assert edges.count() <= 2 * 240 * parts
        got = {r.id: r.label for r in density.clusters(points.select("id", "v"), 6, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == plain(rows, 6, 5)


def test_points_meet_all_others_once(spark, monkeypatch):
    """After the core distances only points whose lists may lack an edge are searched from; before, all of them met again."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v", "1L AS n").cache()
    met, pairs = [], density.block_pairs
    monkeypatch.setattr(density, "block_pairs", lambda points, *a: met.append(points.count()) or pairs(points, *a))
    tables = density.Tables(spark, "density")
    cored = tables.write("cored", density.core_distances(rows, 4, tables))
    edges = density.block_trees(cored, tables).collect()
    assert met[0] == 500 and sum(met[1:]) < 250
    core, ids, x = {r.id: r.core for r in cored.collect()}, *zip(*[(r.id, r.v) for r in rows.collect()], strict=True)
    far = np.sqrt(((np.array(x)[:, None] - np.array(x)[None]) ** 2).sum(2)).round(9)
    parent, tree = {i: i for i in ids}, set()
    for w, a, b in sorted((max(far[a, b], core[ids[a]], core[ids[b]]), *sorted((ids[a], ids[b]))) for a in range(500) for b in range(a)):
        u, t = density.find(parent, a), density.find(parent, b)
        if u != t:
            parent[u] = t
            tree.add((a, b, w))
    assert {(e.a, e.b, e.w) for e in edges} == tree and len(edges) == 499


def test_searches_of_far_clusters_with_ties(spark, monkeypatch):
    """Lists that hold no more than the core distances need, equal weights everywhere, vectors that aren't numbers."""
    for name, value in (("NEAR", 0), ("BLOCK", 16), ("CHUNK", 5), ("HITS", 7)):
        monkeypatch.setattr(density, name, value)
    grid = [(float(x + dx), float(y + dy)) for dx, dy, side in ((0, 0, 5), (40, 0, 4), (0, 90, 4), (300, 7, 3)) for x in range(side) for y in range(side)]
    rows = [(int(i), list(v)) for i, v in zip(np.random.default_rng(3).permutation(len(grid)), grid, strict=True)]
    odd = [(100, [float("nan"), 1.0]), (101, [float("inf"), 1.0])]
    got = {r.id: r.label for r in density.clusters(spark.createDataFrame(rows + odd, "id long, v array<double>"), 4).collect()}
    assert got == plain(rows, 4, 3) | {100: -1, 101: -1} and len(set(got.values())) > 4
