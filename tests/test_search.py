"""Search by lists and blocks, and alignment of two sources, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import index, search, vectors

ROWS = "id long, v array<double>, label int"


def some(n=400, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width)) * 2
    x = [(centers[rng.integers(12)] + rng.normal(size=width)).tolist() for _ in range(n)]
    return [(i, v, i % 4) for i, v in enumerate([*x, x[0], x[0], None, [0.0] * width])]


def plain(rows, asked, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and any(v)}
    out = set()
    for q in asked:
        if q in unit:
            top = sorted((-round(float(unit[q] @ u), 9), i) for i, u in unit.items())[:k]
            out |= {(q, i) for _, i in top}
    return out


@pytest.mark.parametrize("chunk", [4096, 30])
def test_exact_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(index, "CHUNK", chunk)
    rows = some()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    asked = list(range(0, 404, 20))
    got = index.exact_search(df, df.where("id % 20 = 0"), 7).collect()
    assert {(r.query, r.id) for r in got} == plain(rows, asked, 7) and len(got) == len({(r.query, r.id) for r in got})
    got = index.exact_search(df, df.where("id % 20 = 0"), 7, {"label": {"$in": [1, 2]}}).collect()
    unit = [r for r in rows if r[2] in (1, 2)]
    want = {(q, i) for q in asked for _, i in sorted((-round(float(np.dot(rows[q][1], v) / np.linalg.norm(v) / np.linalg.norm(rows[q][1])), 9), i) for i, v, _ in unit if v and any(v))[:7]}
    assert {(r.query, r.id) for r in got} == want
    assert index.exact_search(df.limit(0), df).count() == 0 and index.exact_search(df, df.limit(0)).count() == 0


def test_index_holds_all_rows_and_finds_most(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(index, "CHUNK", 50)
    rows = some(900)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    made = index.build(df)
    sound = [i for i, v, _ in rows if v and any(v)]
    assert sorted(r.id for r in made.rows.select("id").collect()) == sound
    asked = df.where("id % 10 = 0")
    exact = index.exact_search(df, asked)
    assert index.recall(made.search(asked), exact).first().recall >= 0.9
    all_lists = made.search(asked, probes=made.centers.count())
    assert sorted(map(tuple, all_lists.collect())) == sorted(map(tuple, exact.collect()))
    made.save(str(tmp_path / "i"))
    again = index.Index.load(spark, str(tmp_path / "i"))
    assert again.probes == made.probes and sorted(map(tuple, again.search(asked).collect())) == sorted(map(tuple, made.search(asked).collect()))
    more = again.add(spark.createDataFrame([(5000, rows[0][1], 1)], ROWS))
    assert 5000 in {r.id for r in more.search(df.where("id = 0"), k=5).collect()} and more.rows.count() == len(sound) + 1
    none = index.build(df.limit(0))
    assert none.search(asked).count() == 0 and none.rows.count() == 0


def test_index_of_many_lists_deals_blocks(spark, monkeypatch):
    """More lists than a task's matrix may hold: the same lists by blocks."""
    df = spark.createDataFrame(some(300), ROWS).repartition(3)
    made = index.build(df, lists=40)
    told = sorted((r.id, r.list) for r in index.listed(df, made.centers, 3).collect())
    monkeypatch.setattr(vectors, "CENTERS", 7)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted((r.id, r.list) for r in index.listed(df, made.centers, 3).collect()) == told


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v, i % 30) for i, v, _ in some(400)], ROWS).repartition(3)
    both = []
    for many in (False, True):
        if many:
            monkeypatch.setattr(vectors, "CENTERS", 5)
            monkeypatch.setattr(vectors, "BLOCK", 8)
        centers = vectors.centroids(vectors.unit(rows))
        both.append([
            sorted((r.id, r.best, round(r.sim, 8)) for r in vectors.nearest_centroid(rows, centers).collect()),
            vectors.silhouette(rows).first().silhouette,
            sorted(tuple(r) for r in vectors.cluster_quality(rows, centers).collect()),
            sorted(tuple(r) for r in vectors.medoids(rows).collect()),
            sorted((r.label, round(r.coherence, 8)) for r in vectors.coherence(rows).collect()),
        ])
    assert both[0] == both[1]


def test_twenty_thousand_labels(spark):
    n = 20_000
    df = spark.range(n).select("id", F.col("id").alias("label"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("v"))
    near = vectors.nearest_centroid(df, vectors.centroids(df))
    assert near.where("best <> label AND sim < 0.999999").count() == 0 and near.count() == n


def test_norms_are_told_once(spark):
    """Wide vectors, normalised twice: no time that grows with the width's square."""
    import time

    took = []
    for width in (64, 512):
        df = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.rand(3) + k).alias("v")).cache()
        df.count()
        began = time.perf_counter()
        vectors.unit(vectors.unit(df)).agg(F.sum(F.get("v", F.lit(0)))).first()
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2


def full_table(n, m, sims, least, width):
    """The greatest gain over monotone chains of candidates, by the full table."""
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        low = i * m // n - width
        for j in range(m):
            gain = sims[i, j] - least if low <= j <= low + 2 * width and sims[i, j] > least else 0.0
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j]) + gain
    return best[n, m]


@pytest.mark.parametrize("seed,n,m,width", [(1, 40, 40, 40), (2, 60, 25, 6), (3, 20, 70, 9), (4, 1, 30, 30)])
def test_alignment_against_full_table(spark, seed, n, m, width):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    vec = lambda k, total: [x + rng.gauss(0, 0.4) for x in base[k * 12 // total]]
    sides = [[(key, f"{s}{k}", k * 2.5, vec(k, size)) for key in ("p", "q", None) for k in range(size)] for s, size in (("l", n), ("r", m))]
    schema = "key string, id string, order double, v array<double>"
    got = search.align(*(spark.createDataFrame(rng.sample(x, len(x)), schema).repartition(3) for x in sides), 0.5, width)
    links, cand = got["links"].collect(), {(r.key, r.left, r.right): r.sim for r in got["candidates"].collect()}
    for key in ("p", "q"):
        x, y = (np.array([v for k, _, _, v in side if k == key]) for side in sides)
        sims = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T).round(9)
        mine = sorted((int(r.left[1:]), int(r.right[1:])) for r in links if r.key == key)
        assert abs(sum(sims[i, j] - 0.5 for i, j in mine) - full_table(n, m, sims, 0.5, width)) < 1e-6
        assert all(a[0] <= b[0] and a[1] <= b[1] and a != b for a, b in zip(mine, mine[1:], strict=False))
        assert all((key, f"l{i}", f"r{j}") in cand for i, j in mine)
        assert {r.left for r in got["left_only"].collect() if r.key == key} == {f"l{i}" for i in range(n)} - {f"l{i}" for i, _ in mine}
        assert {r.right for r in got["right_only"].collect() if r.key == key} == {f"r{j}" for j in range(m)} - {f"r{j}" for _, j in mine}


def test_places(spark):
    from storyloom.operators.written import Tables

    rows = [(k, i) for k in ("a", None, "b") for i in range(50 if k else 1)]
    got = search.places(spark.createDataFrame(random.sample(rows, len(rows)), "key string, order int").repartition(5), ["order"], Tables(spark, "t")).collect()
    assert {(r.key, r.order): (r.place, r["size"]) for r in got} == {(k, i): (i, 50 if k else 1) for k, i in rows}
