import random

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import batching, entities, intervals, vectors

ROWS = "key int, id int, start double, end double, label string"


def timeline(spark, seed=1, n=200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = round(rng.uniform(0, 300), 2)
        out.append((i % 3, i, s, s + round(rng.uniform(0.1, 9), 2), rng.choice("ab")))
    return out, spark.createDataFrame(out, ROWS)


def test_merge_against_loop(spark):
    rows, df = timeline(spark)
    want = []
    for key in range(3):
        held = []
        for _, _, s, e, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if held and s - held[-1][1] <= 0.5:
                held[-1][1] = max(e, held[-1][1])
            else:
                held.append([s, e])
        want += [(key, *h) for h in held]
    assert sorted((r.key, r.start, r.end) for r in intervals.merge(df, 0.5).collect()) == sorted(want)


def test_overlap_and_containment_against_loop(spark):
    rows, df = timeline(spark)
    a, b = df.where("label = 'a'"), df.where("label = 'b'")
    pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[4] == "a" and y[4] == "b"]
    assert {(r.id, r.id_b) for r in intervals.overlaps(a, b, 5.0).collect()} == {(x[1], y[1]) for x, y in pairs if x[3] > y[2] and x[2] < y[3]}
    assert intervals.overlaps(a, b, 5.0).count() == sum(x[3] > y[2] and x[2] < y[3] for x, y in pairs)
    assert {(r.id, r.id_b) for r in intervals.contained_in(a, b, 5.0).collect()} == {(x[1], y[1]) for x, y in pairs if x[2] >= y[2] and x[3] <= y[3]}


def test_capped_groups_against_loop(spark):
    rows, df = timeline(spark)
    want = []
    for key in range(3):
        held = []
        for _, _, s, e, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if held and s - held[-1][1] <= 2 and e - held[-1][0] <= 12:
                held[-1][1:] = [e, held[-1][2] + 1]
            else:
                held.append([s, e, 1])
        want += [(key, *h) for h in held]
    got = intervals.capped_groups(df, 2.0, 12.0).select("key", "start", "end", "n")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_nearest_ties_take_the_earlier(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 1.0, "k"), (0, 2, 5.0, 6.0, "x"), (0, 3, 10.0, 11.0, "k"), (1, 4, 0.0, 1.0, "x")], ROWS)
    got = {r.id: r.nearest for r in intervals.nearest_in_time(df, F.col("label") == "k", "id").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: None}


def test_sliding_windows(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.2, ""), (0, 2, 0.0, 1.0, ""), (0, 3, 0.0, 3.1, "")], ROWS)
    got = sorted((r.id, round(r.start, 3), round(r.end, 3)) for r in intervals.sliding_windows(df, 1.5, 0.75, 0.3).collect())
    assert got == [(2, 0.0, 1.0), (3, 0.0, 1.5), (3, 0.75, 2.25), (3, 1.5, 3.0), (3, 1.6, 3.1)]


def test_token_batches_oversize_stands_alone(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([3, 4, 20, 2, 5, 4])], "key int, pos bigint, tokens bigint")
    assert [r.batch for r in batching.token_batches(df, 10).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3]


def test_entities(spark):
    occ = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z")], "chapter string, scene int, alias string")
    look = spark.createDataFrame([("c", 1, "x", "X"), ("c", 2, "y", "")], "chapter string, scene int, alias string, canonical string")
    assert {r.alias: r.canonical for r in entities.canonical(occ, look).collect()} == {"x": "X", "y": "y", "z": "z"}
    assert [r.alias for r in entities.missed(occ, look.where("scene = 1"), look.where("scene = 2")).collect()] == ["z"]
    names = spark.createDataFrame([("X",), ("W",)], "canonical string")
    assert {r.canonical: len(r.places) for r in entities.grouped(names, look.where("scene = 1")).collect()} == {"X": 1, "W": 0}
    scenes = spark.createDataFrame([("a", 0, 4, 9), ("a", 4, 9, 9), ("b", 0, 4, 9), ("b", 5, 9, 9)], "chapter string, start int, end int, total int")
    assert {r.chapter: r.covered for r in entities.coverage(scenes).collect()} == {"a": True, "b": False}


def test_medoid_and_vote(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.0, 1.0])], "id int, label int, v array<double>")
    assert vectors.medoids(df).first().medoid == 2
    votes = spark.createDataFrame([(0, 0, "a", 0.5), (0, 1, "b", 0.3), (0, 2, "b", 0.3), (1, 0, "a", 0.9)], "utt int, pos int, speaker string, sim double")
    assert {r.utt: (r.speaker, r.enrolled) for r in vectors.weighted_vote(votes, "utt").collect()} == {0: ("b", True), 1: ("a", False)}


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.normalize_text(F.lit("　a\r\nb\r \n"))) == "a\nb"
    assert get(T.infer_title(F.lit("\n  Hello \nx"))) == "Hello" and get(T.infer_title(F.lit(" "))) == "Chapter 1"
    assert get(T.clock(F.lit(3725.9))) == "01:02:05" and get(T.subtitle_time(F.lit(1.5))) == "00:00:01,500"
    assert get(T.parse_clock(F.lit("01:02:03,5"))) == 3723.5 and get(T.parse_clock(F.lit("a"))) is None
    assert get(T.safe_name(F.lit("a/b\\c"))) == "a_b_c"
    html = "<title>t</title><h1>He<b>ad</b></h1><script>'</p>'</script><p>a  b<br/>c</p>\n<p>&lt;d&gt;</p>"
    assert get(T.html_text(F.lit(html))) == "tHead" + "a b\nc\n<d>" and get(T.html_title(F.lit(html))) == "Head"
    assert get(T.language_code(F.lit("EN_us"))) == "en" and get(T.language_code(F.lit("pt_BR"))) == "pt-br"
    assert get(T.strip_frontmatter(F.lit("---\na: 1\n---\nbody"))) == "body"


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).withColumn("b", F.lit(1)).write.parquet(path)
    plan = spark.read.parquet(path).where("id > 3").select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_catalog_names():
    from storyloom.plans import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and "speaker_vote" in catalog.QUERIES


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
