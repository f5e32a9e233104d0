"""Transcripts, timelines and vectors against brute force and hand cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.functions import speech
from storyloom.functions import text as T
from storyloom.operators import batching, intervals, transcript, vectors

Tok = transcript.Token


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_heuristic_splitting():
    cut = transcript.split_heuristically
    assert cut("Costs 1,000 yen. Fine!", "en") == ["Costs 1,000 yen. Fine!"] or cut("Costs 1,000 yen. Fine!", "en") == ["Costs 1,000 yen.", "Fine!"]
    assert cut("I met Dr. Smith today. He left.", "en") == ["I met Dr. Smith today.", "He left."]
    assert cut("J. Smith came. We talked.", "en") == ["J. Smith came.", "We talked."]
    assert cut("I stayed at home, because it rained all day", "en") == ["I stayed at home,", "because it rained all day"]
    assert cut("apples, pears and plums", "en") == ["apples, pears and plums"]
    assert cut("今日は雨。明日は晴れ！", "ja") == ["今日は雨。", "明日は晴れ！"]
    assert cut("雨が降っているけれど私は出かけることにした", "ja_JP") == ["雨が降っているけれど", "私は出かけることにした"]
    assert cut("我们今天去公园玩，然后回家吃饭", "zh") == ["我们今天去公园玩，", "然后回家吃饭"]
    assert cut("短，然后我们回家吃饭", "zh") == ["短，然后我们回家吃饭"]


def test_aligned_splitting():
    split = transcript.split_by_tokens
    words = lambda *x: [Tok(t, a, b) for t, a, b in x]
    hard = split("hello there friend", words(("hello", 0, 1), ("there", 1, 2), ("friend", 3, 4)), 0, 4, "en")
    assert hard == [("hello there", 0, 2), ("friend", 3, 4)]
    short = split("one two", words(("one", 0, 0.5), ("two", 0.95, 1.5)), 0, 1.5, "en")
    assert short == [("one two", 0, 1.5)]
    soft = split("one two", words(("one", 0, 2), ("two", 2.4, 4.4)), 0, 4.4, "en")
    assert soft == [("one", 0, 2), ("two", 2.4, 4.4)]
    sentence = split("はい。いいえ。", words(("はい", 0, 1), ("いいえ", 1, 2)), 0, 2, "ja")
    assert sentence == [("はい。", 0, 1), ("いいえ。", 1, 2)]
    merged = split("ああ。いい。", words(("ああいい", 0, 4),), 0, 4, "ja")
    assert merged == [("ああ。", 0, 2), ("いい。", 2, 4)]
    assert split("", [], 0, 1, None) == [] and split("x", [], 0, 1, None) == [("x", 0, 1)]
    zero = transcript.repaired(words(("ab", 1, 1), ("cd", 1, 1), ("ef", 2, 3)), 0, 4)
    assert [(t.start, t.end) for t in zero] == [(0, 1), (1, 2), (2, 3)]
    assert [(t.start, t.end) for t in transcript.repaired(words(("ab", 1, 1), ("c", 1, 1)), 0, 3)] == [(0, 2), (2, 3)]


def test_reconciled_tokens():
    out = transcript.reconciled([Tok("abX", 0, 1), Tok("de", 1, 2)], "ab, c de")
    assert [(t.text, t.start, t.end) for t in out] == [("ab", 0, 1), ("de", 1, 2)]
    assert transcript.reconciled([], "a") == [] and transcript.reconciled([Tok("a", 0, 1)], "") == []


def test_entries(spark):
    tokens = [("One", 0.0, 1.0), ("two", 1.0, 2.0), ("three", 3.0, 4.0)]
    rows = [("a", 10.0, 20.0, 0.0, 4.0, "One two three", -0.1, "en", tokens), ("b", 0.0, 5.0, 0.0, 4.0, "So. It goes.", -0.1, "en", None), ("c", 0.0, 5.0, 0.0, 4.0, "bad", -3.0, "en", None), ("d", 0.0, 5.0, 0.0, 0.1, "brief", None, "en", None), ("e", 0.0, 5.0, 0.0, 4.0, None, None, None, None), ("f", 0.0, 2.0, 0.0, 9.0, "no score", None, None, [])]
    frame = spark.createDataFrame(rows, f"key string, chunk_start double, chunk_end double, start double, end double, text string, avg_logprob double, language string, tokens {transcript.TOKENS}").withColumn("piece", F.lit("clash"))
    got = sorted((r.key, r.piece, r.text, round(r.start, 3), round(r.end, 3), r.stt_confidence is None) for r in transcript.segment_entries(frame).collect())
    assert got == [("a", 0, "One two", 10.0, 12.0, False), ("a", 1, "three", 13.0, 14.0, False), ("b", 0, "So.", 0.0, 1.091, False), ("b", 1, "It goes.", 1.091, 4.0, False), ("f", 0, "no score", 0.0, 2.0, True)]
    assert transcript.segment_entries(frame.limit(0)).count() == 0


def test_spans_and_groups(spark):
    segs = spark.createDataFrame([("a", -1.0, 0.1), ("a", 1.0, 1.3), ("a", 2.0, 99.0), ("b", 0.0, 0.05)], "key string, start double, end double")
    totals = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 7.0)], "key string, total double")
    got = sorted((r.key, r["index"], r.start, r.end) for r in transcript.speech_spans(segs, totals, 0.2).collect())
    assert got == [("a", 0, 1.0, 1.3), ("a", 1, 2.0, 10.0), ("c", 0, 0.0, 7.0)]


def timeline(rng, n=60, keys=3):
    rows, at = [], {k: 0.0 for k in range(keys)}
    for i in range(n):
        k = rng.randrange(keys)
        at[k] += rng.choice([0.0, 0.1, 0.5, 2.0])
        rows.append((k, i, round(at[k], 3), round(at[k] + rng.choice([0.05, 0.3, 1.0, 4.0]), 3), rng.choice("xyz"), rng.random()))
    return rows


SCHEMA = "key long, id long, start double, end double, label string, quality double"


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_against_brute_force(spark, seed):
    rows = timeline(random.Random(seed))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        by.setdefault(r[0], []).append(r)
    want, dropped = [], []
    for k, rs in by.items():  # overlap repair
        out = []
        for _, i, a, b, _, _ in rs:
            if out and a < out[-1][2]:
                cut = min(max(round((out[-1][2] + a) / 2, 3), round(out[-1][1] + 0.04, 3)), round(b - 0.04, 3))
                out[-1][2] = a = cut
                if out[-1][2] - out[-1][1] < 0.04:
                    dropped.append(out.pop()[0])
                if b - a < 0.04:
                    dropped.append(i)
                    continue
            out.append([i, a, b])
        want += [(k, *x) for x in out]
    got = intervals.repair_overlaps(frame).collect()
    assert sorted((r.key, r.id, r.start, r.end) for r in got if r.reason is None) == sorted(want)
    assert sorted(r.id for r in got if r.reason) == sorted(dropped)
    groups = []
    for k, rs in by.items():
        for _, i, a, b, _, _ in rs:
            g = groups[-1] if groups and groups[-1][0] == k else None
            if g and a - g[4] <= 0.6 and b - g[3] <= 5:
                g[2], g[4], g[5] = i, b, g[5] + 1
            else:
                groups.append([k, i, i, a, b, 1])
    assert sorted((r.key, r.first, r.last, r.start, r.end, r.n) for r in intervals.capped_groups(frame, 0.6, 5.0).collect()) == sorted(map(tuple, groups))
    base, more = [r for r in rows if r[4] == "x"], [r for r in rows if r[4] == "y"]
    accepted = {k: [(r[2], r[3]) for r in base if r[0] == k] for k in by}
    kept = []
    for k, i, a, b, _, _ in sorted(more, key=lambda r: (r[2], r[3], r[1])):
        b = min(b, 30.0)
        if b - a >= 0.08 and not any(a < y + 0.2 and b > x - 0.2 for x, y in accepted[k]):
            accepted[k].append((a, b))
            kept.append(i)
    totals = spark.createDataFrame([(k, 30.0) for k in range(3)], "key long, total double")
    assert sorted(r.id for r in intervals.rescued(frame.where("label = 'x'"), frame.where("label = 'y'"), totals, 0.2).collect()) == sorted(kept)
    pairs = {(a[1], b[1]) for a in base for b in more if a[0] == b[0] and a[3] > b[2] and a[2] < b[3]}
    for width, most in ((0.5, 2), (1.0, 64)):
        cond = (F.col("end") > F.col("start_b")) & (F.col("start") < F.col("end_b"))
        found = [(r.id, r.id_b) for r in intervals.bucketed_pairs(frame.where("label = 'x'"), frame.where("label = 'y'").withColumn("bucket", F.lit(1)), width, cond, most).collect()]
        assert len(found) == len(set(found)) and set(found) == pairs
    assert intervals.repair_overlaps(frame.limit(0)).count() == 0 and intervals.capped_groups(frame.limit(0), 1.0, 1.0).count() == 0


def test_boundaries(spark):
    segs = spark.createDataFrame([("a", 1.0, 900.0), ("a", 1100.0, 2300.0), ("a", 2500.0, 3000.0)], "key string, start double, end double")
    totals = spark.createDataFrame([("a", 3600.0), ("b", 100.0)], "key string, total double")
    got = sorted((r.key, r.boundary) for r in intervals.chunk_boundaries(segs, totals).collect())
    assert got == [("a", 0.0), ("a", 1000.0), ("a", 2400.0), ("a", 3600.0), ("b", 0.0), ("b", 100.0)]
    edges = spark.createDataFrame([("a", x) for x in (0.0, 950.0, 1050.0, 2400.0, 3100.0, 3600.0)], "key string, boundary double")
    assert sorted(r.boundary for r in intervals.without_silent_chunks(edges, segs).collect()) == [0.0, 950.0, 2400.0, 3600.0]


def test_batches(spark):
    rows = spark.createDataFrame([("a", 1, 600), ("a", 2, 5), ("a", 3, 5), ("a", 4, 1), ("b", 1, None)], "key string, pos long, tokens long").withColumn("batch", F.lit("clash"))
    assert sorted((r.key, r.pos, r.batch) for r in batching.token_batches(rows, 10).collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 1, 0)]


def brute_diverse(x, count, anchors):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    if n <= count:
        return list(range(n))
    chosen = [0, n - 1, 1] if anchors else [0]
    while len(chosen) < count:
        best = max((k for k in range(n) if k not in chosen), key=lambda k: (round(-max(u[k] @ u[c] for c in chosen), 12), -k))
        chosen.append(best)
    return sorted(chosen)


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    labels = [int(k) for k in rng.integers(0, 4, 60)]
    labels[7] = 9
    frame = spark.createDataFrame([(i, labels[i], [float(v) for v in x[i]]) for i in range(60)] + [(99, 1, None)], "id long, label long, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    of = {c: [i for i in range(60) if labels[i] == c] for c in set(labels)}
    assert {r.label: r.medoid for r in vectors.medoids(frame).collect()} == {c: max(m, key=lambda i: (round(sims[i, m].mean(), 9), -i)) for c, m in of.items()}
    got = {r.label: r.coherence for r in vectors.coherence(frame).collect()}
    assert all(math.isclose(got[c], max((sims[i, m].sum() - 1) / (len(m) - 1) for i in m) if len(m) > 1 else 1.0, rel_tol=1e-9) for c, m in of.items())
    s = []
    for i in range(60):
        own = of[labels[i]]
        b = min((1 - sims[i, m]).mean() for c, m in of.items() if c != labels[i])
        a = (1 - sims[i, own]).sum() / (len(own) - 1) if len(own) > 1 else None
        s.append(0 if a is None else (b - a) / max(a, b))
    assert abs(vectors.silhouette(frame).first()[0] - np.mean(s)) < 1e-6
    far = sims.copy()
    np.fill_diagonal(far, -2)
    assert {r.id: r.id2 for r in vectors.nearest_neighbours(frame).collect()} == {i: int(far[i].argmax()) for i in range(60)}
    for anchors in (False, True):
        assert sorted((r.label, r.id) for r in vectors.select_diverse(frame, 5, anchors).collect()) == sorted((c, m[k]) for c, m in of.items() for k in brute_diverse(x[m], 5, anchors))
    clique = {}
    for c, m in of.items():
        kept = []
        for k in sorted(range(len(m)), key=lambda k: (-round(sims[m[k], m].mean(), 12), k)):
            if all(sims[m[k], m[j]] >= 0.1 for j in kept):
                kept.append(k)
        clique[c] = sorted(m[k] for k in kept)
    got = {}
    for r in vectors.coherent_members(frame, 0.1).collect():
        got.setdefault(r.label, []).append(r.id)
    assert {c: sorted(m) for c, m in got.items()} == clique
    assert vectors.medoids(frame.limit(0)).count() == 0


def test_linkage_and_speakers(spark):
    x = np.array([[1, 0.0], [0.99, 0.05], [0, 1], [0.02, 1.0], [-1, 0]])
    assert vectors.average_linkage(x, 0.25) == [0, 0, 1, 1, 2]
    local = spark.createDataFrame([("r", 0, "A", [1.0, 0.0]), ("r", 1, "B", [0.99, 0.05]), ("r", 1, "C", [0.0, 1.0])], "key string, chunk int, speaker string, v array<double>")
    names = vectors.merge_local_speakers(local)
    turns = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 1, "C"), ("r", 2, "Z")], "key string, chunk int, speaker string")
    assert sorted(r.speaker for r in vectors.global_turns(turns, names).collect()) == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_01", "Z"]


def test_vote_consistency_of_clean_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, i % 4, [float(v) for v in np.eye(4)[i % 2] + rng.normal(size=4) * 0.01]) for i in range(40)]
    r = vectors.vote_consistency(spark.createDataFrame(rows, "id long, label long, segment long, v array<double>")).first()
    assert r.disagreement == 0 and r.separation > 0.5


def test_window_weights(spark):
    rows = [("u", k, k * 4.0, k * 4.0 + 2, db, 0.0, 10.0) for k, db in enumerate((-20.0, -10.0, -30.0))] + [("q", 0, 0.0, 1.0, None, 0.0, 1.0)]
    got = {(r.utterance, r.win): r.weight for r in vectors.window_weights(spark.createDataFrame(rows, "utterance string, win int, start double, end double, rms_db double, utt_start double, utt_end double")).collect()}
    assert abs(sum(w for (u, _), w in got.items() if u == "u") - 1) < 1e-12 and got["u", 1] == max(got.values()) or got["q", 0] == 1.0


def test_text_expressions(spark):
    assert one(spark, T.subtitle_time(F.lit(1.9996))) == "00:00:02,000" and one(spark, T.subtitle_time(F.lit(3661.5))) == "01:01:01,500"
    assert one(spark, T.parse_clock_strict(F.lit("1:02"))) is None and one(spark, T.parse_clock(F.lit("1:02,5"))) == 62.5
    assert one(spark, T.strip_marks(F.lit("「あー」、is-it【x】？"))) == "あーisitx"
    ruby = "<p><ruby>漢<rb>字</rb><rt>かん</rt></ruby>&#8212;&copy;&amp;&nosuch;<!-- no --></p>"
    assert one(spark, T.html_text(F.lit(ruby))) == "字漢—©&&nosuch;" and "かん" in one(spark, T.html_text(F.lit(ruby), True))
    assert one(spark, T.html_title(F.lit("<title>t</title><h1> </h1>"))) == "" and one(spark, T.html_title(F.lit("<strong>" + "x" * 101 + "</strong>"))) is None
    assert one(spark, T.infer_title(F.lit("\n 　\n a b \nc"))) == "a b" and one(spark, T.infer_title(F.lit(" \n"))) == "Chapter 1"
    assert one(spark, T.canonical_json(F.lit('{"b": 1, "a": "x"}'))) == one(spark, T.canonical_json(F.lit('{"a":"x","b":1}')))
    assert one(spark, T.is_true(F.lit(" Yes "))) is True and one(spark, T.is_true(F.lit(None).cast("string"))) is False
    assert one(spark, speech.pitch_class(F.array(*[F.lit(x) for x in (100.0, 101.0, 102.0, 103.0)]))) == "rising"
    assert one(spark, speech.pitch_class(F.array(F.lit(1.0)))) is None and one(spark, speech.rate_class(F.lit(2), F.lit(1.0))) == "normal"
    scores = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(s).alias("sim")) for x, s in (("silence", 0.1), ("crying", 0.5), ("water", 0.2))])
    assert one(spark, speech.top_label(scores, 0.3, 0.1)) == "crying_or_sobbing" and one(spark, speech.top_label(scores, 0.3, 0.4)) is None
    assert one(spark, speech.mixed(F.array(F.lit(0.9), F.lit(0.5)), F.array(F.lit(0.9)))) == [1.0, 0.5]


def test_pairs_of_blocks_of_several_files(spark, tmp_path, monkeypatch):
    """Tables of several files whose blocks are too large to broadcast: numbers of blocks stand, so that each pair counts once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    labels = [None if i % 30 == 7 else i % 4 for i in range(90)]
    for k in range(3):
        spark.createDataFrame([(i, labels[i], x[i].tolist()) for i in range(k, 90, 3)], "id long, label long, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(vectors, "BLOCK", 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    within = [sims[i, j] for i in range(90) for j in range(i) if labels[i] is not None and labels[i] == labels[j]]
    between = [sims[i, j] for i in range(90) for j in range(i) if labels[i] is None or labels[i] != labels[j]]
    np.fill_diagonal(sims, -2)
    for bar in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)
        try:
            rows = spark.read.parquet(str(tmp_path / "rows"))
            told = {r.kind: r for r in vectors.pair_diagnostics(rows).collect()}
            near = {r.id: (r.label, r.id2, r.label2) for r in vectors.nearest_neighbours(rows).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for kind, s in (("within", within), ("between", between)):
            assert told[kind].n == len(s) and np.allclose([told[kind].least, told[kind].most, told[kind]["mean"]], [min(s), max(s), np.mean(s)])
        assert near == {i: (labels[i], int(sims[i].argmax()), labels[int(sims[i].argmax())]) for i in range(90)}


def test_neighbours_leave_tasks_once(spark, monkeypatch):
    """A task tells a row's best once, not for each block that the row met; ties go to the smallest id."""
    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, size=(240, 3)).astype(float) + 0.5  # many ties
    frame = spark.createDataFrame([(int(i), int(i) % 3, x[i].tolist()) for i in rng.permutation(240)], "id long, label long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 5)
    told, pairs = [], vectors.block_pairs
    monkeypatch.setattr(vectors, "block_pairs", lambda *a: told.append(pairs(*a)) or told[-1])
    got = {r.id: r.id2 for r in vectors.nearest_neighbours(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (u @ u.T).round(9)
    np.fill_diagonal(sims, -2)
    assert got == {i: int(sims[i].argmax()) for i in range(240)}
    assert told[0].count() <= 2 * 240 * 16  # 240 rows by 48 blocks before


def test_pieces_take_few_texts_at_a_time(spark, monkeypatch):
    """Of a batch only TEXTS texts and their pieces are Python objects; null texts stay null."""
    texts = [None if k % 50 == 3 else "" if k % 50 == 4 else f"One {k}. Two! And so on? Well, because it is {k}。" for k in range(300)]
    frame = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "k int, t string, x string").coalesce(1)
    got = {r.k: r.l for r in frame.select("k", transcript.pieces(F.col("t"), F.col("x")).alias("l")).collect()}
    assert got == {k: None if t is None else transcript.split_heuristically(t, "en") for k, t in enumerate(texts)}
    most = []
    monkeypatch.setattr("pyspark.sql.functions.arrow_udf", lambda kind: lambda f: lambda *c: most.append(f), raising=False)
    transcript.pieces(F.col("t"), F.col("x"))
    held = []
    batch = pa.array(texts, pa.string())

    class Spy:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, low, n):
            held.append(n)
            return self.a.slice(low, n)

    assert most[0](Spy(batch), Spy(pa.array(["en"] * 300))).to_pylist() == [got[k] for k in range(300)]
    assert max(held) <= transcript.TEXTS
