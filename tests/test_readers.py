"""Embedded subtitle tracks, front matter, token counts, gates and model keys."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import speech
from storyloom.functions import text as T
from storyloom.models import Registry
from storyloom.operators import signals, vectors
from storyloom.sources import books, matroska, subtitles


def size(n, width=None):
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(name, body, unknown=False):
    body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big") if isinstance(body, int) else body
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + (b"\xff" if unknown else size(len(body))) + body


def block(track, at, raw, lasts=None):
    head = size(track) + at.to_bytes(2, "big", signed=True) + b"\0"
    return element(matroska.SIMPLE, head + raw) if lasts is None else element(matroska.GROUP, element(matroska.BLOCK, head + raw) + element(matroska.LASTS, lasts))


def track(number, kind, codec, *more):
    return element(matroska.ENTRY, element(matroska.NUMBER, number) + element(matroska.KIND, kind) + element(matroska.CODEC, codec.encode()) + b"".join(more))


def packed(algorithm, settings=b""):
    inner = element(matroska.ALGORITHM, algorithm) + (element(matroska.SETTINGS, settings) if settings else b"")
    return element(matroska.ENCODINGS, element(matroska.ENCODING, element(matroska.COMPRESSION, inner)))


def movie(unknown):
    tracks = element(matroska.TRACKS, track(1, 1, "V_TEST") + track(2, 17, "S_TEXT/UTF8", element(matroska.LANGUAGE, b"ger")) + track(3, 17, "S_TEXT/ASS", packed(0)) + track(4, 17, "S_VOBSUB") + track(5, 17, "S_TEXT/UTF8", packed(3, b"Oh "), element(matroska.DURATION, 1_500_000_000)))
    picture = random.Random(1).randbytes(50_000)
    first = element(matroska.TIME, 1000) + block(1, 0, picture) + block(2, 500, "<i>Hi</i> ü\nthere".encode(), 2000) + block(3, -500, zlib.compress(b"0,0,Default,,0,0,0,,{\\b1}One, two\\Nthree"), 1000) + block(4, 0, b"picture", 10)
    second = element(matroska.TIME, 60_000) + block(2, 0, b"", 100) + block(2, 250, b"Bye", 750) + block(5, 0, b"no")
    body = element(matroska.INFO, element(matroska.SCALE, 1_000_000)) + tracks + element(0xEC, b"\0" * 300) + element(matroska.CLUSTER, first, unknown) + element(matroska.CLUSTER, second, unknown)
    return element(matroska.EBML, element(0x4282, b"matroska")) + element(matroska.SEGMENT, body, unknown)


@pytest.mark.parametrize("unknown", [False, True])
def test_embedded_subtitles(spark, tmp_path, unknown):
    (tmp_path / "film.mkv").write_bytes(movie(unknown))
    (tmp_path / "note.txt").write_text("x")
    path = str(tmp_path / "film.mkv")
    get = lambda k: [(r.entry_id, r.start, r.end, r.text) for r in subtitles.read_subtitles(spark, path, k).orderBy("start").collect()]
    assert get(0) == [("utt_000000", 1.5, 3.5, "Hi ü\nthere"), ("utt_000001", 60.25, 61.0, "Bye")]
    assert get(1) == [("utt_000000", 0.5, 1.5, "One, two\nthree")] and get(2) == []
    assert get(3) == [("utt_000000", 60.0, 61.5, "Oh no")]
    spark.dataSource.register(matroska.MatroskaSource)
    rows = spark.read.format("matroska").load(str(tmp_path))
    assert {(r.track, r.language) for r in rows.collect()} == {(0, "ger"), (1, "eng"), (3, "eng")}
    with pytest.raises(Exception, match="not a Matroska"):
        (tmp_path / "bad.mkv").write_bytes(b"no film")
        subtitles.read_subtitles(spark, str(tmp_path / "bad.mkv")).count()


def test_front_matter_with_a_key_twice(spark):
    value = "---\ntitle: a\nlang: de\ntitle: \"b\"\n---\n\nbody"
    meta, body = books.parse_chapter_file(F.col("v"))
    r = spark.createDataFrame([(value,), ("none",)], "v string").select(meta.alias("m"), body.alias("b")).collect()
    assert r[0].m == {"title": "b", "lang": "de"} and r[0].b == "body" and r[1].m is None and r[1].b == "none"


def test_tokens_by_vocabulary(spark):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    texts = ["Hello world, it's 12345 o'clock", "", None, "日本 😀\n\n x", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=T.CL100K, mergeable_ranks=ranks, special_tokens={})
    count = lambda path: [r.n for r in df.select("id", T.token_counter(path)(F.col("text")).alias("n")).orderBy("id").collect()]
    assert count(P.path("byte_bpe_50k.tiktoken")) == [len(e.encode_ordinary(t or "")) for t in texts]
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert count(P.path("word_bpe_49k.json")) == [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_gates_emotions_and_dynamics(spark):
    windows = spark.createDataFrame([("u", 1, -30.0), ("u", 2, -50.0), ("v", 3, None)], "utterance string, id int, rms_db double")
    assert [r.embeds for r in vectors.loud_enough(windows).orderBy("id").collect()] == [True, False, False]
    spans = spark.createDataFrame([("u", 0.0, 2.0), ("v", 0.0, 0.5)], "utterance string, start double, end double")
    assert [r.id for r in vectors.of_long_utterances(windows, spans, 1.0).orderBy("id").collect()] == [1, 2] and vectors.of_long_utterances(windows, spans, 0).count() == 3
    scores = spark.createDataFrame([([("开心/happy", 0.71234), ("x/sad", 0.2)],), ([],), (None,)], "s array<struct<label:string,score:double>>")
    got = [r.e for r in scores.select(speech.emotion_of(F.col("s")).alias("e")).collect()]
    assert (got[0].label, got[0].confidence) == ("happy", 0.71234) and got[1:] == [None, None]
    assert scores.limit(1).select(speech.emotion_of(F.col("s"), F.lit(0.9)).alias("e")).first().e.confidence == 0.9
    rng = np.random.default_rng(1)
    frames = [(v, k, (rng.uniform(0, 255, 9) * (0.1 if v else 1)).tolist()) for v in (0, 1) for k in range(6)] + [(2, 0, [1.0] * 9)]
    told = {r.video: r.dynamics for r in signals.dynamics(spark.createDataFrame(frames, "video int, frame int, v array<double>")).collect()}
    for v in (0, 1, 2):
        x = [np.array(f[2]) for f in frames if f[0] == v]
        raw = np.mean([np.abs(b - a).mean() / 255 for a, b in zip(x, x[1:], strict=False)]) if len(x) > 1 else 0.0
        assert abs(told[v] - min(1.0, raw / 0.2)) < 1e-9


def test_models_are_held_by_registry_and_settings():
    one, two = Registry(), Registry()
    for r, answer in ((one, 1), (two, 2)):
        r.register("emotion", lambda answer=answer, **_: lambda x: answer, size=3)
    assert one.key("emotion") != two.key("emotion") and one.key("emotion") != one.key("emotion", {"size": 4}) and one.key("emotion") == one.key("emotion", {"size": 3})


def test_diverse_rounds_equal_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), int(i % 3), rng.normal(size=5).tolist()) for i in rng.permutation(120)], "id long, label int, v array<double>").repartition(3)
    for count, anchors in ((1, False), (6, False), (2, True), (6, True)):
        monkeypatch.setattr(vectors, "GROUP", 20_000)
        want = sorted(tuple(r) for r in vectors.select_diverse(df, count, anchors).collect())
        monkeypatch.setattr(vectors, "GROUP", 10)
        assert sorted(tuple(r) for r in vectors.select_diverse(df, count, anchors).collect()) == want
