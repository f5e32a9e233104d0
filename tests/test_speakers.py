"""The bank of voices, diarization by chunks, rescued speech and diagnostics, against loops and hand cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import intervals, scenes, transcript
from storyloom.plans import stages
from storyloom.sources.caches import Cache
from storyloom.sources.speakers import SpeakerBank

TURNS, LOCAL = "key string, speaker string, start double", "key string, speaker string, v array<double>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_cache_states_stay_apart_in_one_plan(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), "bigint")
    add = lambda *keys: cache.add(spark.createDataFrame([(k, "s", 1) for k in keys], "key string, signature string, value bigint"))
    assert cache.rows().count() == 0
    add("a")
    first = cache.newest()
    add("b", "c")
    both = first.select(F.lit(1).alias("state"), "key").union(cache.newest().select(F.lit(2), "key"))
    assert rows(both, "state", "key") == [(1, "a"), (2, "a"), (2, "b"), (2, "c")]


def test_speaker_bank(spark, tmp_path):
    bank = SpeakerBank(spark, str(tmp_path / "bank"), "m1")
    turns = lambda *x: spark.createDataFrame(list(x), TURNS)
    local = lambda *x: spark.createDataFrame(list(x), LOCAL)
    told = ["key", "local", "speaker", "name", "sim"]
    assert rows(bank.recognise(turns(), local()), *told) == [] and rows(bank.speakers(), "speaker") == []
    first = turns(("a", "x", 5.0), ("a", "x", 2.0), ("a", "y", 1.0), ("a", "mute", 3.0), ("a", None, 0.0), (None, "x", 0.0), ("a", "untimed", None))
    voices = local(("a", "x", [2.0, 0.0]), ("a", "x", [2.0, 0.0]), ("a", "y", [0.0, 3.0]), ("a", "mute", None), ("a", "unsaid", [1.0, 1.0]))
    expected = [("a", "mute", 0, "SPKR_000", None), ("a", "x", 1, "SPKR_001", None), ("a", "y", 2, "SPKR_002", None)]
    assert rows(bank.recognise(first, voices), *told) == expected
    assert rows(bank.recognise(first, voices), *told) == expected  # again: nobody is new
    second = bank.recognise(turns(("b", "x", 0.0), ("b", "z", 0.0)), local(("b", "x", [0.1, 9.0]), ("b", "z", [-1.0, 0.0])))
    (x, z) = rows(second, *told)
    assert x[:4] == ("b", "x", 2, "SPKR_002") and x[4] == pytest.approx(9 / (81.01**0.5), abs=1e-8) and z == ("b", "z", 3, "SPKR_003", None)
    names = lambda *x: bank.confirm(spark.createDataFrame(list(x), "speaker bigint, character string, scene string"))
    names((1, "Ann", "s1"), (1, "Bea", "s2"), (2, None, None), (None, "Cy", None))
    names((2, "Dee", None))
    names((2, "Eve", "s3"))
    assert rows(bank.speakers(), "speaker", "first_seen", "character", "scene", "confirmed") == [(0, 3.0, None, None, False), (1, 2.0, "Ann", "s1", True), (2, 1.0, "Eve", "s3", True), (3, 0.0, None, None, False)]
    other = SpeakerBank(spark, str(tmp_path / "bank"), "m2")  # voices of another model are not compared, numbers go on
    assert rows(other.recognise(turns(("c", "x", 0.0)), local(("c", "x", [2.0, 0.0, 0.0]))), *told) == [("c", "x", 4, "SPKR_004", None)]


def test_diarize(spark, tmp_path):
    """Chunks that broke off go on; names over chunks follow voices."""
    log = str(tmp_path / "log")
    sounds = {"one": {"b": [1.0, 0.0], "a": [1.0, 0.0]}, "two": {"p": [1.0, 0.1], "q": [0.0, 1.0], "r": None}, "mute": {"p": None}}

    def make():
        def tell(row):
            with open(log, "a") as f:
                f.write(f"{row['key']}/{row['chunk']}\n")
            found = sounds[row["key"]]
            return {"turns": [{"speaker": s, "start": float(k), "end": k + 1.0} for k, s in enumerate(found)], "voices": [{"speaker": s, "v": v} for s, v in found.items()]}

        return tell

    def asked():
        with open(log) as f:
            lines = sorted(f.read().split())
        open(log, "w").close()
        return lines

    chunks = lambda stamp: spark.createDataFrame([("one", 0, 0.0, 10.0, "s"), ("two", 0, 0.0, 10.0, "s"), ("two", 1, 10.0, 20.0, stamp), ("two", 1, 10.0, 20.0, stamp), ("mute", 0, 0.0, 10.0, "s"), ("mute", 1, 10.0, 12.0, None), (None, 0, 0.0, 1.0, "s")], "key string, chunk int, start double, end double, stamp string")
    cache = Cache(spark, str(tmp_path / "cache"), stages.DIARIZED)
    turns, voices = stages.diarize(chunks("s"), make, cache)
    assert asked() == ["mute/0", "mute/1", "one/0", "two/0", "two/1"]
    expected = [("mute", "SPEAKER_00_p", 0.0, 1.0), ("mute", "SPEAKER_01_p", 10.0, 11.0), ("one", "SPEAKER_00", 1.0, 2.0), ("one", "SPEAKER_01", 0.0, 1.0)]
    expected += [("two", name, 10.0 * c + k, 10.0 * c + k + 1) for c in (0, 1) for k, name in enumerate(["SPEAKER_00", "SPEAKER_01", "r"])]
    assert rows(turns, "key", "speaker", "start", "end") == sorted(expected, key=repr)
    assert rows(voices, "key", "speaker", "v") == [("one", "SPEAKER_00", [1.0, 0.0]), ("one", "SPEAKER_01", [1.0, 0.0]), ("two", "SPEAKER_00", [1.0, 0.1]), ("two", "SPEAKER_01", [0.0, 1.0])]
    again, _ = stages.diarize(chunks("later"), make, cache)
    assert asked() == ["two/1"] and rows(again, "key", "speaker", "start", "end") == sorted(expected, key=repr)
    stages.diarize(chunks("later"), make, cache, settings="other")
    assert len(asked()) == 5
    stages.diarize(chunks("later"), make, cache, settings="other", force=True)
    assert len(asked()) == 5
    none, nobody = stages.diarize(chunks("s").limit(0), make, cache)
    assert none.count() == 0 and nobody.count() == 0


def rescue_loop(base, more, total, guard):
    """The same over lists, row by row."""
    taken = [dict(b) for b in base]
    for m in sorted(more, key=lambda r: (r["start"], r["end"])):
        start, end = max(0.0, m["start"]), min(total, m["end"])
        if end - start >= 0.08 and not any(start < t["end"] + guard and end > t["start"] - guard for t in taken):
            taken.append({**m, "start": start, "end": end})
    kept = []
    for t in sorted(taken, key=lambda r: (r["start"], r["end"])):
        start, end = round(max(0.0, t["start"]), 3), round(min(total, t["end"]), 3)
        if end - start < 0.04:
            continue
        if kept and start < kept[-1][2]:
            last = kept[-1]
            last[2] = start = min(max(round((last[2] + start) / 2, 3), round(last[1] + 0.04, 3)), round(end - 0.04, 3))
            if last[2] - last[1] < 0.04:
                kept.pop()
            if end - start < 0.04:
                continue
        kept.append([t["id"], start, end])
    return kept


def test_with_rescued_against_loop(spark):
    rng = random.Random(7)
    data = []
    for key in range(12):
        at = rng.random()
        for k in range(30):
            length = rng.choice([0.02, 0.5, 1.0, 2.0])
            data.append((key, key * 100 + k, round(at, 2), round(at + length, 2), 0.5, k % 3 > 0))
            at += rng.choice([0.3, 0.9, 1.7, 3.1])
    df = spark.createDataFrame(data, "key int, id int, start double, end double, quality double, old boolean")
    totals = df.groupBy("key").agg((F.max("end") - 0.3).alias("total"))
    out = intervals.with_rescued(df.where("old"), df.where("NOT old"), totals, 0.2)
    found, ends = out.where("reason IS NULL").collect(), {r.key: r.total for r in totals.collect()}
    assert any(r.reason for r in out.collect())
    for key, total in ends.items():
        as_rows = lambda old: [dict(id=d[1], start=d[2], end=d[3]) for d in data if d[0] == key and d[5] == old]  # noqa: E731, B023
        expected = rescue_loop(as_rows(True), as_rows(False), total, 0.2)
        mine = sorted(([r.id, r.start, r.end] for r in found if r.key == key), key=lambda r: r[1:])
        assert [r[0] for r in mine] == [r[0] for r in expected]
        assert all(a[1:] == pytest.approx(b[1:], abs=1e-9) for a, b in zip(mine, expected, strict=True))


def test_alignment_diagnostics(spark):
    entries = lambda *x: spark.createDataFrame(list(x), "key string, grp int, start double, end double, text string")
    groups = spark.createDataFrame([("a", 0, "raw"), ("a", 1, None), ("b", 0, "x")], "key string, grp int, raw string")
    before = entries(("a", 0, 2.0, 3.0, "two"), ("a", 0, 0.0, 1.0, "one"), ("a", 1, 0.0, 1.0, None), ("z", 0, 0.0, 1.0, "lost"))
    after = entries(("a", 0, 0.1, 1.0, "one"), ("a", 0, 2.0, 3.4, "two"))
    out = {(r.key, r.grp): r for r in transcript.alignment_diagnostics(groups, before, after).collect()}
    assert len(out) == 3 and out["a", 0].moved == 0.4 and out["a", 0].raw == "raw" and [e.text for e in out["a", 0].before] == ["one", "two"]
    assert (out["a", 1].n_before, out["a", 1].n_after, out["a", 1].moved) == (1, 0, None) and (out["b", 0].n_before, out["b", 0].moved) == (0, None)


def test_sound_timeline(spark):
    events = lambda *x: spark.createDataFrame(list(x), "key string, id int, start double, end double, label string")
    voice, ambience = events(("a", 1, 0.0, 1.0, "laugh"), ("a", 2, 4.0, 5.0, "laugh")), events(("a", 3, 1.2, 2.0, "laugh"), ("a", 4, 3.0, 3.5, "rain"), ("b", 5, 0.0, 1.0, None))
    out = intervals.sound_timeline(voice, ambience, 0.5)
    assert rows(out, "key", "label", "start", "end", "n") == [("a", "laugh", 0.0, 2.0, 2), ("a", "laugh", 4.0, 5.0, 1), ("a", "rain", 3.0, 3.5, 1), ("b", None, 0.0, 1.0, 1)]
    assert intervals.sound_timeline(voice.limit(0), ambience.limit(0), 0.5).count() == 0


def test_shot_audio(spark):
    """Dialogue and sounds within a shot, music over its bounds, ties, empty parts and missing values."""
    shots = spark.createDataFrame([("v", "sh001", 0.0, 10.0), ("v", "sh002", 10.0, 20.0), ("w", "sh001", 0.0, 5.0)], "video string, shot_id string, start double, end double")
    said = spark.createDataFrame([("v", 4.0, 5.0, "A", "later", ""), ("v", 0.0, 2.0, None, "first", "joy"), ("v", 0.0, 2.0, None, "first", "joy"), ("v", 9.0, 11.0, "A", "cut", None), ("v", 1.0, 2.0, "A", None, None), ("v", None, 2.0, "A", "untimed", None)], "video string, start double, end double, speaker string, text string, emotion string")
    sounds = spark.createDataFrame([("v", 10.0, 20.0, "sfx", "door"), ("v", 11.0, 12.0, None, "hum")], "video string, start double, end double, kind string, description string")
    music = spark.createDataFrame([("v", 9.5, 10.5, "bgm", "calm", None), ("v", 20.0, 21.0, "bgm", None, None), ("v", 15.0, 16.0, "song", None, "piano")], "video string, start double, end double, kind string, mood string, instruments string")
    out = dict((tuple(r[:2]), r[2]) for r in scenes.shot_audio(shots, said, sounds, music).collect())
    assert out["v", "sh001"].split("\n") == ["Dialogue:", '  ?: "first" [joy]', '  ?: "first" [joy]', '  A: "later"', "Music:", "  [bgm] mood: calm"]
    assert out["v", "sh002"].split("\n") == ["Sounds:", "  [sfx] door (10.0s-20.0s)", "  [?] hum (11.0s-12.0s)", "Music:", "  [bgm] mood: calm", "  [song] instruments: piano"]
    assert out["w", "sh001"] == scenes.NOTHING_HEARD and len(out) == 3
    assert scenes.shot_audio(shots.limit(0), said, sounds, music).count() == 0
    assert {r[2] for r in scenes.shot_audio(shots, said.limit(0), sounds.limit(0), music.limit(0)).collect()} == {scenes.NOTHING_HEARD}


def test_times_of_sounds_are_rounded_from_their_exact_value(spark):
    """As SQL's printf does: ties to even, and what lies a little beside a tie to its own side."""
    from storyloom.functions.text import tenths

    rng = np.random.default_rng(9)
    some = [0.25, 0.35, 0.75, 9.95, 0.05, 0.15, 0.95, 0.0, -0.0, -0.04, -0.25, -2.65, 1704067200.25, 1704067200.35, 1704067200.05, 1704067200.95, 2.0**53, 1e-300, 0.9999999999999999, 0.15000000000000002]
    some += [float(v) for v in np.concatenate([rng.integers(0, 10**6, 500) / 100, 1704067200 + rng.integers(0, 10**9, 500) / 20, rng.random(500), rng.normal(size=500) * 1e6])]
    out = spark.createDataFrame(list(enumerate(some)), "k int, v double").select("k", tenths(F.col("v")).alias("t")).collect()
    assert {r.k: r.t for r in out} == {k: "%.1f" % v for k, v in enumerate(some)}
    shots = spark.createDataFrame([("v", "sh001", 0.0, 10.0)], "video string, shot_id string, start double, end double")
    sounds = spark.createDataFrame([("v", 0.25, 0.35, "sfx", "door")], "video string, start double, end double, kind string, description string")
    said = spark.createDataFrame([], "video string, start double, end double, speaker string, text string, emotion string")
    music = spark.createDataFrame([], "video string, start double, end double, kind string, mood string, instruments string")
    assert scenes.shot_audio(shots, said, sounds, music).first().summary == "Sounds:\n  [sfx] door (0.2s-0.3s)"


def test_frames_by_position(spark):
    shots = spark.createDataFrame([("v", "sh002", 5.0), ("v", "sh001", 0.0), ("v", "sh003", 9.0), ("w", "sh001", 0.0)], "video string, shot_id string, start double")
    frames = spark.createDataFrame([("v", 2, "b"), ("v", 1, "a")], "video string, at int, path string")
    assert rows(scenes.with_frames(shots, frames), "video", "shot_id", "path") == [("v", "sh001", "a"), ("v", "sh002", "b")]
    named = spark.createDataFrame([("v", "k2", "b"), ("v", "k1", "a"), ("x", "k1", "c")], "video string, shot_id string, path string")
    assert rows(scenes.with_frames(shots, named), "video", "shot_id", "path") == [("v", "sh001", "a"), ("v", "sh002", "b")]
