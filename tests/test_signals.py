"""Sound: files in ranges, resampling over chunks, spectra of known signals, boundaries, shots, caches."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import signals
from storyloom.operators import signals as ops
from storyloom.sources import audio, caches


def tone(hz, seconds, rate, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def save(path, x, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(np.rint(np.repeat(x[:, None], channels, 1) * 32767).astype("<i2").tobytes())


def joined(rows):
    return np.concatenate([np.array(r.samples)[r.start - r.first : r.end - r.first] for r in sorted(rows, key=lambda r: r.chunk)])


def test_chunks_join_to_the_file(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, 10_007)
    save(tmp_path / "a.wav", x, 8000, channels=2)
    (tmp_path / "note.txt").write_text("no sound")
    whole = np.rint(x * 32767) / 32768
    for chunk, overlap, size in ((1 << 20, 0, 64 << 20), (1000, 0, 3000), (777, 50, 1), (10_007, 9, 1)):
        spark.dataSource.register(audio.WavSource)
        rows = spark.read.format("wav").option("chunk", chunk).option("overlap", overlap).option("partitionbytes", size).load(str(tmp_path)).collect()
        assert np.abs(joined(rows) - whole).max() < 1e-6 and {(r.rate, r.channels, r.total) for r in rows} == {(8000, 2, 10_007)}
        assert all(r.first == max(0, r.start - overlap) and len(r.samples) == min(10_007, r.end + overlap) - r.first for r in rows)
    part = audio.read_wav(spark, str(tmp_path / "a.wav"), 1000, 0, 0.5, 0.9).collect()
    assert np.abs(joined(part) - whole[4000:7200]).max() < 1e-6 and len(part) == 4
    assert audio.read_wav(spark, str(tmp_path / "a.wav"), start=5.0).count() == 0
    with pytest.raises(Exception, match="not a WAV"):
        audio.read_wav(spark, str(tmp_path / "note.txt")).count()


def test_kinds_of_samples(tmp_path):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    for code, bits, raw in ((1, 8, np.rint(x * 128 + 128).astype("u1").tobytes()), (1, 24, b"".join(int(v * 8388608).to_bytes(3, "little", signed=True) for v in x)), (1, 32, (x * 2147483648).astype("<i4").tobytes()), (3, 32, x.astype("<f4").tobytes()), (3, 64, x.astype("<f8").tobytes())):
        head = struct.pack("<HHIIHH", code, 1, 100, 100 * bits // 8, bits // 8, bits)
        body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", 0xFFFFFFFF) + raw  # an odd chunk before, an unknown length
        (tmp_path / "k.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + body)
        h = audio.read_header(str(tmp_path / "k.wav"))
        assert h.total == 4 and np.abs(audio.read_samples(str(tmp_path / "k.wav"), h, 0, 4) - x).max() < 1e-7


@pytest.mark.parametrize("rate,target", [(44_100, 16_000), (16_000, 44_100), (8000, 8000)])
def test_resampled_chunks_equal_the_whole(spark, tmp_path, rate, target):
    x = tone(440, 0.7, rate) + tone(1234, 0.7, rate, 0.2)
    save(tmp_path / "a.wav", x, rate)
    kept = np.concatenate([r.samples for r in audio.read_wav(spark, str(tmp_path / "a.wav")).collect()]).astype(float)
    whole = signals.resampled(kept, rate, target)
    half = signals.half_width(rate, target)
    got = sorted(audio.resampled(audio.read_wav(spark, str(tmp_path / "a.wav"), 5000, half), target).collect(), key=lambda r: r.chunk)
    assert np.abs(np.concatenate([r.samples for r in got]) - whole.astype(np.float32)).max() < 1e-9 and [r.start for r in got] == np.cumsum([0, *[len(r.samples) for r in got[:-1]]]).tolist()
    for low in (0, 1, 777, 5000):  # in doubles
        a, b = max(0, low - half), min(len(kept), low + 3000 + half)
        part = signals.resampled(kept[a:b], rate, target, a, low, low + 3000)
        k = -(-low * target // rate)
        assert np.abs(part - whole[k : k + len(part)]).max() < 1e-9
    spectrum = np.abs(np.fft.rfft(whole * np.hanning(len(whole))))
    assert abs(spectrum.argmax() * target / len(whole) - 440) < 2
    middle = whole[200:-200]
    assert np.abs(middle - (tone(440, 0.7, target) + tone(1234, 0.7, target, 0.2))[200 : 200 + len(middle)]).max() < 2e-3
    if rate != target:
        with pytest.raises(Exception, match="overlap by less"):
            audio.resampled(audio.read_wav(spark, str(tmp_path / "a.wav"), 5000, 2), target).count()


def test_windows_from_chunks(spark, tmp_path):
    x = np.linspace(-0.9, 0.9, 9000)
    save(tmp_path / "a.wav", x, 1000)
    path = str(tmp_path / "a.wav")
    asked = spark.createDataFrame([(path, 1, 0.0, 0.5), (path, 2, 0.9, 3.4), (path, 3, 8.5, 20.0), (path, 4, 2.0, 2.0)], "path string, id int, start double, end double")
    got = {r.id: np.array(r.samples) for r in audio.window_samples(audio.read_wav(spark, path, 700), asked).collect()}
    whole = np.rint(x * 32767) / 32768
    assert set(got) == {1, 2, 3} and all(np.abs(got[k] - w).max() < 1e-6 and len(got[k]) == len(w) for k, w in ((1, whole[:500]), (2, whole[900:3400]), (3, whole[8500:])))


def clicks(bpm, seconds, rate):
    x = np.random.default_rng(2).normal(0, 1e-4, int(seconds * rate))
    for k in np.arange(0.2, seconds - 0.05, 60 / bpm):
        x[int(k * rate) : int(k * rate) + 200] += np.hanning(200) * 0.8 * np.sin(np.arange(200))
    return x


def test_known_signals():
    rate, rng = 22_050, np.random.default_rng(3)
    assert signals.flatness(rng.normal(0, 0.1, rate)) > 0.4 and signals.flatness(tone(440, 1, rate)) < 0.01
    assert signals.key_centre(tone(440, 1, rate), rate) == "A" and signals.key_centre(tone(261.63, 1, rate) + tone(523.25, 1, rate), rate) == "C"
    for bpm in (90, 120, 150):
        assert abs(signals.tempo(clicks(bpm, 8, rate), rate) - bpm) < 3
        assert abs(len(signals.onsets(clicks(bpm, 8, rate), rate)) - len(np.arange(0.2, 7.95, 60 / bpm))) <= 1
    for hz in (110.0, 220.0, 517.3):
        track = signals.pitch_track(tone(hz, 0.6, rate), rate)[3:-3]
        assert np.nanmax(np.abs(track - hz)) < 0.01 * hz and not np.isnan(track).any()
    assert np.isnan(signals.pitch_track(rng.normal(0, 0.1, rate), rate)).mean() > 0.9 and np.isnan(signals.pitch_track(np.zeros(rate), rate)).all()
    assert 900 < signals.centroid(tone(1000, 1, rate), rate) < 1200 and signals.tempo(np.zeros(rate), rate) == 0.0


def test_features_of_rows(spark):
    rate = 16_000
    sweep = 0.3 * np.sin(2 * np.pi * np.cumsum(np.linspace(150, 330, rate)) / rate)
    rows = [("tone", rate, tone(440, 1, rate, 0.05).tolist()), ("noise", rate, np.random.default_rng(1).normal(0, 0.1, rate).tolist()), ("sweep", rate, sweep.tolist()), ("quiet", rate, [1e-5] * rate), ("short", rate, [0.1] * 10), ("none", rate, []), ("null", rate, None)]
    df = spark.createDataFrame(rows, "id string, rate int, samples array<double>").withColumn("speech_share", F.when(F.col("id") == "noise", 0.5).otherwise(0.0)).repartition(2)
    assert {r.id for r in df.where(ops.voice_gate(df)).collect()} == {"tone", "sweep", "short"}
    assert {r.id for r in ops.ambience_windows(df).collect()} >= {"noise"} and "tone" not in {r.id for r in ops.ambience_windows(df).collect()}
    music = {r.id: r for r in ops.music_features(df).collect()}
    assert len(music) == 7 and music["tone"].key_centre == "A" and music["short"].bpm is None and music["null"].energy is None and "samples" not in music["tone"].asDict()
    told = {r.id: r for r in ops.prosody(df).collect()}
    assert told["sweep"].pitch == "rising" and told["tone"].pitch == "steady" and told["noise"].pitch is None and told["quiet"].volume == "quiet" and told["null"].seconds is None


def plain_snap(x, point, left, most, floor, step):
    total = len(x)
    for c in range(point, max(0, point - most) - 1, -step) if left else range(point, min(total, point + most) + 1, step):
        a, b = max(0, c - step), min(total, c + step)
        if b > a and np.abs(x[a:b]).mean() >= floor:
            return c
    return point


def test_energy_snap(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 1, 400) * (rng.random(400) < 0.1)).round(3)
    points = [(k, k + 40, x.tolist()) for k in range(0, 400, 13)]
    got = ops.snapped(spark.createDataFrame(points, "start int, end int, samples array<double>"), 60, 10).collect()
    floor = max(0.004, np.abs(x).max() * 0.08)
    for r in got:
        a, b = plain_snap(x, r.start, True, 60, floor, 10), plain_snap(x, r.end, False, 60, floor, 10)
        a, b = min(max(a, 0), 400), min(max(b, 0), 400)
        assert (r.snapped_start, r.snapped_end) == ((a, b) if b > a else (r.start, r.end))
    assert len(got) == len(points)


def test_shots(spark):
    rng, frames, cuts = np.random.default_rng(6), [], {0: [0, 40, 90], 1: [0]}
    for video, n in ((0, 130), (1, 30)):
        look = None
        for f in range(n):
            if f in cuts[video] or f == 93:  # 93 comes too soon after 90
                look = rng.uniform(0, 255, 16)
            frames.append((video, f, (look + rng.normal(0, 1, 16)).tolist()))
    df = spark.createDataFrame(frames, "video int, frame int, v array<double>").repartition(3)
    got = sorted(tuple(r) for r in ops.shots(df).collect())
    assert got == [(0, "sh001", 0, 40), (0, "sh002", 40, 90), (0, "sh003", 90, 130), (1, "sh001", 0, 30)]
    changes = {(r.video, r.frame): r for r in ops.frame_changes(df).collect()}
    by = {(v, f): np.array(x) for v, f, x in frames}
    score = lambda v, f: round(float(np.abs(by[v, f] - by[v, f - 1]).mean()), 9) if f else 0.0
    for (v, f), r in changes.items():
        near = [score(v, k) for k in range(f - 2, f + 3) if k != f and (v, k) in by]
        assert abs(r.change - score(v, f)) < 1e-8 and abs(r.ratio - score(v, f) / np.mean(near)) < 1e-5 * max(1, r.ratio)


def test_cache_recomputes_what_changed(spark, tmp_path):
    cache, ran = caches.Cache(spark, str(tmp_path / "c")), []
    wanted = lambda model: spark.createDataFrame([(f"k{i}", f"audio{i}", model if i < 2 else "old") for i in range(5)], "key string, audio string, model string").withColumn("signature", caches.signature(F.col("audio"), F.col("model")))

    def compute(rows):
        ran.append(sorted(r.key for r in rows.select("key").collect()))
        return rows.select("key", "signature", F.array(F.length("audio").cast("float"), F.length("model").cast("float")).alias("value"))

    first = cache.filled(wanted("old"), compute)
    assert first.count() == 5 and ran == [[f"k{i}" for i in range(5)]]
    cache.filled(wanted("old"), compute)
    cache.filled(wanted("other"), compute)
    assert ran[1:] == [[], ["k0", "k1"]] and cache.valid(wanted("other")).count() == 5 and cache.valid(wanted("old")).count() == 3
    small = cache.compacted(str(tmp_path / "d"))
    assert cache.rows().count() == 7 and small.rows().count() == 5 and small.missing(wanted("other")).count() == 0
    one = spark.range(1).select(caches.signature(F.lit("a"), F.lit("bc")), caches.signature(F.lit("ab"), F.lit("c")), caches.signature(F.lit(None), F.lit("-")), caches.signature(F.lit("-"), F.lit(None))).first()
    assert len(set(one)) == 4
