"""What samples sound like: gates before classification, music features, prosody, boundaries at energy, shots of frames.

Rows carry their samples as an array; Arrow batches of them go through numpy. Null and empty samples give null features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals, speech


def told(rows: DataFrame, tell: Callable[[np.ndarray, int], dict], fields: list[tuple[str, str]]) -> DataFrame:
    """rows(..., rate, samples) without the samples, with what ``tell(samples, rate)`` gives for each; no samples: nulls."""
    kept = [c for c in rows.columns if c != "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"double": pa.float64(), "string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
        for batch in batches:
            rates, out = batch.column("rate").to_pylist(), []
            for r, x in enumerate(batch.column("samples")):
                x = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.empty(0)
                out.append(tell(np.nan_to_num(x), rates[r]) if len(x) else {})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array([o.get(n) for o in out], kinds[k]) for n, k in fields]], [*kept, *[n for n, _ in fields]])

    types = dict(rows.dtypes)
    return rows.select(*kept, F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{n} {k}" for n, k in fields]))


def voice_gate(windows: DataFrame, least_db: float = -45.0, most_speech: float = 0.15) -> Column:
    """Whether a window(samples, speech_share) is loud enough and little enough of it is speech to be told as a vocal sound."""
    return F.coalesce((speech.level_db_floored(F.col("samples")) >= least_db) & (F.col("speech_share") <= most_speech), F.lit(False))


def ambience_windows(windows: DataFrame, least_db: float = -45.0, least_flatness: float = 0.01) -> DataFrame:
    """windows(..., rate, samples) that are loud enough and no pure tones, with flatness; quiet ones go before any spectrum is told."""
    loud = windows.where(F.coalesce((F.size("samples") > 0) & (speech.level_db_floored(F.col("samples")) >= least_db), F.lit(False)))
    return told(loud, lambda x, rate: {"flatness": signals.flatness(x)}, [("flatness", "double")]).where(F.col("flatness") >= least_flatness)


def music_features(segments: DataFrame) -> DataFrame:
    """segments(..., rate, samples) with bpm, key_centre, energy (mean level of frames) and brightness (spectral centroid in Hz); under half a second: nulls."""

    def tell(x: np.ndarray, rate: int) -> dict:
        if len(x) < rate * 0.5:
            return {}
        return {"bpm": int(signals.tempo(x, rate)), "key_centre": signals.key_centre(x, rate), "energy": float(signals.frame_levels(x).mean()), "brightness": signals.centroid(x, rate)}

    return told(segments, tell, [("bpm", "int"), ("key_centre", "string"), ("energy", "double"), ("brightness", "double")])


def prosody(segments: DataFrame) -> DataFrame:
    """segments(..., rate, samples) with db, onsets, seconds, voiced (pitches in Hz of voiced frames) and the classes volume, speech_rate, pitch."""

    def tell(x: np.ndarray, rate: int) -> dict:
        pitches = signals.pitch_track(x, rate)
        return {"onsets": len(signals.onsets(x, rate)), "seconds": len(x) / rate, "db": float(20 * np.log10(signals.frame_levels(x).mean() + 1e-9)), "voiced": pitches[~np.isnan(pitches)].tolist()}

    out = told(segments, tell, [("onsets", "int"), ("seconds", "double"), ("db", "double"), ("voiced", "array<double>")])
    return out.withColumn("volume", speech.volume_class(F.col("db"))).withColumn("speech_rate", speech.rate_class(F.col("onsets"), F.col("seconds"))).withColumn("pitch", speech.pitch_class(F.col("voiced")))


def energy_snap(samples: Column, point: Column, leftwards: bool, max_shift: int, floor: Column, step: int = 160) -> Column:
    """The nearest place from ``point`` on, every ``step`` samples up to ``max_shift`` to one side, whose surroundings reach ``floor``; none: the point.

    A place's surroundings are the step before and the step after it, of which the mean absolute value counts.
    """
    total = F.size(samples)
    side = -1 if leftwards else 1
    places = F.transform(F.sequence(F.lit(0), F.lit(max_shift // step)), lambda k: point + side * step * k)
    inside = F.filter(places, lambda c: (c >= F.greatest(F.lit(0), point - max_shift)) & (c <= F.least(total, point + max_shift)))

    def loud(c: Column) -> Column:
        low, high = F.greatest(F.lit(0), c - step), F.least(total, c + step)
        mean = F.aggregate(F.slice(samples, low + 1, F.greatest(high - low, F.lit(0))), F.lit(0.0), lambda a, x: a + F.abs(x)) / (high - low)
        return (high > low) & (mean >= floor)

    return F.greatest(F.lit(0), F.least(total, F.coalesce(F.get(F.filter(inside, loud), F.lit(0)), point)))


def amplitude_floor(samples: Column) -> Column:
    """The level that a boundary looks for: 0.08 of the peak, 0.004 at least."""
    return F.greatest(F.lit(0.004), 0.08 * F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0)))


def snapped(segments: DataFrame, max_shift: int, step: int = 160) -> DataFrame:
    """segments(start, end: samples; samples of the recording) with snapped_start and snapped_end; both as they were if the ends would meet."""
    floor = amplitude_floor(F.col("samples"))
    both = segments.withColumn("__a", energy_snap(F.col("samples"), F.col("start"), True, max_shift, floor, step)).withColumn("__b", energy_snap(F.col("samples"), F.col("end"), False, max_shift, floor, step))
    fine = F.col("__b") > F.col("__a")
    return both.where(F.col("end") > F.col("start")).withColumn("snapped_start", F.when(fine, F.col("__a")).otherwise(F.col("start"))).withColumn("snapped_end", F.when(fine, F.col("__b")).otherwise(F.col("end"))).drop("__a", "__b")


def frame_changes(frames: DataFrame, around: int = 2) -> DataFrame:
    """frames(video, frame, v) with change (mean absolute difference to the frame before; the first: 0) and ratio: change over the mean change of the ``around`` frames on each side."""
    w = Window.partitionBy("video").orderBy("frame")
    before = F.lag("v").over(w)
    change = F.when(before.isNotNull(), F.aggregate(F.zip_with("v", before, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / F.size("v")).otherwise(0.0)
    rows = frames.withColumn("change", F.round(change, 9))
    near = w.rowsBetween(-around, around)
    mean = (F.sum("change").over(near) - F.col("change")) / F.greatest(F.count("change").over(near) - 1, F.lit(1))
    return rows.withColumn("ratio", F.round(F.when(mean > 1e-9, F.col("change") / mean).when(F.col("change") > 1e-9, 255.0).otherwise(0.0), 9)).drop("v")


def shots(frames: DataFrame, threshold: float = 3.0, least_change: float = 15.0, least_frames: int = 15) -> DataFrame:
    """(video, shot_id, start_frame, end_frame) of frames(video, frame, v): cuts where a change stands out from those around it.

    A cut needs ``ratio`` and ``change`` of the two thresholds and ``least_frames`` since the cut before. Only frames that
    may be cuts go through the fold, which holds one number for each video.
    """
    told_ = frame_changes(frames)
    ends = told_.groupBy("video").agg(F.min("frame").alias("__first"), (F.max("frame") + 1).alias("__end"))
    may = told_.where((F.col("ratio") >= threshold) & (F.col("change") >= least_change)).select("video", "frame").join(ends, "video")
    kind, n = dict(frames.dtypes)["video"], int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = object(), 0
        for batch in batches:
            out = []
            for v, frame, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v != video:
                    video, last = v, first
                if frame - last >= least_frames:
                    out.append((v, frame))
                    last = frame
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.int64())], ["video", "frame"])

    cuts = may.select("video", F.col("frame").cast("long").alias("frame"), F.col("__first").cast("long").alias("first")).repartition(n, "video").sortWithinPartitions("video", "frame").mapInArrow(cut, f"video {kind}, frame long")
    starts = cuts.union(ends.select("video", F.col("__first").cast("long")))
    w = Window.partitionBy("video").orderBy("frame")
    found = starts.select("video", F.col("frame").alias("start_frame"), F.lead("frame").over(w).alias("__next")).join(ends, "video")
    return found.select("video", F.format_string("sh%03d", F.row_number().over(Window.partitionBy("video").orderBy("start_frame"))).alias("shot_id"), "start_frame", F.coalesce("__next", F.col("__end").cast("long")).alias("end_frame"))


def dynamics(frames: DataFrame, full: float = 0.2) -> DataFrame:
    """(video, dynamics) of frames(video, frame, v: grey values to 255): the mean change from frame to frame, ``full`` of the range or more being 1; one frame: 0."""
    told_ = frame_changes(frames).withColumn("first", F.min("frame").over(Window.partitionBy("video")))
    change = F.when(F.col("frame") > F.col("first"), F.col("change") / 255)
    return told_.groupBy("video").agg(F.least(F.lit(1.0), F.coalesce(F.avg(change), F.lit(0.0)) / full).alias("dynamics"))
