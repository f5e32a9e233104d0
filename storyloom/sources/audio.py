"""Sound files as rows of chunks: a data source whose partitions are byte ranges of PCM WAV files.

``spark.dataSource.register(WavSource)``, then ``spark.read.format("wav").load(path)``. No task reads a whole file: the
driver reads headers, a task seeks to its range. Paths are local or what pyarrow opens (s3, gs, hdfs); a folder gives its
files that end in .wav.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import signals

SCHEMA = "path string, rate int, channels int, chunk long, first long, start long, end long, total long, samples array<float>"


@dataclass
class Header:
    rate: int
    channels: int
    kind: str  # u1, i2, i3, i4, f4 or f8
    offset: int
    total: int  # samples of a channel

    @property
    def width(self) -> int:
        return int(self.kind[1]) * self.channels


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://") if "://" in path else "file://" + os.path.abspath(path))


def read_header(path: str) -> Header:
    """Of a RIFF file: the chunks before the samples are walked over, whatever they are; a stream's unknown length is that of the file."""
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        size = f.size()
        if f.read(12)[:4] != b"RIFF":
            raise ValueError(f"{path}: not a WAV file")
        shape, at = None, 12
        while at + 8 <= size:
            name, n = struct.unpack("<4sI", f.read_at(8, at))
            if name == b"fmt ":
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
                if code == 0xFFFE:
                    code = struct.unpack("<H", f.read_at(2, at + 8 + 24))[0]
                kind = {(1, 8): "u1", (1, 16): "i2", (1, 24): "i3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((code, bits))
                if kind is None:
                    raise ValueError(f"{path}: samples of kind {code} with {bits} bits")
                shape = rate, channels, kind
            elif name == b"data" and shape:
                head = Header(*shape, at + 8, 0)
                head.total = min(n, size - at - 8) // head.width
                return head
            at += 8 + n + n % 2
    raise ValueError(f"{path}: no samples")


def read_samples(path: str, head: Header, first: int, end: int, mono: bool = True) -> np.ndarray:
    """Samples [first, end) as floats within -1 and 1: the mean of the channels, or one row for each channel."""
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        raw = f.read_at((end - first) * head.width, head.offset + first * head.width)
    if head.kind == "i3":
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    elif head.kind == "u1":
        x = (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, "<" + head.kind).astype(float)
        x = x / float(1 << (8 * int(head.kind[1]) - 1)) if head.kind[0] == "i" else x
    x = x.reshape(-1, head.channels)
    return x.mean(1) if mono else x.T


@dataclass
class Range(InputPartition):
    path: str
    head: Header
    low: int  # chunks [low, high)
    high: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.overlap = options["path"], int(options.get("chunk", 1 << 20)), int(options.get("overlap", 0))
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.begin, self.until = options.get("start"), options.get("end")
        if self.chunk < 1 or self.overlap < 0:
            raise ValueError("chunk has to be positive, overlap not negative")

    def span(self, head: Header) -> tuple[int, int]:
        """The samples asked for: [start, end) in seconds, both rounded down, within the file."""
        first = 0 if self.begin is None else min(max(int(float(self.begin) * head.rate), 0), head.total)
        end = head.total if self.until is None else min(max(int(float(self.until) * head.rate), first), head.total)
        return first, end

    def partitions(self) -> list[Range]:
        fs, local = filesystem(self.path)
        info = fs.get_file_info(local)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [self.path] if info.is_file else [self.path.rstrip("/") + x.path[len(local.rstrip("/")) :] for x in fs.get_file_info(pafs.FileSelector(local, recursive=True)) if x.is_file and x.path.lower().endswith(".wav")]
        out = []
        for path in sorted(files):
            head = read_header(path)
            first, end = self.span(head)
            low, high = first // self.chunk, -(-end // self.chunk) if end > first else first // self.chunk
            step = max(1, self.bytes // (self.chunk * head.width))
            out += [Range(path, head, k, min(k + step, high)) for k in range(low, high, step)]
        return out or [Range("", Header(0, 0, "i2", 0, 0), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        first, end = self.span(part.head) if part.high > part.low else (0, 0)
        for k in range(part.low, part.high):
            start, stop = max(k * self.chunk, first), min((k + 1) * self.chunk, end)
            low, high = max(0, start - self.overlap), min(part.head.total, stop + self.overlap)
            x = read_samples(part.path, part.head, low, high).astype(np.float32)
            row = (part.path, part.head.rate, part.head.channels, k, low, start, stop, part.head.total)
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5)
            samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(row, kinds, strict=True)], samples], ["path", "rate", "channels", "chunk", "first", "start", "end", "total", "samples"])


class WavSource(DataSource):
    """Chunks of the mean of a file's channels: samples [start, end) belong to the chunk, ``samples`` has ``overlap`` more on each side, from ``first`` on.

    Options: chunk (samples, 2^20), overlap (0), start and end (seconds of a range), partitionbytes (64 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_wav(spark: SparkSession, path: str, chunk: int = 1 << 20, overlap: int = 0, start: float | None = None, end: float | None = None) -> DataFrame:
    spark.dataSource.register(WavSource)
    reader = spark.read.format("wav").option("chunk", chunk).option("overlap", overlap)
    for name, value in (("start", start), ("end", end)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(path)


def resampled(chunks: DataFrame, target: int) -> DataFrame:
    """chunks at another rate: (path, rate, chunk, start, samples), start being the first sample's number at that rate.

    Chunks need an overlap of ``signals.half_width(rate, target)``; then they join to what the whole file would give.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                path, rate, chunk, first, start, end, total = (batch.column(c)[r].as_py() for c in ("path", "rate", "chunk", "first", "start", "end", "total"))
                x = batch.column("samples")[r].values.to_numpy().astype(float)
                need = signals.half_width(rate, target) if rate != target else 0
                if first > max(0, start - need) or first + len(x) < min(total, end + need):
                    raise ValueError(f"{path}: chunks overlap by less than {need} samples")
                out = signals.resampled(x, rate, target, first, start, end).astype(np.float32)
                samples = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([target], pa.int32()), pa.array([chunk]), pa.array([-(-start * target // rate)]), samples], ["path", "rate", "chunk", "start", "samples"])

    return chunks.mapInArrow(run, "path string, rate int, chunk long, start long, samples array<float>")


def window_samples(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """windows(path, id, start, end: seconds) with rate and samples, put together from the chunks that they touch.

    Windows meet chunks by equal keys; a window is a group of its own chunks' parts. Chunks have no overlap and one size.
    """
    own = chunks.select("path", "rate", "chunk", F.col("start").alias("__a"), F.col("end").alias("__b"), "samples")
    shape = own.groupBy("path").agg(F.first("rate").alias("rate"), F.max(F.col("__b") - F.col("__a")).alias("__size"))
    asked = windows.join(F.broadcast(shape), "path").withColumn("__low", F.floor(F.col("start") * F.col("rate"))).withColumn("__high", F.floor(F.col("end") * F.col("rate")))
    asked = asked.where("__high > __low").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__low") / F.col("__size")), F.floor((F.col("__high") - 1) / F.col("__size")))))
    met = asked.join(own.drop("rate"), ["path", "chunk"])
    low, high = F.greatest("__low", "__a"), F.least("__high", "__b")
    part = F.struct("chunk", F.slice("samples", (low - F.col("__a") + 1).cast("int"), (high - low).cast("int")).alias("x"))
    return met.where(high > low).groupBy("path", "id", "start", "end").agg(F.first("rate").alias("rate"), F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"])).alias("samples"))
