"""Subtitle tracks inside Matroska and WebM files, without decoding: a data source that walks over the elements' headers.

A task for each file; it seeks past pictures and sound and reads only the blocks of text tracks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .audio import filesystem
from .subtitles import numbered, without_tags

SCHEMA = "path string, track int, codec string, language string, pos long, start double, end double, text string"
# Element ids of the container.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, KIND, CODEC, LANGUAGE, LANGUAGE_TAG, DURATION = 0xD7, 0x83, 0x86, 0x22B59C, 0x22B59D, 0x23E383
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LASTS = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
SUBTITLES = 17
UNKNOWN = -1


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    language: str = "eng"
    lasts: int = 0  # nanoseconds of a block that does not tell
    compression: int | None = None
    stripped: bytes = b""


class Elements:
    """Headers and contents of a file's elements."""

    def __init__(self, f: pa.NativeFile):
        self.f, self.size = f, f.size()

    def number(self, at: int, keep: bool) -> tuple[int, int]:
        """A number of variable length and its bytes; keep: with its length mark, as ids have it."""
        first = self.f.read_at(1, at)
        if not first or not first[0]:
            raise ValueError(f"no element at byte {at}")
        n = 9 - first[0].bit_length()
        raw = int.from_bytes(self.f.read_at(n, at), "big")
        if keep:
            return raw, n
        value = raw & ((1 << 7 * n) - 1)
        return (UNKNOWN if value == (1 << 7 * n) - 1 else value), n

    def within(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of the elements of a range; one of unknown length reaches to the range's end."""
        while at < end:
            name, a = self.number(at, True)
            size, b = self.number(at + a, False)
            start = at + a + b
            stop = end if size == UNKNOWN else min(start + size, end)
            yield name, start, stop
            at = stop

    def uint(self, start: int, stop: int) -> int:
        return int.from_bytes(self.f.read_at(stop - start, start), "big")

    def raw(self, start: int, stop: int) -> bytes:
        return self.f.read_at(stop - start, start)


def read_track(e: Elements, start: int, stop: int) -> Track:
    t = Track()
    for name, a, b in e.within(start, stop):
        if name == NUMBER:
            t.number = e.uint(a, b)
        elif name == KIND:
            t.kind = e.uint(a, b)
        elif name == CODEC:
            t.codec = e.raw(a, b).rstrip(b"\0").decode()
        elif name in (LANGUAGE, LANGUAGE_TAG):
            t.language = e.raw(a, b).rstrip(b"\0").decode()
        elif name == DURATION:
            t.lasts = e.uint(a, b)
        elif name == ENCODINGS:
            for _, c, d in (x for x in e.within(a, b) if x[0] == ENCODING):
                for _, g, h in (x for x in e.within(c, d) if x[0] == COMPRESSION):
                    t.compression = 0
                    for inner, i, j in e.within(g, h):
                        if inner == ALGORITHM:
                            t.compression = e.uint(i, j)
                        elif inner == SETTINGS:
                            t.stripped = e.raw(i, j)
    return t


def inflated(t: Track, raw: bytes) -> bytes:
    if t.compression is None:
        return raw
    if t.compression == 0:
        return zlib.decompress(raw)
    if t.compression == 3:
        return t.stripped + raw
    raise ValueError(f"track {t.number}: compression {t.compression} is not read")


def shown(codec: str, raw: bytes) -> str:
    """The text of a block: of the ASS kinds the ninth field, its line ends written out."""
    text = raw.rstrip(b"\0").decode("utf-8", "replace")
    if codec in ("S_TEXT/ASS", "S_TEXT/SSA", "S_ASS", "S_SSA"):
        text = text.split(",", 8)[-1].replace("\\N", "\n").replace("\\n", "\n")
    return text


def read_cues(path: str) -> Iterator[tuple]:
    """Rows of SCHEMA of all text tracks, in order of the file; tracks are counted from 0 among the subtitle tracks."""
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        e = Elements(f)
        if e.size < 4 or e.number(0, True)[0] != EBML:
            raise ValueError(f"{path}: not a Matroska file")
        scale, tracks, pos = 1_000_000, {}, 0
        for name, start, stop in e.within(0, e.size):
            if name != SEGMENT:
                continue
            todo, time = [(start, stop)], 0
            while todo:
                at, end = todo.pop()
                for inner, a, b in e.within(at, end):
                    if inner == INFO:
                        scale = next((e.uint(c, d) for n, c, d in e.within(a, b) if n == SCALE), scale)
                    elif inner == TRACKS:
                        found = [read_track(e, c, d) for n, c, d in e.within(a, b) if n == ENTRY]
                        tracks = {t.number: (k, t) for k, t in enumerate(t for t in found if t.kind == SUBTITLES)}
                    elif inner == CLUSTER:  # its elements next, then what follows it; one of unknown length holds the rest
                        todo += [(b, end)] if b < end else []
                        todo.append((a, b))
                        break
                    elif inner == TIME:
                        time = e.uint(a, b)
                    elif inner in (SIMPLE, GROUP):
                        lasts = None
                        if inner == GROUP:
                            parts = {n: (c, d) for n, c, d in e.within(a, b)}
                            if BLOCK not in parts:
                                continue
                            lasts = e.uint(*parts[LASTS]) if LASTS in parts else None
                            a, b = parts[BLOCK]
                        number, n = e.number(a, False)
                        if number not in tracks:
                            continue
                        k, t = tracks[number]
                        if not t.codec.startswith("S_TEXT") and t.codec not in ("S_ASS", "S_SSA"):
                            continue  # pictures
                        if e.raw(a + n + 2, a + n + 3)[0] & 6:
                            raise ValueError(f"{path}: several frames in a block of track {number}")
                        begin = (time + int.from_bytes(e.raw(a + n, a + n + 2), "big", signed=True)) * scale / 1e9
                        until = begin + (lasts * scale / 1e9 if lasts is not None else t.lasts / 1e9)
                        yield path, k, t.codec, t.language, pos, begin, until, shown(t.codec, inflated(t, e.raw(a + n + 3, b)))
                        pos += 1


@dataclass
class File(InputPartition):
    path: str


class MatroskaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[File]:
        fs, local = filesystem(self.path)
        info = fs.get_file_info(local)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [File(self.path)]
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(local, recursive=True)) if x.is_file and x.path.lower().endswith((".mkv", ".mks", ".webm"))]
        return [File(self.path.rstrip("/") + x[len(local.rstrip("/")) :]) for x in sorted(found)] or [File("")]

    def read(self, part: File) -> Iterator[tuple]:
        return read_cues(part.path) if part.path else iter(())


class MatroskaSource(DataSource):
    """``spark.read.format("matroska").load(path)``: the cues of all subtitle tracks."""

    @classmethod
    def name(cls) -> str:
        return "matroska"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatroskaReader:
        return MatroskaReader(self.options)


def read_embedded(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """(path, entry_id, start, end, text) of one subtitle track, as of a subtitle file: tags go, empty texts too."""
    spark.dataSource.register(MatroskaSource)
    rows = spark.read.format("matroska").load(path).where(F.col("track") == track)
    return numbered(rows.select("path", "pos", "start", "end", without_tags(F.col("text")).alias("text")))
