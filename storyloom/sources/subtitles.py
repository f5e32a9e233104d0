"""SubRip, WebVTT and Advanced SubStation files as rows (path, entry_id, start, end, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_clock, strip

TIMING = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of each file, without byte order marks, with \\n as line end."""
    text = F.regexp_replace(F.replace(F.col("value"), F.lit("﻿"), F.lit("")), "\r\n?", "\n")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.alias("value"))


def numbered(rows: DataFrame) -> DataFrame:
    """Drops empty texts, then numbers what is left of each file."""
    order = Window.partitionBy("path").orderBy("pos")
    return rows.where(F.col("text") != "").withColumn("entry_id", F.format_string("utt_%06d", F.row_number().over(order) - 1)).select("path", "entry_id", "start", "end", "text")


def without_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\{[^}]*\}", ""))


def parse_srt(files: DataFrame) -> DataFrame:
    """Blocks between blank lines with a timing line; the lines after it are the text. Works for SRT and VTT."""
    blocks = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("pos", "block"))
    at = blocks.withColumn("start", F.regexp_extract("block", TIMING, 1)).withColumn("end", F.regexp_extract("block", TIMING, 2)).where("start <> ''")
    body = F.regexp_replace(F.col("block"), rf"(?s)\A.*?{TIMING}[^\n]*\n?", "")
    return numbered(at.select("path", "pos", parse_clock(F.col("start")).alias("start"), parse_clock(F.col("end")).alias("end"), without_tags(body).alias("text")))


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines: ten fields, the text last with its commas; \\N is a line end, {...} is dropped."""
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").startswith("Dialogue:"))
    f = F.split(F.substring(F.col("line"), F.lit(10), F.length("line")), ",", 10)
    rows = lines.select("path", "pos", f.alias("f")).where(F.size("f") == 10)
    text = F.regexp_replace(F.get("f", F.lit(9)), r"\\[Nn]", "\n")
    return numbered(rows.select("path", "pos", parse_clock(F.get("f", F.lit(1))).alias("start"), parse_clock(F.get("f", F.lit(2))).alias("end"), without_tags(text).alias("text")))


def read_subtitles(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """By the file's suffix: .srt, .vtt, .ass, .ssa; of .mkv, .mks and .webm the subtitle track of that number."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("mkv", "mks", "webm"):
        from .matroska import read_embedded

        return read_embedded(spark, path, track)
    if suffix not in ("srt", "vtt", "ass", "ssa"):
        raise ValueError(f"unsupported subtitle format: {path}")
    return (parse_srt if suffix in ("srt", "vtt") else parse_ass)(read_whole(spark, path))


def render_srt(entries: DataFrame) -> DataFrame:
    """(path, value): entries(path, start, end, text) as SubRip text."""
    from ..functions.text import subtitle_time

    order = Window.partitionBy("path").orderBy("start", "end", "text")
    cue = F.concat_ws("\n", F.row_number().over(order).cast("string"), F.concat(subtitle_time(F.col("start")), F.lit(" --> "), subtitle_time(F.col("end"))), F.col("text"), F.lit(""))
    each = entries.select("path", F.row_number().over(order).alias("n"), cue.alias("cue"))
    return each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cue"))), lambda x: x["cue"]), "\n").alias("value"))
