"""Timelines as streams: rows(key, at: timestamp, ...) that arrive late by ``late`` at most."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): rows of a key with no pause over ``gap``, given once a session can't grow any more. end is that of the last row plus the gap."""
    found = rows.withWatermark("at", late).groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(rows: DataFrame, size: str, hop: str, late: str) -> DataFrame:
    """(start, end, label, n): counts of windows that begin every ``hop``."""
    found = rows.withWatermark("at", late).groupBy(F.window("at", size, hop).alias("w"), "label").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "n")


def first_of_each(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """rows without repeats of the keys that come within ``late``."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def capped_groups(rows: DataFrame, gap: float, most: float, late: str) -> DataFrame:
    """(key, start, end, n): rows(key, start, end: seconds, at) in order of arrival, joined while the gap is at most ``gap`` and the whole at most ``most``.

    The state of a key is its open group. A group is given when the next one begins, or when the watermark passes its
    end by the gap.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            start, end, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], start, end, n)], columns=["key", "start", "end", "n"])
            return
        held = state.get if state.exists else None
        for frame in frames:
            for r in frame.sort_values(["start", "end"]).itertuples():
                if held and r.start - held[1] <= gap and r.end - held[0] <= most:
                    held = (held[0], float(r.end), held[2] + 1)
                else:
                    out += [(key[0], *held)] if held else []
                    held = (float(r.start), float(r.end), 1)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int((held[1] + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n"])

    kind = dict(rows.dtypes)["key"]
    return rows.withWatermark("at", late).groupBy("key").applyInPandasWithState(fold, f"key {kind}, start double, end double, n long", "start double, end double, n long", "append", "EventTimeTimeout")


def latest(rows: DataFrame, value: str) -> DataFrame:
    """(key, at, value): the last value of each key so far, by time; for output mode complete or update."""
    return rows.groupBy("key").agg(F.max(F.struct("at", value)).alias("__last")).select("key", F.col("__last.at").alias("at"), F.col(f"__last.{value}").alias("value"))


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Works off all that is there and stops; a later call goes on where this one ended."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
