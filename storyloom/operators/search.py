"""Retrieval over notes and vectors: search with filters, timelines, what a persona may know, alignment of sources."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .written import Tables


def matches(filters: dict) -> Column:
    """Equality by column; {"$in": values} and {"$contains": values}, of which an array column holds all."""
    out = F.lit(True)
    for name, want in filters.items():
        if isinstance(want, dict) and "$in" in want:
            out = out & F.col(name).isin(*want["$in"])
        elif isinstance(want, dict) and "$contains" in want:
            for x in want["$contains"]:
                out = out & F.array_contains(name, x)
        else:
            out = out & F.col(name).eqNullSafe(F.lit(want))
    return out


def nearest(rows: DataFrame, query: list[float], filters: dict | None = None, k: int = 10) -> DataFrame:
    """The k rows(id, v, ...) of greatest cosine to the query among those that match; ties: the smallest id. Partial top-k in every task."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(matches(filters or {})).withColumn("sim", F.round(cosine(F.col("v"), asked), 9)).orderBy(F.desc("sim"), "id").limit(k)


def character_notes(notes: DataFrame, character: str) -> DataFrame:
    """All notes of a character in order of the story."""
    return notes.where(F.col("character") == character).orderBy("chapter_index", "scene_index")


def dialogues(notes: DataFrame, character: str) -> DataFrame:
    """(chapter_index, scene_index, line) of a character's dialogue samples."""
    return character_notes(notes, character).select("chapter_index", "scene_index", F.explode("dialogue_samples").alias("line"))


def raw_segment(scenes: DataFrame, chapter: str, scene: int) -> DataFrame:
    return scenes.where((F.col("chapter") == chapter) & (F.col("scene") == scene)).select("chapter", "scene", "text")


def known_to(facts: DataFrame, persona: str, phase: str, phases: list[str]) -> DataFrame:
    """facts(text, known_by, phase, ...) that a persona knows by a phase, with ``shown``: what it only heard says so.

    Facts of a later or unknown phase are left out. facts may have ``heard_from``, null for what it saw.
    """
    order = F.create_map(*[x for k, p in enumerate(phases) for x in (F.lit(p), F.lit(k))])
    now = phases.index(phase)
    told = F.col("heard_from") if "heard_from" in facts.columns else F.lit(None).cast("string")
    shown = F.when(told.isNotNull(), F.concat(F.lit("(heard from "), told, F.lit(") "), "text")).otherwise(F.col("text"))
    return facts.where(F.array_contains("known_by", persona) & F.coalesce(F.try_element_at(order, F.col("phase")) <= now, F.lit(False))).withColumn("shown", shown)


def places(rows: DataFrame, order: list[str], tables: Tables) -> DataFrame:
    """rows(key, ...) with place (from 0 within the key, by ``order``) and size (rows of the key): ranges and prefix sums, no window.

    Each range tells its number of rows to the driver; ties of the whole order stand as they come, once and for all.
    """
    spark, by = rows.sparkSession, [F.col(c).asc_nulls_first() for c in ["key", *order]]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    held = tables.write("ranged", ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    base, upto = [], 0
    for part, n in sorted(tuple(r) for r in held.groupBy("__part").count().collect()):
        base.append((part, upto))
        upto += n
    starts = spark.createDataFrame(base, "__part int, __base long")
    placed = held.join(F.broadcast(starts), "__part").withColumn("__at", F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("key").agg(F.min("__at").alias("__first"), F.count("*").alias("size")).withColumnRenamed("key", "__key")
    return placed.join(sizes, F.col("key").eqNullSafe(F.col("__key"))).withColumn("place", F.col("__at") - F.col("__first")).drop("__part", "__base", "__at", "__first", "__key")


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (key, i, j, gain, low), sorted by key, i and j, with the value of the best monotone chain that ends in each and the one before it.

    Held are, of the chains so far, those that no chain of a smaller j and no lower value beats; of those left of ``low``,
    where no later candidate is, the last. So they are as many as the band is wide.
    """
    key, js, held = object(), [], []
    for batch in batches:
        out = []
        for k, i, j, gain, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, js, held = k, [], []
            if (gone := bisect_right(js, low - 1) - 1) > 0:
                del js[:gone], held[:gone]
            at = bisect_right(js, j)
            value, before = (held[at - 1][0] + gain, held[at - 1][1:]) if at else (gain, (None, None))
            out.append((k, i, j, value, *before))
            if not at or value > held[at - 1][0]:
                if at and js[at - 1] == j:
                    at -= 1
                    held[at] = (value, i, j)
                else:
                    js.insert(at, j)
                    held.insert(at, (value, i, j))
                end = at + 1
                while end < len(js) and held[end][0] <= value:
                    end += 1
                del js[at + 1 : end], held[at + 1 : end]
        if out:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "i", "j", "value", "before_i", "before_j"])


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chains' rows with their key's end, sorted by key and downwards, those of the chain that leads to the end."""
    key, wanted = object(), None
    for batch in batches:
        out = []
        for k, i, j, before_i, before_j, end_i, end_j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, wanted = k, (end_i, end_j)
            if (i, j) == wanted:
                out.append((k, i, j))
                wanted = (before_i, before_j)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.int64()), strict=True)], ["key", "i", "j"])


def align(left: DataFrame, right: DataFrame, least: float, width: int) -> dict[str, DataFrame]:
    """Scenes of two sources, rows([key,] id, order, v): ``links``(key, left, right, sim) of the best alignment, ``candidates``, and what has no link on either side.

    Candidates are the pairs of a key whose cosine is over ``least`` and that lie in a band: scene i of n has its partners
    within ``width`` places of i / n of the other source. Links are the candidates of the monotone chain (neither order
    ever goes back; one scene may link to several in a row, on either side) with the greatest sum of cosines over
    ``least``; ties: the chain met first. A key is a pair of sources; without one there is a single pair. Null and zero
    vectors are no candidates. The chain is found by a pass over the candidates in order and a pass back, each of which
    holds no more than the band is wide; keys go side by side.
    """
    tables = Tables(left.sparkSession, "align")
    keyed = lambda df: df if "key" in df.columns else df.withColumn("key", F.lit(0))
    placed = lambda df, name: tables.write(name, places(keyed(df).select("key", "id", "order", "v"), ["order", "id"], tables))
    a, b = placed(left, "left"), placed(right, "right")
    sizes = b.groupBy("key").agg(F.max("size").alias("others"))
    low = F.floor(F.col("place") * F.col("others") / F.col("size")).cast("long") - width
    span = 2 * width + 1
    asked = a.join(sizes, "key").select("key", F.col("id").alias("left"), F.col("place").alias("i"), F.col("v").alias("v_left"), low.alias("low"))
    asked = asked.withColumn("at", F.explode(F.array(F.floor(F.col("low") / span), F.floor(F.col("low") / span) + 1)))
    found = asked.join(b.select("key", F.col("id").alias("right"), F.col("place").alias("j"), F.col("v").alias("v_right"), F.floor(F.col("place") / span).alias("at")), ["key", "at"])
    sim = F.round(cosine(F.col("v_left"), F.col("v_right")), 9)
    pairs = tables.write("pairs", found.where((F.col("j") >= F.col("low")) & (F.col("j") <= F.col("low") + 2 * width)).select("key", "left", "right", "i", "j", "low", sim.alias("sim")).where(F.col("sim") > least))
    parts, kind = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), dict(a.dtypes)["key"]
    ordered = pairs.select("key", "i", "j", (F.col("sim") - least).alias("gain"), "low").repartition(parts, "key").sortWithinPartitions("key", "i", "j")
    chains = tables.write("chains", ordered.mapInArrow(chained, f"key {kind}, i long, j long, value double, before_i long, before_j long"))
    ends = chains.groupBy("key").agg(F.max_by(F.struct("i", "j"), F.struct("value", -F.col("i"), -F.col("j"))).alias("end"))
    back = chains.join(ends, "key").select("key", "i", "j", "before_i", "before_j", "end.i", "end.j").toDF("key", "i", "j", "before_i", "before_j", "end_i", "end_j")
    steps = back.repartition(parts, "key").sortWithinPartitions("key", F.desc("i"), F.desc("j")).mapInArrow(followed, f"key {kind}, i long, j long")
    links = tables.write("links", steps.join(pairs, ["key", "i", "j"]).select("key", "left", "right", "sim"))
    alone = lambda df, name: df.select("key", F.col("id").alias(name)).join(links.select("key", name).distinct(), ["key", name], "left_anti")
    return {"links": links, "candidates": pairs.select("key", "left", "right", "sim"), "left_only": alone(a, "left"), "right_only": alone(b, "right")}


def composite_personas(rows: DataFrame, conditions: list[str], least: int = 2) -> DataFrame:
    """rows with ``composite``: whether at least so many of the boolean columns hold."""
    return rows.withColumn("composite", sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in conditions), F.lit(0)) >= least)


def inconsistent(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """claims(keys, value) that contradict every known value of their keys in facts(keys, value)."""
    known = facts.groupBy(*keys).agg(F.collect_set("value").alias("__known"))
    return claims.join(known, keys).where(~F.array_contains("__known", F.col("value"))).drop("__known")


class Tools:
    """Parameterised queries for an agent that plays a persona."""

    def __init__(self, notes: DataFrame, scenes: DataFrame, facts: DataFrame, vectors: DataFrame, embed):
        self.notes, self.scenes, self.facts, self.vectors, self.embed = notes, scenes, facts, vectors, embed

    def recall_memory(self, question: str, filters: dict | None = None, k: int = 10) -> DataFrame:
        return nearest(self.vectors, self.embed(question), filters, k)

    def lookup_dialogue(self, character: str, words: str) -> DataFrame:
        return dialogues(self.notes, character).where(F.contains(F.lower("line"), F.lower(F.lit(words))))

    def get_world_setting(self, topic: str) -> DataFrame:
        return self.facts.where(F.contains(F.lower("text"), F.lower(F.lit(topic))))

    def get_timeline(self, character: str | None = None) -> DataFrame:
        return (character_notes(self.notes, character) if character else self.notes).orderBy("chapter_index", "scene_index")

    def list_characters(self) -> DataFrame:
        return self.notes.select("character").distinct().orderBy("character")
