"""A bank of voices, so that one speaker has one name over all recordings: tables that are only added to, as in ``caches``.

Bank speakers are numbers from 0, with names SPKR_000 and on. A bank has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, vectors
from ..operators.written import Tables
from .caches import Cache, signature


def bank_name(speaker: Column) -> Column:
    return F.format_string("SPKR_%03d", speaker)


class SpeakerBank:
    """A folder of voices, of characters that speakers were confirmed as, and of which local speaker is which of the bank.

    ``model`` says what the vectors come from (its name and settings): voices of another model are never compared.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str):
        at = folder.rstrip("/")
        self.spark, self.model = spark, model
        self.voices = Cache(spark, f"{at}/voices", "struct<v: array<double>, first_seen: double>")
        self.names = Cache(spark, f"{at}/names", "struct<character: string, scene: string>")
        self.known = Cache(spark, f"{at}/known", "struct<speaker: bigint, sim: double>")

    def recognise(self, turns: DataFrame, local: DataFrame, least: float = 0.75) -> DataFrame:
        """(key, local, speaker, name, sim) for the speakers of turns(key, speaker, start); local(key, speaker, v) has their vectors.

        A speaker is the bank's voice of greatest cosine, if that is ``least`` or more (ties: the smallest number), else a
        new voice; sim is null then. New ones of one call are not compared with each other: give them common names first
        (``vectors.merge_local_speakers``). Those recognised before keep their number. Several vectors of a speaker count as
        the mean of their directions; without a vector a speaker is new, and nobody is recognised by it. Turns without
        a key, speaker or start have no part; vectors without turns neither.
        """
        tables = Tables(self.spark, "speaker-bank")
        said = turns.where("key IS NOT NULL AND speaker IS NOT NULL AND start IS NOT NULL").groupBy("key", "speaker").agg(F.min(F.col("start").cast("double")).alias("first_seen"))
        asked = said.select(F.col("key").alias("recording"), F.col("speaker").alias("local"), "first_seen").withColumn("signature", signature(F.col("recording"), F.col("local"), F.lit(self.model)))
        asked = tables.write("asked", asked.withColumn("key", F.col("signature")))
        mean = vectors.centroids(vectors.unit(local.select(signature(F.col("key"), F.col("speaker"), F.lit(self.model)).alias("label"), F.col("v").cast("array<double>").alias("v")))).withColumnRenamed("label", "signature")
        todo = self.known.missing(asked).drop("key").join(mean, "signature", "left").withColumn("key", F.lit(0))
        todo = tables.write("todo", search.places(todo, ["recording", "local"], tables).drop("size"))
        heard = self.voices.newest().where(F.col("signature") == self.model).select(F.col("key").cast("long").alias("label"), F.col("value.v").alias("centroid")).where("centroid IS NOT NULL")
        near = vectors.nearest_centroid(todo.select(F.col("place").alias("id"), F.lit(0).cast("long").alias("label"), F.col("centroid").alias("v")), heard, least)
        told = tables.write("told", todo.join(near.select(F.col("id").alias("place"), F.col("best").alias("speaker"), "sim"), "place", "left"))
        top = self.voices.rows().agg(F.max(F.col("key").cast("long"))).first()[0]
        fresh = search.places(told.where("speaker IS NULL").select("key", "recording", "local", "signature", "first_seen", F.col("centroid").alias("v")), ["recording", "local"], tables)
        fresh = tables.write("fresh", fresh.withColumn("speaker", F.col("place").cast("long") + (0 if top is None else top + 1)))
        self.voices.add(fresh.select(F.col("speaker").cast("string").alias("key"), F.lit(self.model).alias("signature"), F.struct("v", "first_seen").alias("value")))
        met = told.where("speaker IS NOT NULL").select("signature", "speaker", "sim").unionByName(fresh.select("signature", "speaker", F.lit(None).cast("double").alias("sim")))
        self.known.add(met.select(F.col("signature").alias("key"), "signature", F.struct("speaker", "sim").alias("value")))
        out = self.known.valid(asked)
        return out.select(F.col("recording").alias("key"), "local", F.col("value.speaker").alias("speaker"), bank_name(F.col("value.speaker")).alias("name"), F.col("value.sim").alias("sim"))

    def confirm(self, names: DataFrame) -> None:
        """names(speaker, character, scene): who speakers are; the last word counts. Rows without a speaker or a character are left out; of several for one speaker the least character."""
        one = names.where("speaker IS NOT NULL AND character IS NOT NULL").groupBy(F.col("speaker").cast("string").alias("key")).agg(F.min(F.struct("character", "scene")).alias("value"))
        self.names.add(one.select("key", F.lit(self.model).alias("signature"), "value"))

    def speakers(self) -> DataFrame:
        """(speaker, name, first_seen, character, scene, confirmed) of every voice; ``first_seen`` is that of the recording it is from."""
        voices = self.voices.newest().where(F.col("signature") == self.model).select("key", F.col("value.first_seen").alias("first_seen"))
        named = self.names.newest().select("key", "value.character", "value.scene")
        out = voices.join(named, "key", "left").withColumn("speaker", F.col("key").cast("long"))
        return out.select("speaker", bank_name(F.col("speaker")).alias("name"), "first_seen", "character", "scene", F.col("character").isNotNull().alias("confirmed"))
