"""Entity resolution: occurrences(chapter, scene, alias[, canonical]) against lookups, registries and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chapter", "scene", "alias"]


def canonical(occurrences: DataFrame, lookup: DataFrame) -> DataFrame:
    """The canonical name of each alias; none or an empty one: the alias itself."""
    found = occurrences.drop("canonical").join(lookup.select(*KEY, "canonical"), KEY, "left")
    return found.withColumn("canonical", F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.col("alias")))


def missed(manifest: DataFrame, resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Listed aliases that are neither resolved nor given up."""
    return manifest.join(resolved.select(*KEY), KEY, "left_anti").join(unresolved.select(*KEY), KEY, "left_anti")


def in_targets(occurrences: DataFrame, targets: DataFrame) -> DataFrame:
    """occurrences whose canonical name is among targets(canonical)."""
    return occurrences.join(targets.select("canonical"), "canonical", "left_semi")


def grouped(registry: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(canonical, places): the occurrences of each registered name in order; names without any keep an empty list."""
    place = F.when(F.col("chapter").isNotNull(), F.struct("chapter", "scene", "alias"))
    held = occurrences.select("canonical", *KEY)
    return registry.select("canonical").join(held, "canonical", "left").groupBy("canonical").agg(F.array_sort(F.collect_list(place)).alias("places"))


def counted(occurrences: DataFrame) -> DataFrame:
    """(canonical, n, chapters): occurrences and distinct chapters of each name."""
    return occurrences.groupBy("canonical").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows of which each key keeps the one of greatest ``order``."""
    top = F.max_by(F.struct(*rows.columns), F.struct(order, F.to_json(F.struct(*rows.columns)))).alias("__top")
    return rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(top).select("__top.*")


def merged(occurrences: DataFrame, merges: DataFrame) -> DataFrame:
    """occurrences with absorbed names replaced: merges(absorb, keep)."""
    named = merges.select(F.col("absorb").alias("canonical"), F.col("keep").alias("__keep"))
    return occurrences.join(named, "canonical", "left").withColumn("canonical", F.coalesce("__keep", "canonical")).drop("__keep").select(*occurrences.columns)


def merged_registry(registry: DataFrame, merges: DataFrame) -> DataFrame:
    """registry(canonical, candidates, ...) without absorbed names, which leave the lists of candidates too.

    A merge of a name with itself takes it from the lists alone.
    """
    gone = merges.where("absorb <> keep").select(F.col("absorb").alias("canonical"))
    listed = merges.agg(F.collect_set("absorb").alias("__gone"))  # one batch's merges
    kept = registry.join(gone, "canonical", "left_anti").join(F.broadcast(listed))
    return kept.withColumn("candidates", F.array_except(F.coalesce("candidates", F.array().cast("array<string>")), "__gone")).drop("__gone").select(*registry.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def apply_batch(state: dict[str, DataFrame], update: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A batch's change of the state: registry(canonical, candidates, ...), occurrences(KEY, canonical), unresolved(KEY, reason).

    update: characters (registry rows), merges(absorb, keep), assignments(KEY, canonical), unresolved(KEY, reason). In
    that order: characters replace, merges rewrite, assignments replace and take keys from the unresolved, what is
    unresolved is noted unless it is assigned.
    """
    registry = merged_registry(upserted(state["registry"], update["characters"], ["canonical"]), update["merges"])
    occurrences = upserted(merged(state["occurrences"], update["merges"]), update["assignments"], KEY)
    open_ = upserted(state["unresolved"], update["unresolved"], KEY).join(occurrences.select(*KEY), KEY, "left_anti")
    return {"registry": registry, "occurrences": occurrences, "unresolved": open_}


def alias_file(registry: DataFrame, occurrences: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(value): one JSON object: each registered name with its places, and UNRESOLVED with reasons.

    Occurrences of names that are not registered are left out.
    """
    place = F.struct(F.col("chapter"), F.col("scene"), F.col("alias"))
    held = registry.select("canonical").join(occurrences.select("canonical", *KEY), "canonical", "left").groupBy("canonical").agg(F.array_sort(F.collect_list(F.when(F.col("chapter").isNotNull(), place))).alias("p"))
    key = F.regexp_extract(F.to_json(F.struct("canonical")), r"(?s)^\{\"canonical\":(.*)\}$", 1)
    objects = held.select(F.concat(key, F.lit(":"), F.to_json("p")).alias("o"), "canonical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("canonical", "o"))), lambda x: x["o"]), ",").alias("all"))
    rest = unresolved.agg(F.to_json(F.array_sort(F.collect_list(F.struct("chapter", "scene", "alias", "reason")))).alias("u"))
    return objects.join(rest).select(F.concat(F.lit("{"), F.when(F.col("all") != "", F.concat("all", F.lit(","))).otherwise(""), F.lit('"UNRESOLVED":'), "u", F.lit("}")).alias("value"))


def coverage(scenes: DataFrame) -> DataFrame:
    """(chapter, covered): scenes(chapter, start, end, total) begin at 0, follow each other and end at the total."""
    w = Window.partitionBy("chapter").orderBy("start", "end")
    ok = (F.col("start") == F.coalesce(F.lag("end").over(w), F.lit(0))) & (F.col("end") > F.col("start"))
    return scenes.withColumn("__ok", ok).groupBy("chapter").agg((F.bool_and("__ok") & (F.max("end") == F.max("total"))).alias("covered"))


def notes_by_chapter(notes: DataFrame, stems: DataFrame) -> DataFrame:
    """(character, stem, value): the JSON notes(character, chapter_index, scene_index, note) of each chapter, by scene.

    stems(chapter_index, stem): of several the last in order; none: ch and three digits.
    """
    named = stems.groupBy("chapter_index").agg(F.max("stem").alias("stem"))
    each = notes.groupBy("character", "chapter_index").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("scene_index", F.lit(0)).alias("scene_index"), "note"))).alias("all"))
    out = each.join(named, "chapter_index", "left").withColumn("stem", F.coalesce("stem", F.format_string("ch%03d", "chapter_index")))
    return out.select("character", "stem", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["note"]), ","), F.lit("]")).alias("value"))


def distinct_notes(notes: DataFrame) -> DataFrame:
    """notes(character, chapter_index, scene_index, note) without repeats of equal JSON, whatever the order of its keys."""
    from ..functions.text import canonical_json

    return notes.withColumn("__key", F.coalesce(canonical_json(F.col("note")), F.col("note"))).dropDuplicates(["character", "__key"]).drop("__key")
