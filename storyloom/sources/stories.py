"""Scenes, aliases, notes and insights as files: readers, and rows (path, value) that ``write_files`` puts in place.

Readers take a folder and give rows; a missing folder gives none. Paths of rows are relative to the folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators import entities
from .books import parse_chapter_file

SCENES = "chapter_index int, chapter_stem string, chapter_title string, total_length int, scene_count int, scenes array<struct<scene_index:int,location:string,time:string,characters:array<string>,start_offset:int,end_offset:int,file:string>>"
ALIASES = "map<string,array<struct<chapter:string,scene:int,alias:string,reason:string>>>"
# The wording of the files.
UNRESOLVED, NO_INSIGHTS, NO_BACKGROUND = "UNRESOLVED", "(no insights accumulated yet)", "(no background available yet)"
DRAFT = " — Insight Draft\n\n> Auto-generated from alias resolution. To be enriched by character extraction.\n"
INSIGHTS = {"negative_constraints": "Negative Constraints", "behavioral_patterns": "Behavioral Patterns", "simulation_directives": "Simulation Directives", "relationship_insights": "Relationship Insights", "personality_synthesis": "Personality Synthesis"}


def read_folder(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, value, changed): the whole files whose names match, at any depth; path is relative to the folder."""
    root = folder.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], "path string, value string, changed timestamp")
    top = fs.makeQualified(hadoop).toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    at = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring(at, len(top) + 2, 1 << 20).alias("path"), "value", F.col("_metadata.file_modification_time").alias("changed"))


def part(path: Column, k: int) -> Column:
    """A part of a path, from its end: 1 is the name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-k))


def stem(path: Column) -> Column:
    return F.regexp_replace(part(path, 1), r"\.[^.]*$", "")


def read_chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, index, meta, content) of ch*.txt files in order of their number."""
    meta, body = parse_chapter_file(F.col("value"))
    rows = read_folder(spark, folder, "ch*.txt")
    return rows.select(stem(F.col("path")).alias("chapter"), F.regexp_extract(part(F.col("path"), 1), r"\d+", 0).try_cast("int").alias("index"), meta.alias("meta"), body.alias("content")).orderBy("index", "chapter")


def read_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, chapter_index, scene, location, time, characters, start, end, text): scenes of the manifests that have a text file."""
    manifests = read_folder(spark, folder, "scenes_manifest.json").select(part(F.col("path"), 2).alias("chapter"), F.from_json("value", SCENES).alias("m"))
    listed = manifests.select("chapter", F.coalesce("m.chapter_index", F.lit(0)).alias("chapter_index"), F.explode("m.scenes").alias("s"))
    rows = listed.select("chapter", "chapter_index", F.col("s.scene_index").alias("scene"), F.coalesce("s.location", F.lit("")).alias("location"), F.coalesce("s.time", F.lit("")).alias("time"), F.coalesce("s.characters", F.array().cast("array<string>")).alias("characters"), F.col("s.start_offset").alias("start"), F.col("s.end_offset").alias("end"))
    texts = read_folder(spark, folder, "scene_*.txt").select(part(F.col("path"), 2).alias("chapter"), part(F.col("path"), 1).alias("file"), F.col("value").alias("text"))
    return rows.withColumn("file", F.format_string("scene_%03d.txt", "scene")).join(texts, ["chapter", "file"]).drop("file").orderBy("chapter", "scene")


def missing_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, scene) of the manifests without a text file."""
    manifests = read_folder(spark, folder, "scenes_manifest.json").select(part(F.col("path"), 2).alias("chapter"), F.explode(F.from_json("value", SCENES)["scenes"]).alias("s"))
    return manifests.select("chapter", F.col("s.scene_index").alias("scene")).join(read_scenes(spark, folder).select("chapter", "scene"), ["chapter", "scene"], "left_anti")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, scene, alias, canonical, reason) of an alias file; what is unresolved has no canonical name."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", ALIASES)).alias("name", "places"))
    each = rows.select("name", F.posexplode("places").alias("pos", "p"))
    return each.select(F.col("p.chapter").alias("chapter"), F.col("p.scene").alias("scene"), F.col("p.alias").alias("alias"), F.when(F.col("name") != UNRESOLVED, F.col("name")).alias("canonical"), F.col("p.reason").alias("reason"))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """(canonical): the names of an alias file, those without occurrences too."""
    keys = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", ALIASES))).alias("canonical"))
    return keys.where(F.col("canonical") != UNRESOLVED)


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """aliases with a name, one for each place: of several the last in order of names."""
    named = aliases.where("canonical IS NOT NULL")
    return named.groupBy("chapter", "scene", "alias").agg(F.max("canonical").alias("canonical"))


def annotated_scenes(scenes: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """scenes with ``named`` (alias, canonical) in their order, and ``targets``: those among targets(canonical)."""
    each = scenes.select("chapter", "scene", F.posexplode("characters").alias("pos", "alias"))
    named = entities.canonical(each, alias_lookup(aliases)).join(targets.select("canonical", F.lit(True).alias("__on")), "canonical", "left")
    pair = F.struct("pos", "alias", "canonical")
    both = named.groupBy("chapter", "scene").agg(F.array_sort(F.collect_list(pair)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("__on"), pair))).alias("t"))
    plain = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["alias"], x["canonical"])), F.array().cast("array<struct<alias:string,canonical:string>>"))
    return scenes.join(both, ["chapter", "scene"], "left").withColumn("named", plain("n")).withColumn("targets", plain("t")).drop("n", "t")


def read_notes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(character, chapter_index, scene_index, note): the JSON notes of character folders; bad files are passed over, repeats go."""
    found = None
    for folder in folders:
        rows = read_folder(spark, folder, "*.json").select(part(F.col("path"), 2).alias("character"), F.explode(F.from_json("value", "array<string>")).alias("note"))
        found = rows if found is None else found.unionByName(rows)
    whole = found.where(F.col("note").startswith("{"))
    number = lambda k: F.coalesce(F.get_json_object("note", f"$.{k}").try_cast("int"), F.lit(0))
    return entities.distinct_notes(whole.select("character", number("chapter_index").alias("chapter_index"), number("scene_index").alias("scene_index"), "note")).orderBy("character", "chapter_index", "scene_index", "note")


def read_insights(spark: SparkSession, folders: list[str], heading: str) -> DataFrame:
    """(character, order, section) of the insights.md files of character folders."""
    found = None
    for k, folder in enumerate(folders):
        rows = read_folder(spark, folder, "insights.md").select(part(F.col("path"), 2).alias("character"), F.lit(k).alias("order"), F.concat(F.lit(f"## {heading}\n\n<!-- source: {folder.rstrip('/')}/"), "path", F.lit(" -->\n"), "value").alias("section"))
        found = rows if found is None else found.unionByName(rows)
    return found


def combined_insights(characters: DataFrame, sections: DataFrame) -> DataFrame:
    """(character, insights): all sections of each of characters(character) in order; none: a default text."""
    each = sections.groupBy("character").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "section"))), lambda s: s["section"]), "\n\n").alias("insights"))
    return characters.select("character").distinct().join(each, "character", "left").withColumn("insights", F.coalesce("insights", F.lit(NO_INSIGHTS)))


def background(characters: DataFrame, insights: DataFrame) -> DataFrame:
    """(character, background): what is known of each, or that nothing is."""
    return characters.select("character").join(insights.select("character", F.col("value").alias("__v")), "character", "left").select("character", F.coalesce(F.concat(F.lit("### Accumulated Insights\n\n"), "__v"), F.lit(NO_BACKGROUND)).alias("background"))


def target_characters(spark: SparkSession, character_folders: list[str], alias_folders: list[str]) -> DataFrame:
    """(character): all with insights or notes in character folders, or insights in alias folders, in order."""
    found = spark.createDataFrame([], "character string")
    for folder, names in [*((f, ("insights.md", "*.json")) for f in character_folders), *((f, ("insights.md",)) for f in alias_folders)]:
        for name in names:
            found = found.union(read_folder(spark, folder, name).select(part(F.col("path"), 2).alias("character")))
    return found.where("character IS NOT NULL").distinct().orderBy("character")


def character_sources(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(character, changed): the last change of any file of each character's folder."""
    found = spark.createDataFrame([], "character string, changed timestamp")
    for folder in folders:
        found = found.union(read_folder(spark, folder, "*").select(part(F.col("path"), 2).alias("character"), "changed"))
    return found.where("character IS NOT NULL").groupBy("character").agg(F.max("changed").alias("changed"))


def scene_files(chapters: DataFrame, scenes: DataFrame) -> DataFrame:
    """(path, value): the texts and the manifest of each chapter: chapters(chapter, index, title, content), scenes(chapter, start, end, location, time, characters).

    Scenes are numbered by their start over the whole chapter.
    """
    n = (F.row_number().over(Window.partitionBy("chapter").orderBy("start", "end")) - 1).alias("scene_index")
    rows = scenes.select("chapter", n, "start", "end", "location", "time", "characters").join(chapters, "chapter")
    file = F.format_string("scene_%03d.txt", "scene_index")
    texts = rows.select(F.concat_ws("/", "chapter", file).alias("path"), F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))
    one = F.struct("scene_index", "location", "time", "characters", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), file.alias("file"))
    each = rows.groupBy("chapter", "index", "title").agg(F.array_sort(F.collect_list(one)).alias("scenes"), F.max("end").alias("total"))
    manifest = F.to_json(F.struct(F.col("index").alias("chapter_index"), F.col("chapter").alias("chapter_stem"), F.col("title").alias("chapter_title"), F.col("total").alias("total_length"), F.size("scenes").alias("scene_count"), "scenes"))
    return texts.union(each.select(F.concat("chapter", F.lit("/scenes_manifest.json")), manifest))


def _bullets(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n- "), F.array_join(items, "\n- "), F.lit("\n")))


def _paragraph(title: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"## {title}\n\n"), text, F.lit("\n")))


def insight_drafts(registry: DataFrame) -> DataFrame:
    """(path, value): a first draft for each of registry(canonical, aliases, known_facts, current_state, refuted(belief, reason), candidates, merge_notes, extra_notes); only what is known has a section."""
    c = F.col
    names = F.filter("aliases", lambda a: a != c("canonical"))
    refuted = F.transform("refuted", lambda r: F.concat(r["belief"], F.lit("\n  _(Disproved by: "), r["reason"], F.lit(")_")))
    overlap = F.when(F.size("candidates") > 0, F.concat_ws("\n\n", F.concat(F.lit("May be same person as: "), F.array_join("candidates", ", ")), F.nullif(c("merge_notes"), F.lit(""))))
    parts = [
        F.concat(F.lit("# "), "canonical", F.lit(DRAFT)),
        _bullets("Aliases", names), _bullets("Known Facts", c("known_facts")), _paragraph("Current State", c("current_state")),
        _bullets("Refuted Beliefs", refuted), _paragraph("Possible Identity Overlap", overlap), _paragraph("Notes", c("extra_notes")),
    ]
    return registry.select(F.concat(safe_name(c("canonical")), F.lit("/insights.md")).alias("path"), F.concat_ws("\n", *parts).alias("value"))


def insight_appends(appends: DataFrame) -> DataFrame:
    """(character, batch, value): the sections of each batch's appends(character, batch, total, lists of INSIGHTS, arc_notes) that hold anything."""
    some = F.coalesce(F.col("arc_notes"), F.lit("")) != ""
    for k in INSIGHTS:
        some = some | (F.size(F.coalesce(F.col(k), F.array().cast("array<string>"))) > 0)
    parts = [F.when(F.size(k) > 0, F.concat(F.lit(f"### {title}\n\n- "), F.array_join(k, "\n- "), F.lit("\n"))) for k, title in INSIGHTS.items()]
    arc = F.when(F.col("arc_notes") != "", F.concat(F.lit("### Arc Notes\n\n"), "arc_notes", F.lit("\n")))
    head = F.format_string("\n## Batch %d/%d\n", "batch", "total")
    return appends.where(some).select("character", "batch", F.concat_ws("\n", head, *parts, arc).alias("value"))


def insight_files(drafts: DataFrame, appended: DataFrame) -> DataFrame:
    """(path, value): each draft with the appends of its character in order of batches; characters without one begin empty."""
    more = appended.groupBy("character").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "value"))), lambda x: x["value"]), "").alias("__more")).select(F.concat(safe_name(F.col("character")), F.lit("/insights.md")).alias("path"), "__more")
    return drafts.join(more, "path", "full").select("path", F.concat(F.coalesce("value", F.lit("")), F.coalesce("__more", F.lit(""))).alias("value"))


def note_files(notes: DataFrame, stems: DataFrame) -> DataFrame:
    """(path, value): the JSON notes of each character and chapter."""
    return entities.notes_by_chapter(notes, stems).select(F.concat_ws("/", "character", F.concat("stem", F.lit(".json"))).alias("path"), "value")


def synthesis_prompts(notes: DataFrame, insights: DataFrame) -> DataFrame:
    """(character, prompt): all that is known of each of insights(character, insights), for a writer of its document."""
    each = notes.groupBy("character").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "scene_index", "note"))), lambda x: x["note"]), ",\n").alias("all"))
    rows = insights.join(each, "character", "left")
    return rows.select("character", F.concat(F.lit("# Character: "), "character", F.lit("\n\n## Accumulated Insights\n\n"), "insights", F.format_string("\n\n## All Scene Extraction Notes (%d scenes)\n\n", F.coalesce("n", F.lit(0))), F.lit("["), F.coalesce("all", F.lit("")), F.lit("]")).alias("prompt"))


def soul_files(documents: DataFrame) -> DataFrame:
    """(path, value): documents(character, content) under safe names."""
    return documents.select(F.concat(safe_name(F.col("character")), F.lit(".md")).alias("path"), F.col("content").alias("value"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files(path, value) below the folder, each under another name first and then moved; (path, bytes) of them.

    A repeated or speculative task leaves whole files only. Paths must be distinct.
    """
    from pyarrow import fs as pafs

    uri = folder if "://" in folder else "file://" + folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            sizes = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (value.as_py() or "").encode()
                at = f"{top}/{path}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part_ = f"{at}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part_) as f:
                    f.write(data)
                fs.move(part_, at)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select(F.col("path").cast("string"), F.col("value").cast("string")).mapInArrow(run, "path string, bytes long")
