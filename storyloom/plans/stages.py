"""The steps of novels and films as stage functions: tables in, tables out, models by role.

A novel's stages leave the files that readers expect; a film's leave Parquet tables, one folder for each step. Every
stage is a function of DataFrames, so that it can be run without folders too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..models import Registry, apply_model, held
from ..operators import batching, entities, intervals, scenes, transcript, vectors
from ..operators.written import Tables
from ..sources import books, stories
from ..sources.caches import Cache, signature
from .tasks import ALL_SOURCES, FILM, Project, Step, Task

BUDGET, RETRIES = 32_000, 2
PLACE = "struct<chapter:string,scene:int,alias:string,canonical:string>"
ENTRY = "canonical:string,aliases:array<string>,known_facts:array<string>,current_state:string,refuted:array<struct<belief:string,reason:string>>,candidates:array<string>,merge_notes:string,extra_notes:string"
UPDATE = f"characters array<struct<{ENTRY}>>, merges array<struct<absorb:string,keep:string>>, assignments array<{PLACE}>, unresolved array<struct<chapter:string,scene:int,alias:string,reason:string>>"


def story_batches(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """scenes(chapter, scene, text, ...) with ``batch``: greedy batches of a source in order, by estimated tokens."""
    rows = found.withColumn("__pos", F.concat_ws("/", "chapter", F.lpad(F.col("scene").cast("string"), 9, F.lit("0"))))
    numbered = rows.select("__pos", F.lit(0).alias("key"), token_estimate(F.col("text")).alias("tokens")).withColumn("pos", F.row_number().over(Window.orderBy("__pos")))
    cut = batching.token_batches(numbered, budget).join(numbered.select("pos", "__pos"), "pos").select("__pos", "batch")
    return rows.join(cut, "__pos").drop("__pos")


def resolve_aliases(found: DataFrame, ask: Callable[[dict], dict], retry: Callable[[dict], dict], budget: int = BUDGET) -> dict[str, DataFrame]:
    """registry, occurrences and unresolved after all batches of scenes(chapter, scene, characters, text).

    Batches follow each other, as each is told what the last ones found; aliases that a batch leaves out are asked for
    RETRIES times. The driver holds one batch and its answer at a time; the state is tables.
    """
    spark = found.sparkSession
    empty = lambda kind: spark.createDataFrame([], kind)
    flat = "canonical string, aliases array<string>, known_facts array<string>, current_state string, refuted array<struct<belief:string,reason:string>>, candidates array<string>, merge_notes string, extra_notes string"
    state = {"registry": empty(flat), "occurrences": empty("chapter string, scene int, alias string, canonical string"), "unresolved": empty("chapter string, scene int, alias string, reason string")}
    kinds = {"characters": flat, "merges": "absorb string, keep string", "assignments": "chapter string, scene int, alias string, canonical string", "unresolved": "chapter string, scene int, alias string, reason string"}
    batched = story_batches(found, budget).select("batch", "chapter", "scene", "characters", "text")
    batched = batched.checkpoint() if spark.sparkContext.getCheckpointDir() else batched.persist()

    def take(answer: dict) -> None:
        nonlocal state
        update = {k: spark.createDataFrame([tuple(x.get(c.split(" ")[0]) for c in _columns(kind)) for x in answer.get(k, [])], kind) for k, kind in kinds.items()}
        state = entities.apply_batch(state, update)
        if spark.sparkContext.getCheckpointDir():
            state = {k: v.checkpoint() for k, v in state.items()}

    for r in sorted(x[0] for x in batched.select("batch").distinct().collect()):
        rows = batched.where(F.col("batch") == r)
        told = [x.asDict() for x in rows.orderBy("chapter", "scene").collect()]  # one batch of the budget
        take(ask({"scenes": told, "registry": [x.asDict(True) for x in state["registry"].collect()], "batch": r}))
        listed = rows.select("chapter", "scene", F.explode("characters").alias("alias"))
        for _ in range(RETRIES):
            left = [x.asDict() for x in entities.missed(listed, state["occurrences"], state["unresolved"]).collect()]
            if not left:
                break
            take(retry({"missed": left, "scenes": told, "batch": r}))
    return state


def _columns(kind: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in kind:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def extract_notes(found: DataFrame, backgrounds: DataFrame, ask: Callable[[dict], dict], budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(character, chapter_index, scene_index, note) and (character, batch, total, lists of insights, arc_notes) of annotated scenes, batch by batch."""
    spark = found.sparkSession
    batched = story_batches(found, budget)
    known = {r.character: r.background for r in backgrounds.collect()}  # the target characters of a project
    numbers = sorted(x[0] for x in batched.select("batch").distinct().collect())
    notes, appends = [], []
    lists = ", ".join(f"{k} array<string>" for k in stories.INSIGHTS)
    for k, b in enumerate(numbers, 1):
        told = [x.asDict(True) for x in batched.where(F.col("batch") == b).orderBy("chapter", "scene").collect()]
        names = {t["canonical"] for s in told for t in s["targets"]}
        out = ask({"scenes": told, "backgrounds": {n: known[n] for n in sorted(names) if n in known}, "batch": k, "total": len(numbers)})
        notes += [(n["character"], n["chapter_index"], n["scene_index"], n["note"]) for n in out["notes"]]
        appends += [(a["character"], k, len(numbers), *[a.get(x, []) for x in stories.INSIGHTS], a.get("arc_notes", "")) for a in out["appends"]]
        for a in out["appends"]:
            known[a["character"]] = known.get(a["character"], "") + "\n".join(x for k2 in stories.INSIGHTS for x in a.get(k2, []))
    return spark.createDataFrame(notes, "character string, chapter_index int, scene_index int, note string"), spark.createDataFrame(appends, f"character string, batch int, total int, {lists}, arc_notes string")


def synthesize(prompts: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(character, content): a document for each of prompts(character, prompt), all at once."""

    def factory():
        write = make()
        return lambda row: [{"character": row["character"], "content": write(row["prompt"])}]

    return apply_model(prompts, factory, "character string, content string", batch=1)


def film_stage(rows: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str) -> DataFrame:
    """A stage that is a model: rows of the schema for each row."""
    return apply_model(rows, make, schema)


def transcribe(voice: DataFrame, totals: DataFrame, make: Callable[[], Callable[[dict], list[dict]]]) -> DataFrame:
    """Entries of a recording: spans of voice(key, start, end), in groups, recognised, filtered, cut and numbered.

    The recogniser gets key, start and end of a group and gives segments(start, end, text, avg_logprob, language, tokens).
    """
    spans = transcript.speech_spans(voice, totals).withColumnRenamed("index", "id")
    groups = intervals.capped_groups(spans, 0.6, 30.0).select("key", "grp", "start", "end")

    def factory():
        recognise = make()
        return lambda g: [{"key": f"{g['key']}/{g['grp']}/{k}", "recording": g["key"], "chunk_start": g["start"], "chunk_end": g["end"], **s} for k, s in enumerate(recognise(g))]

    schema = f"key string, recording string, chunk_start double, chunk_end double, start double, end double, text string, avg_logprob double, language string, tokens {transcript.TOKENS}"
    segments = apply_model(groups, factory, schema, batch=8)
    return transcript.numbered_entries(transcript.segment_entries(segments).withColumn("recording", F.substring_index("key", "/", 1)), "recording")


def attribute_speakers(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, speaker, total, mean, votes, enrolled) for utterances: windows(id, key, v) vote for the nearest of the clusters of labels(key, label)."""
    known = windows.join(labels, "key").where("label >= 0")
    near = vectors.nearest_centroid(windows.select("id", F.lit(0).alias("label"), "v"), vectors.centroids(vectors.unit(known.select("id", "label", "v"))), 0.2)
    votes = windows.select("id", "key").join(near, "id").select("key", F.col("id").alias("pos"), F.col("best").alias("speaker"), "sim")
    return vectors.weighted_vote(votes, "key")


#: What a diarizer leaves of a chunk, and the schema of a cache of it.
DIARIZED = "struct<turns: array<struct<speaker: string, start: double, end: double>>, voices: array<struct<speaker: string, v: array<double>>>>"


def diarize(chunks: DataFrame, make: Callable[[], Callable[[dict], dict]], cache: Cache, settings: str = "", similarity: float = 0.75, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns(key, speaker, start, end), voices(key, speaker, v)) of recordings cut into chunks(key, chunk, start, end, stamp).

    The diarizer gets a chunk's row and gives turns (in seconds from the chunk's start) and voices (speaker, v) of local
    speakers. What it gave is kept in ``cache`` (schema DIARIZED), chunk by chunk: a run that broke off goes on where it
    stood, and a chunk is told anew only if the recording's stamp, its bounds or the settings changed, or by ``force``.
    Local speakers of several chunks get common names by their voices; in a recording without any voice they are named by
    chunk and local name, and one without a voice among others keeps its local name. In a recording of one chunk they are
    numbered by name. A common voice is the mean of its local ones. Chunks without a key or number have no part; of rows that
    repeat a chunk one counts, the least.
    """
    spark, tables = chunks.sparkSession, Tables(chunks.sparkSession, "diarize")
    each = chunks.where("key IS NOT NULL AND chunk IS NOT NULL").groupBy(F.col("key").cast("string").alias("recording"), F.col("chunk").cast("int").alias("chunk")).agg(F.min(F.struct("start", "end", "stamp")).alias("c")).select("recording", "chunk", "c.*")
    wanted = tables.write("wanted", each.withColumn("key", F.concat_ws("/", "recording", "chunk")).withColumn("signature", signature(F.col("stamp"), F.col("start"), F.col("end"), F.lit(settings))))

    def factory():
        tell = make()

        def one(row: dict) -> list[dict]:
            found = tell({"key": row["recording"], "chunk": row["chunk"], "start": row["start"], "end": row["end"]})
            return [{"key": row["key"], "signature": row["signature"], "value": {"turns": found["turns"], "voices": found["voices"]}}]

        return one

    compute = lambda rows: apply_model(rows, factory, f"key string, signature string, value {DIARIZED}", batch=1)
    if force:
        cache.add(compute(wanted))
    held = tables.write("held", cache.filled(wanted, compute).drop("key").withColumnRenamed("recording", "key"))
    turns = held.select("key", "chunk", F.col("start").alias("at"), F.inline("value.turns")).select("key", "chunk", "speaker", F.round(F.col("at") + F.col("start"), 3).alias("start"), F.round(F.col("at") + F.col("end"), 3).alias("end"))
    voices = held.select("key", "chunk", F.inline("value.voices")).where("v IS NOT NULL")
    known = held.groupBy("key").agg(F.count("*").alias("n")).join(voices.groupBy("key").agg(F.count("*").alias("m")), "key", "left")
    local = turns.where("speaker IS NOT NULL").select("key", "chunk", "speaker").union(voices.select("key", "chunk", "speaker")).distinct().join(known, "key")
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("speaker")) - 1
    alone = local.where("n = 1").select("key", "chunk", "speaker", F.format_string("SPEAKER_%02d", rank).alias("global"))
    silent = local.where("n > 1 AND m IS NULL").select("key", "chunk", "speaker", F.format_string("SPEAKER_%02d_%s", "chunk", "speaker").alias("global"))
    merged = vectors.merge_local_speakers(voices.join(known.where("n > 1").select("key"), "key", "left_semi"), similarity)
    names = tables.write("names", alone.unionByName(silent).unionByName(merged))
    common = voices.join(names, ["key", "chunk", "speaker"]).select("key", F.col("global").alias("speaker"), "v").withColumn("label", signature(F.col("key"), F.col("speaker")))
    of = common.select("label", "key", "speaker").distinct()
    return vectors.global_turns(turns, names).drop("chunk"), of.join(vectors.centroids(common), "label").select("key", "speaker", F.col("centroid").alias("v"))


def build(spark: SparkSession, registry: Registry | None = None) -> Callable[[str, str, Project], Step]:
    """The builder of steps for an orchestrator; roles without a model raise an error when their step runs."""
    registry = registry or Registry()

    def ask(role: str) -> Callable:
        make, key = registry.factory(role), registry.key(role)
        return lambda x: held(key, make)(x)

    def novel(step: str, source: str, project: Project) -> list[Task]:
        s = project.source(source)
        at = lambda name: project.step_folder(source, f"novel.{name}")
        path = project.source_path(s)
        name = step.split(".")[1]

        def chapters():
            stories.write_files(books.chapter_files(books.read_chapters(spark, path, s.config)).select(F.col("name").alias("path"), "value"), at("chapters")).count()

        def cut():
            rows = stories.read_chapter_files(spark, at("chapters"))
            found = scenes.segment_chapters(rows.select("chapter", "content"), registry.factory("scene_segmenter"))
            listed = rows.select("chapter", "index", F.try_element_at("meta", F.lit("title")).alias("title"), "content")
            stories.write_files(stories.scene_files(listed, found), at("scenes")).count()

        def aliases():
            found = stories.read_scenes(spark, at("scenes"))
            state = resolve_aliases(found, ask("alias_resolver"), ask("alias_retry"))
            stories.write_files(stories.insight_drafts(state["registry"]), at("aliases")).count()
            stories.write_files(entities.alias_file(state["registry"], state["occurrences"], state["unresolved"]).select(F.lit("character_aliases.json").alias("path"), "value"), at("aliases")).count()

        def characters():
            file = f"{at('aliases')}/character_aliases.json"
            targets = stories.read_canonical(spark, file)
            found = stories.annotated_scenes(stories.read_scenes(spark, at("scenes")), stories.read_aliases(spark, file), targets)
            drafts = stories.read_folder(spark, at("aliases"), "insights.md").select(stories.part(F.col("path"), 2).alias("character"), "path", "value")
            notes, appends = extract_notes(found, stories.background(targets.withColumnRenamed("canonical", "character"), drafts), ask("character_extractor"))
            stems = found.select("chapter_index", F.col("chapter").alias("stem")).distinct()
            stories.write_files(stories.note_files(notes, stems), at("characters")).count()
            stories.write_files(stories.insight_files(drafts.select("path", "value").limit(0), stories.insight_appends(appends)), at("characters")).count()

        before = {"chapters": [path], "scenes": [at("chapters")], "aliases": [at("scenes")], "characters": [at("scenes"), at("aliases")]}[name]
        run = {"chapters": chapters, "scenes": cut, "aliases": aliases, "characters": characters}[name]
        return [Task(name, before, f"{at(name)}.done", run, dict(s.config) if name == "chapters" else registry.settings({"scenes": "scene_segmenter", "aliases": "alias_resolver", "characters": "character_extractor"}[name]))]

    def film(step: str, source: str, project: Project) -> list[Task]:
        """Each step reads the table of the one before (the first one: the file's path) and leaves what its model gives."""
        role = {"film.shots": "shot_detector", "film.frames": "frame_embedder", "film.audio.separate": "source_separator", "film.audio.vad": "voice_activity", "film.audio.stt": "recognizer", "film.audio.speakers": "speaker_embedder", "film.audio.emotion": "emotion", "film.audio.sound_events": "sound_classifier", "film.audio.music": "music_analyst", "film.shot_groups": "shot_grouper", "film.scenes": "scene_analyst"}[step]
        before = {"film.shots": None, "film.frames": "film.shots", "film.audio.separate": None, "film.audio.vad": "film.audio.separate", "film.audio.stt": "film.audio.vad", "film.audio.speakers": "film.audio.stt", "film.audio.emotion": "film.audio.stt", "film.audio.sound_events": "film.audio.separate", "film.audio.music": "film.audio.separate", "film.shot_groups": "film.frames", "film.scenes": "film.shot_groups"}[step]
        path = project.source_path(project.source(source))
        inputs = project.step_folder(source, before) if before else path

        def run():
            rows = spark.read.parquet(inputs) if before else spark.createDataFrame([(source, path)], "key string, path string")
            schema = registry.settings(role)["schema"]
            film_stage(rows, registry.factory(role), schema).write.mode("overwrite").parquet(project.step_folder(source, step))

        return [Task(step.rsplit(".", 1)[1], [inputs], project.step_folder(source, step) + ".done", run, registry.settings(role))]

    def cross(project: Project) -> list[Task]:
        folders = lambda name: [project.step_folder(s.id, f"novel.{name}") for s in project.sources if s.type == "novel"]

        def run():
            wanted = stories.target_characters(spark, folders("characters"), folders("aliases"))
            parts = stories.read_insights(spark, folders("characters"), "Character Insights").unionByName(stories.read_insights(spark, folders("aliases"), "Alias Insights").withColumn("order", F.col("order") + 1000))
            prompts = stories.synthesis_prompts(stories.read_notes(spark, folders("characters")), stories.combined_insights(wanted, parts))
            stories.write_files(stories.soul_files(synthesize(prompts, registry.factory("synthesizer"))), project.souls_folder()).count()

        return [Task("souls", [*folders("characters"), *folders("aliases")], project.souls_folder() + ".done", run, registry.settings("synthesizer"))]

    def made(step: str, source: str, project: Project) -> Step:
        if source == ALL_SOURCES:
            return Step(step, cross(project))
        return Step(step, film(step, source, project) if step in FILM else novel(step, source, project))

    return made
