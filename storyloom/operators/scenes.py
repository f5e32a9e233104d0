"""Scenes of chapters and films: locating ends, folding model outputs into scenes, grouping shots.

The folds are sequential by nature: each step asks a model with what the last one gave. They run for one chapter or
video each, and all of these in parallel.
"""

from __future__ import annotations


from collections.abc import Callable
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tenths
from ..models import apply_model
from . import intervals

MARGIN, RETRIES, SHORT = 500, 5, 10


class NotFound(ValueError):
    """A scene's end that the text does not hold."""

    def __init__(self, end_text: str):
        super().__init__(f"end not found: {end_text[:80]!r}")
        self.end_text = end_text


def find_end(text: str, end_text: str, start: int, limit: int | None = None) -> int:
    """The place after ``end_text`` in text from ``start`` on, blanks left out on both sides.

    A written \\n in it counts as nothing, and from ten characters on a tenth of them may differ, but not the last two.
    """
    wanted = "".join(end_text.split())
    stop = len(text) if limit is None else min(len(text), start + limit)
    places = [k for k in range(start, stop) if not text[k].isspace()]
    held = "".join(text[k] for k in places)
    for form in dict.fromkeys((wanted, wanted.replace("\\n", ""))):
        at = held.find(form) if form else -1
        if at >= 0:
            return places[at + len(form) - 1] + 1
    if len(wanted) >= SHORT:
        close = regex.search(rf"(?:{regex.escape(wanted[:-2])}){{e<={len(wanted) // 10}}}{regex.escape(wanted[-2:])}", held)
        if close:
            return places[close.end() - 1] + 1
    raise NotFound(wanted)


@dataclass
class Cut:
    """How far a chapter is cut, and what the next prompt is told."""

    chunk: int = 4000
    most: int = 32_000
    cursor: int = 0
    size: int = 0
    retries: int = 0
    summary: str = ""
    failed: str = ""
    scenes: list[dict] = field(default_factory=list)

    def grow(self) -> None:
        """A larger chunk after a step that gave nothing; RETRIES times at most."""
        self.retries += 1
        if self.retries > RETRIES:
            raise ValueError(f"no scene at {self.cursor} after {RETRIES} retries")
        self.size = min(self.size * 2, self.most)


def scenes_of(text: str, found: list[dict], has_more: bool, cursor: int, chunk: int) -> list[tuple[int, int, dict]]:
    """(start, end, scene) of a model's scenes from the cursor on, up to one without an end.

    The last one is left to the next step if there is more, and else goes to the text's end.
    """
    out = []
    for k, scene in enumerate(found):
        last = k == len(found) - 1
        if last and not has_more:
            end = len(text)
        elif last or not scene.get("end_text"):
            break
        else:
            end = find_end(text, scene["end_text"], cursor, chunk + len(scene["end_text"]) + MARGIN)
        if end <= cursor:
            raise ValueError(f"empty scene at {cursor}")
        out.append((cursor, end, scene))
        cursor = end
    return out


def segment(text: str, ask: Callable[[dict], dict], chunk: int = 4000, most: int = 32_000) -> list[dict]:
    """The scenes of a text: dicts with scene, start, end and what the model says of each; they cover the text without a gap.

    ``ask`` gets summary, previous, chunk, offset, failed and final, and gives scenes, has_more and summary. After an
    end that is not found the step is repeated from the cursor with a larger chunk.
    """
    cut = Cut(chunk, most, size=chunk)
    while cut.cursor < len(text):
        some = text[cut.cursor : cut.cursor + cut.size]
        prompt = {"summary": cut.summary, "previous": text[max(0, cut.cursor - MARGIN) : cut.cursor], "chunk": some, "offset": cut.cursor, "failed": cut.failed, "final": cut.cursor + len(some) >= len(text)}
        try:
            out = ask(prompt)
        except Exception:  # whatever a model raises
            cut.grow()
            continue
        cut.summary = "" if out["summary"] == '""' else out["summary"]
        try:
            found = scenes_of(text, out["scenes"], out["has_more"], cut.cursor, cut.size)
        except NotFound as e:
            cut.failed = e.end_text
            found = []
        except ValueError:
            found = []
        if not found:
            cut.grow()
            continue
        cut.scenes += [{**scene, "start": a, "end": b} for a, b, scene in found]
        cut.cursor, cut.size, cut.retries, cut.failed = found[-1][1], cut.chunk, 0, ""
    return [{**s, "scene": k} for k, s in enumerate(cut.scenes)]


def segment_chapters(chapters: DataFrame, make: Callable[[], Callable[[dict], dict]], chunk: int = 4000, most: int = 32_000) -> DataFrame:
    """(chapter, scene, start, end, location, time, characters, boundary_type) of chapters(chapter, content). Blank chapters have none."""

    def factory():
        ask = make()

        def call(row: dict) -> list[dict]:
            return [{"chapter": row["chapter"], **{k: s.get(k) for k in ("scene", "start", "end", "location", "time", "characters", "boundary_type")}} for s in segment(row["content"] or "", ask, chunk, most)]

        return call

    schema = "chapter string, scene int, start int, end int, location string, time string, characters array<string>, boundary_type string"
    return apply_model(chapters.select("chapter", "content"), factory, schema)


def shot_ids(shots: DataFrame, least: int = 15) -> DataFrame:
    """shots(video, start_frame, end_frame, ...) of ``least`` frames, numbered sh001, sh002, ... in each video."""
    w = Window.partitionBy("video").orderBy("start_frame", "end_frame")
    return shots.where(F.col("end_frame") - F.col("start_frame") >= least).withColumn("shot_id", F.format_string("sh%03d", F.row_number().over(w)))


def group_shots(shots: DataFrame, make: Callable[[], Callable[[dict], dict]], batch: int = 15) -> DataFrame:
    """(video, group, shots): groups of shot ids that a model makes of shots(video, shot_id, note), batch by batch.

    It gets summary, partial (the open group of the last batch) and shots, and gives groups (shots, complete) and
    summary; an open last group stays for the next batch and, at the end, for the result. Shots in no group are told by
    ``ungrouped``.
    """
    each = shots.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("shot_id", "note"))).alias("shots"))

    def factory():
        ask = make()

        def call(row: dict) -> list[dict]:
            done, partial, summary = [], None, ""
            for low in range(0, len(row["shots"]), batch):
                out = ask({"summary": summary, "partial": partial, "shots": row["shots"][low : low + batch]})
                done += [g["shots"] for g in out["groups"] if g["complete"]]
                if out["groups"]:
                    partial = None if out["groups"][-1]["complete"] else out["groups"][-1]["shots"]
                summary = out["summary"]
            done += [partial] if partial else []
            return [{"video": row["video"], "group": f"fs{k + 1:03d}", "shots": g} for k, g in enumerate(done)]

        return call

    return apply_model(each, factory, "video string, group string, shots array<string>", batch=1)


def ungrouped(shots: DataFrame, groups: DataFrame) -> DataFrame:
    """(video, shot_id) of shots in no group."""
    return shots.select("video", "shot_id").join(groups.select("video", F.explode("shots").alias("shot_id")), ["video", "shot_id"], "left_anti")


def group_spans(groups: DataFrame, shots: DataFrame) -> DataFrame:
    """(video, group, start, end, n): from the start of the first shot of each group to the end of its last one."""
    each = groups.select("video", "group", F.posexplode("shots").alias("pos", "shot_id")).join(shots.select("video", "shot_id", "start", "end"), ["video", "shot_id"])
    return each.groupBy("video", "group").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n"))


def group_frames(groups: DataFrame, frames: DataFrame) -> DataFrame:
    """(video, group, ...): frames(video, shot_id, ...) of the shots of each group; shots without frames give none."""
    return groups.select("video", "group", F.explode("shots").alias("shot_id")).join(frames, ["video", "shot_id"])



# Headings of what is heard in a shot, and what stands for nothing.
HEARD = ("Dialogue:", "Sounds:", "Music:")
NOTHING_HEARD = "[No significant audio]"


def shot_audio(shots: DataFrame, dialogue: DataFrame, sounds: DataFrame, music: DataFrame, width: float = 30.0) -> DataFrame:
    """(video, shot_id, summary): what is heard in each of shots(video, shot_id, start, end), as text for a model.

    dialogue(video, start, end, speaker, text, emotion) and sounds(video, start, end, kind, description) count if they lie
    within the shot, music(video, start, end, kind, mood, instruments) if it overlaps it; lines are in order of time, ties in
    order of their text. Entries without times, or without a text, description or kind of music, are left out; without
    a speaker or kind of sound there is a question mark. A repeated entry is a repeated line. One join by buckets of
    ``width`` seconds takes all three.
    """
    given = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), F.nullif(F.col(c), F.lit("")), F.lit(after)), F.lit(""))
    said = F.concat(F.lit("  "), F.coalesce("speaker", F.lit("?")), F.lit(': "'), "text", F.lit('"'), given("emotion", " [", "]"))
    sound = F.concat(F.lit("  ["), F.coalesce("kind", F.lit("?")), F.lit("] "), "description", F.lit(" ("), tenths(F.col("start").cast("double")), F.lit("s-"), tenths(F.col("end").cast("double")), F.lit("s)"))
    played = F.concat(F.lit("  ["), "kind", F.lit("]"), given("mood", " mood: "), given("instruments", " instruments: "))
    lines = None
    for part, (rows, line) in enumerate([(dialogue, said), (sounds, sound), (music, played)]):
        some = rows.select(F.col("video").alias("key"), "start", "end", F.lit(part).alias("part"), line.alias("line")).where("line IS NOT NULL")
        lines = some if lines is None else lines.union(some)
    within = (F.col("start") >= F.col("start_b")) & (F.col("end") <= F.col("end_b"))
    over = (F.col("end") > F.col("start_b")) & (F.col("start") < F.col("end_b"))
    pairs = intervals.bucketed_pairs(lines, shots.select(F.col("video").alias("key"), "start", "end", "shot_id"), width, F.when(F.col("part") == 2, over).otherwise(within))
    heard = pairs.groupBy(F.col("key").alias("video"), F.col("shot_id_b").alias("shot_id")).agg(F.array_sort(F.collect_list(F.struct("part", "start", "end", "line"))).alias("__heard"))

    def block(part: int, heading: str) -> Column:
        own = F.transform(F.filter("__heard", lambda x: x["part"] == part), lambda x: x["line"])
        return F.when(F.size(own) > 0, F.concat(F.array(F.lit(heading)), own)).otherwise(F.array().cast("array<string>"))

    text = F.nullif(F.array_join(F.concat(*[block(k, heading) for k, heading in enumerate(HEARD)]), "\n"), F.lit(""))
    return shots.select("video", "shot_id").join(heard, ["video", "shot_id"], "left").select("video", "shot_id", F.coalesce(text, F.lit(NOTHING_HEARD)).alias("summary"))


def with_frames(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """shots(video, shot_id, start, ...) with the columns of frames(video, ...) at the same position: the first frame set is the first shot's, and so on.

    Shots are in order of (start, shot_id), frames of their ``shot_id`` if they have one, else of ``at``; what one side has
    beyond the other is left out. For frames that name their shots a join by shot_id does.
    """
    by = "shot_id" if "shot_id" in frames.columns else "at"
    place = lambda *c: F.row_number().over(Window.partitionBy("video").orderBy(*c))
    right = frames.withColumn("__place", place(by))
    return shots.withColumn("__place", place("start", "shot_id")).join(right.drop("shot_id"), ["video", "__place"]).drop("__place")

def with_speaker_names(scenes: DataFrame, updates: DataFrame) -> DataFrame:
    """(scene, speaker, name): for each of scenes(scene) the last name that updates(scene, speaker, name) gave each speaker up to it."""
    speakers = updates.select("speaker").distinct()
    w = Window.partitionBy("speaker").orderBy("scene").rowsBetween(Window.unboundedPreceding, 0)
    known = updates.groupBy("scene", "speaker").agg(F.max("name").alias("name"))
    grid = scenes.select("scene").distinct().join(F.broadcast(speakers)) if speakers.limit(10_001).count() <= 10_000 else scenes.select("scene").distinct().join(speakers)
    return grid.join(known, ["scene", "speaker"], "left").withColumn("name", F.last("name", True).over(w)).where("name IS NOT NULL")


def scene_index(scenes: DataFrame, sounds: DataFrame, music: DataFrame) -> DataFrame:
    """(value): one JSON object of scenes(scene, start, end, location, time_of_day, present, mentioned, text) with tokens and sounds.

    Sounds are the first five descriptions of all sounds(start, description), music the type of the first of music(start, kind), as for every scene.
    """
    from ..functions.text import token_estimate

    first = sounds.orderBy("start", "description").limit(5).agg(F.array_sort(F.collect_list(F.struct("start", "description"))).alias("s"))
    kind = music.agg(F.min_by("kind", F.struct("start", "kind")).alias("m"))
    rows = scenes.join(F.broadcast(first)).join(F.broadcast(kind))
    one = F.struct(F.col("scene").alias("scene_id"), F.struct(F.col("start").alias("start_time"), F.col("end").alias("end_time")).alias("source"), token_estimate(F.col("text")).alias("token_estimate"), "location", "time_of_day", F.struct("present", "mentioned").alias("characters"), F.struct(F.col("m").isNotNull().alias("has_music"), F.col("m").alias("music_type"), F.transform("s", lambda x: x["description"]).alias("notable_sounds")).alias("audio"))
    return rows.agg(F.to_json(F.struct(F.struct(F.lit("1.0").alias("version"), F.count("*").alias("total_scenes")).alias("metadata"), F.array_sort(F.collect_list(one)).alias("scenes"))).alias("value"))


