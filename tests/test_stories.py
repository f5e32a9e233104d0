"""The novel path from a source to documents, with scripted models; tasks, snapshots, streams and search."""

import json
import os
import time
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom import cli, models
from storyloom.models import fakes
from storyloom.operators import entities, scenes, search
from storyloom.plans import snapshots, stages, tasks
from storyloom.sources import books, stories
from storyloom.streaming import timelines


def texts(spark, *values):
    return spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(values)], "doc string, text string")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_text_chapters(spark):
    got = rows_of(books.split_text(texts(spark, "Before\n\nChapter 1\none\n第二章 夜\ntwo\nInterlude\n\nForeword now\nx", "plain\ntext", "", "# Chapter 3: End\nbody\n## Not one\nmore", "Chapter 1\n\nChapter 2")), "doc", "index", "title", "path", "content")
    assert got == [
        ("d0", 0, "Before", "line:1", "Before"), ("d0", 1, "Chapter 1", "line:3", "one"), ("d0", 2, "第二章 夜", "line:5", "two"), ("d0", 3, "Foreword now", "line:9", "x"),
        ("d1", 0, "plain", "", "plain\ntext"), ("d2", 0, "Chapter 1", "", ""), ("d3", 0, "Chapter 3: End", "line:1", "body\n## Not one\nmore"), ("d4", 0, "Chapter 1", "", "Chapter 1\n\nChapter 2"),
    ]


def test_markdown_chapters(spark):
    cut = lambda text, **kw: rows_of(books.split_markdown(texts(spark, text), books.SplitConfig(**kw)), "title", "path", "content")
    text = "# Book\n\n## One\na\n## Two\nb\n### Deep\nc\n## Empty\n"
    assert cut(text) == [("One", "line:3", "a"), ("Two", "line:5", "b\n### Deep\nc")]
    assert cut(text, levels=(3,)) == [("Deep", "line:7", "c\n## Empty")] and cut(text, exclude="^One") == [("Two", "line:5", "b\n### Deep\nc")]
    levels = spark.createDataFrame([("d", 0, 1), ("d", 5, 2), ("d", 9, 4), ("e", 0, 2), ("e", 3, 1), ("f", 1, 3)], "doc string, line int, level int")
    assert rows_of(books.chosen_levels(levels), "doc", "chosen") == [("d", 2), ("e", 2), ("f", 3)]
    with pytest.raises(ValueError):
        books.split_markdown_source(texts(spark, "x"), books.SplitConfig(mode="other"))
    assert rows_of(books.split_markdown_source(texts(spark, "no heads\nhere"), books.SplitConfig()), "title", "content") == [("no heads", "no heads\nhere")]
    assert books.split_markdown(texts(spark, "").limit(0)).count() == 0


def test_sources_by_suffix(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="2.xhtml" media-type="application/xhtml+xml"/><item href="1.xhtml" media-type="application/xhtml+xml"/><item href="0.xhtml" media-type="application/xhtml+xml"/><item href="s.css" media-type="text/css"/></manifest></package>')
        z.writestr("OEBPS/1.xhtml", "<p>no title</p>")
        z.writestr("OEBPS/2.xhtml", "<h1>Start</h1><p><ruby>漢字<rt>かんじ</rt></ruby></p>")
        z.writestr("OEBPS/0.xhtml", "<p> </p>")
    assert rows_of(books.read_chapters(spark, str(tmp_path / "b.epub")), "index", "title", "path", "content") == [(0, "Start", "2.xhtml", "Start漢字"), (1, "Chapter 2", "1.xhtml", "no title")]
    (tmp_path / "a.md").write_text("---\nx: 1\n---\n# A\n\n## B\nb\n## C\nc", encoding="utf-8")
    assert rows_of(books.read_chapters(spark, str(tmp_path / "a.md")), "title") == [("B",), ("C",)]
    (tmp_path / "a.txt").write_text("﻿just text", encoding="utf-8")
    assert rows_of(books.read_chapters(spark, str(tmp_path / "a.txt")), "path", "content") == [("text-chapter-0", "just text")]
    with pytest.raises(ValueError):
        books.read_chapters(spark, "x.pdf")


def test_find_end():
    text = "The cat sat.\n\nThe dog ran away from home. The end."
    assert text[: scenes.find_end(text, "cat  sat.", 0)] == "The cat sat."
    assert scenes.find_end(text, "sat.\\nThe dog", 0) == text.index("dog") + 3
    assert scenes.find_end(text, "The dog ran awoy from home.", 0) == text.index("home.") + 5
    assert scenes.find_end("a. a. a.", "a.", 3) == 5
    with pytest.raises(scenes.NotFound):
        scenes.find_end(text, "cow", 0)
    with pytest.raises(scenes.NotFound):
        scenes.find_end(text, "The end.", 0, 10)


def test_segmentation_grows_and_covers():
    text = "One scene ends here. Two begins and goes on. Three is last."
    s = lambda end: {"end_text": end, "location": "x", "time": "", "characters": [], "boundary_type": ""}
    script = [{"scenes": [], "has_more": True, "summary": ""}, RuntimeError("down"), {"scenes": [s("nowhere at all"), s("")], "has_more": True, "summary": "s"}, {"scenes": [s("ends here."), s("")], "has_more": True, "summary": '""'}, {"scenes": [s("goes on."), s("")], "has_more": False, "summary": ""}]
    ask = fakes.Scripted(script)
    got = scenes.segment(text, ask, chunk=10, most=1000)
    assert [(g["scene"], text[g["start"] : g["end"]]) for g in got] == [(0, "One scene ends here."), (1, " Two begins and goes on."), (2, " Three is last.")]
    assert [len(p["chunk"]) for p in ask.asked][:4] == [10, 20, 40, 59] and ask.asked[3]["failed"] == "nowhereatall" and ask.asked[4]["failed"] == ""
    with pytest.raises(ValueError):
        scenes.segment(text, fakes.Scripted([{"scenes": [], "has_more": True, "summary": ""}] * 9), chunk=10)


def scripted(outputs):
    return lambda: fakes.Scripted(outputs)


def test_novel_end_to_end(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "book.txt").write_text("Chapter 1\nAnna met Bo.\n\nBo left.\nChapter 2\nAnna waits.", encoding="utf-8")
    project = tasks.Project.load(str(root), json.dumps({"sources": [{"id": "n", "type": "novel", "path": "book.txt"}], "step_groups": {"all": ["novel", "cross"]}}))
    registry = models.Registry()

    def segmenter():
        cut = fakes.paragraph_segmenter()

        def call(prompt):
            out = cut(prompt)
            for x in out["scenes"]:
                x["characters"] = ["Anna", "the girl"]
            return out

        return call

    def resolver():
        def call(x):
            entry = {"canonical": "Anna", "aliases": ["Anna", "the girl"], "known_facts": ["waits"], "current_state": "", "refuted": [], "candidates": [], "merge_notes": "", "extra_notes": ""}
            places = [{"chapter": s["chapter"], "scene": s["scene"], "alias": "Anna", "canonical": "Anna"} for s in x["scenes"]]
            return {"characters": [entry], "merges": [], "assignments": places, "unresolved": []}

        return call

    def retry():
        return lambda x: {"assignments": [{**m, "canonical": "Anna"} for m in x["missed"]], "unresolved": []}

    def extractor():
        def call(x):
            notes = [{"character": "Anna", "chapter_index": s["chapter_index"], "scene_index": s["scene"], "note": json.dumps({"chapter_index": s["chapter_index"], "scene_index": s["scene"], "t": s["text"][:5]})} for s in x["scenes"]]
            return {"notes": notes, "appends": [{"character": "Anna", "behavioral_patterns": ["waits"], "arc_notes": ""}, {"character": "Bo"}]}

        return call

    for role, make in {"scene_segmenter": segmenter, "alias_resolver": resolver, "alias_retry": retry, "character_extractor": extractor, "synthesizer": lambda: lambda prompt: f"SOUL {len(prompt)} {'waits' in prompt}"}.items():
        registry.register(role, make)
    done = []
    run = tasks.Orchestrator(spark, project, stages.build(spark, registry), done.append)
    assert run.run(["novel"], "n") and run.run_all() and len(done) == 2
    at = root / "processed/n/steps"
    assert sorted(p.name for p in (at / "chapters").glob("*.txt")) == ["ch000.txt", "ch001.txt"]
    manifest = json.loads((at / "scenes/ch000/scenes_manifest.json").read_text())
    assert manifest["scene_count"] == 2 and manifest["chapter_title"] == "Chapter 1" and [s["scene_index"] for s in manifest["scenes"]] == [0, 1]
    aliases = json.loads((at / "aliases/character_aliases.json").read_text())
    assert len(aliases["Anna"]) == 6 and aliases["UNRESOLVED"] == []
    assert "## Aliases\n\n- the girl" in (at / "aliases/Anna/insights.md").read_text()
    assert len(json.loads((at / "characters/Anna/ch000.json").read_text())) == 2 and "### Behavioral Patterns\n\n- waits" in (at / "characters/Anna/insights.md").read_text()
    assert not (at / "characters/Bo/insights.md").exists()
    assert (root / "souls/Anna.md").read_text().endswith("True")
    assert rows_of(run.status(), "complete") == [(True,)] * 5 and not run.run(["novel"], "n")
    found = stories.read_scenes(spark, str(at / "scenes"))
    assert rows_of(found, "chapter", "scene") == [("ch000", 0), ("ch000", 1), ("ch001", 0)] and rows_of(stories.read_canonical(spark, str(at / "aliases/character_aliases.json")), "canonical") == [("Anna",)]
    os.remove(at / "scenes/ch000/scene_001.txt")
    assert rows_of(stories.missing_scenes(spark, str(at / "scenes")), "chapter", "scene") == [("ch000", 1)]
    with pytest.raises(ValueError):
        run.run(["film.shots"], "nobody")


def test_alias_state(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    key = "chapter string, scene int, alias string"
    state = {"registry": one([("A", ["B", "C"]), ("B", [])], "canonical string, candidates array<string>"), "occurrences": one([("c", 0, "b", "B"), ("c", 0, "x", "A")], f"{key}, canonical string"), "unresolved": one([("c", 1, "he", "?"), ("c", 1, "she", "?")], f"{key}, reason string")}
    update = {"characters": one([("D", [])], "canonical string, candidates array<string>"), "merges": one([("B", "A"), ("D", "D")], "absorb string, keep string"), "assignments": one([("c", 1, "he", "D"), ("c", 0, "x", "D")], f"{key}, canonical string"), "unresolved": one([("c", 1, "he", "again"), ("c", 2, "it", "new")], f"{key}, reason string")}
    after = entities.apply_batch(state, update)
    assert rows_of(after["registry"], "canonical", "candidates") == [("A", ["C"]), ("D", [])]
    assert rows_of(after["occurrences"], "alias", "canonical") == [("b", "A"), ("he", "D"), ("x", "D")] and rows_of(after["unresolved"], "alias", "reason") == [("it", "new"), ("she", "?")]
    clash = state["occurrences"].withColumn("keep", F.lit(1))
    assert entities.merged(clash, update["merges"]).columns == clash.columns
    value = json.loads(entities.alias_file(state["registry"], state["occurrences"].union(one([("c", 9, "z", "Q")], f"{key}, canonical string")), state["unresolved"]).first()[0])
    assert list(value) == ["A", "B", "UNRESOLVED"] and value["B"] == [{"chapter": "c", "scene": 0, "alias": "b"}] and len(value["UNRESOLVED"]) == 2


def test_notes_of_many_folders(spark, tmp_path):
    for name, text in {"a/X/1.json": '[{"chapter_index": 1, "scene_index": 0, "k": "é"}, 3]', "b/X/1.json": '[{"k": "é", "scene_index": 0, "chapter_index": 1}, {"chapter_index": 0}]', "a/X/2.json": "not json", "a/X/3.json": '{"k": 1}'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = stories.read_notes(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")])
    assert rows_of(got, "character", "chapter_index") == [("X", 0), ("X", 1)]
    assert rows_of(stories.target_characters(spark, [str(tmp_path / "a")], [str(tmp_path / "b")]), "character") == [("X",)]


def test_shots(spark):
    shots = scenes.shot_ids(spark.createDataFrame([("v", 0, 100), ("v", 100, 105), ("v", 105, 200), ("v", 200, 300)], "video string, start_frame int, end_frame int"))
    assert rows_of(shots, "shot_id", "start_frame") == [("sh001", 0), ("sh002", 105), ("sh003", 200)]
    noted = shots.select("video", "shot_id", F.lit("").alias("note"), F.col("start_frame").cast("double").alias("start"), F.col("end_frame").cast("double").alias("end"))
    script = [{"groups": [{"shots": ["sh001"], "complete": True}, {"shots": ["sh002"], "complete": False}], "summary": "s"}, {"groups": [{"shots": ["sh002", "sh003"], "complete": True}], "summary": ""}]
    groups = scenes.group_shots(noted, scripted(script), batch=2)
    assert rows_of(groups, "group", "shots") == [("fs001", ["sh001"]), ("fs002", ["sh002", "sh003"])]
    assert rows_of(scenes.group_spans(groups, noted), "group", "start", "end") == [("fs001", 0.0, 100.0), ("fs002", 105.0, 300.0)] and scenes.ungrouped(noted, groups).count() == 0


def test_models(spark):
    tries = fakes.Scripted([{"x": "no"}, {"x": 1}])
    assert models.with_retries(tries, models.fields(x=int))(None) == {"x": 1} and len(tries.asked) == 2
    with pytest.raises(models.InvalidOutput):
        models.with_retries(lambda _: 1, models.fields(x=int))(None)
    r = models.Registry(project={"emotion": {"a": 2, "b": 3}})
    r.register("emotion", lambda a, b, c: lambda x: [{"y": a + b + c}], a=1, c=1)
    assert r.settings("emotion", {"b": 5}) == {"a": 2, "b": 5, "c": 1}
    with pytest.raises(ValueError):
        r.factory("prosody")
    assert rows_of(models.apply_model(spark.range(2), r.factory("emotion"), "y int"), "y") == [(6,), (6,)]
    points = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(6)], "id long, v array<double>")
    got = models.sweep(points, lambda k: lambda v: ([int(x[0]) % k for x in v], 0.5), [{"k": 1}, {"k": 2}])
    assert got.count() == 12 and rows_of(got.where("candidate = 1"), "label") == [(0,)] * 3 + [(1,)] * 3


def test_tasks(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    ran = []
    make = lambda **s: tasks.Task("k", [str(tmp_path / "in"), str(tmp_path / "missing")], str(tmp_path / "done"), lambda: ran.append(1), s)
    store = tasks.Store(spark)
    step = tasks.Step("novel.chapters", [make(a=1)])
    assert step.execute(store) and not step.execute(store) and step.complete(store) and step.execute(store, force=True)
    assert make(a=2).stale(store) and not make(a=1).stale(store)
    later = time.time() + 60
    os.utime(tmp_path / "in", (later, later))
    assert make(a=1).stale(store)
    with pytest.raises(ValueError):
        step.execute(store, key="other")
    assert tasks.expand("film.audio")[0] == "film.audio.separate" and tasks.expand("novel.scenes") == ["novel.scenes"]
    with pytest.raises(ValueError):
        tasks.expand("film.aud")
    folder = str(tmp_path / "results")
    rows = lambda *x: spark.createDataFrame(x, "group_id string, span_start int, source_time long, n int")
    tasks.save_results(rows(("a", 1, 5, 1), ("b", 600, 5, 1)), folder)
    tasks.save_results(rows(("a", 1, 6, 2), ("c", 2, 6, 2)), folder)
    done = spark.read.parquet(folder)
    assert rows_of(done, "group_id", "n") == [("a", 2), ("b", 1), ("c", 2)]
    assert rows_of(tasks.pending(rows(("a", 1, 6, 0), ("b", 600, 6, 0)), tasks.newest_results(done)), "group_id") == [("b",)]


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x").write_text("no")
    s = snapshots.Snapshots(str(tmp_path))
    now = datetime(2024, 5, 5, 12, 30)
    first = s.take("x/y", now - timedelta(hours=3))
    (tmp_path / "b.txt").write_text("two")
    second = s.take("z", now)
    assert (first / "a.txt").stat().st_ino == (second / "a.txt").stat().st_ino and not (second / ".git").exists() and (second / "b.txt").read_text() == "two"
    hours = [1, 3, 5, 5.2, 5.4, 23, 30, 31, 50]
    for h in hours:
        (s.folder / f"{now - timedelta(hours=h):%Y%m%d-%H%M%S}_t{h}").mkdir()
    (s.folder / "odd").mkdir()
    gone = s.prune(spark, now)
    left = s.names()
    assert "odd" in left and all(any(n.endswith(f"_t{h}") for n in left) for h in (1, 3, 5, 23, 30, 50)) and len(gone) == 3 - (1 if any(n.endswith("_t31") for n in left) else 0)
    files = spark.createDataFrame([("a", 3, 1, "h"), ("b", 3, 2, "h"), ("c", 3, 2, "i"), (".git/x", 1, 1, "x")], "path string, size long, changed long, digest string")
    assert rows_of(snapshots.changes(files, files.withColumn("changed", F.lit(1)).withColumn("digest", F.lit("h"))), "path", "unchanged") == [("a", True), ("b", True), ("c", False)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "project.json").write_text(json.dumps({"sources": [{"id": "n", "type": "novel", "path": "x.txt"}], "step_groups": {"g": ["novel.chapters"]}}))
    (tmp_path / "x.txt").write_text("Chapter 1\nx")
    base = ["--project", str(tmp_path)]
    assert cli.main(["list", *base]) == 0 and "film.audio.vad" in capsys.readouterr().out
    assert cli.main(["run", *base, "--group", "g", "--source", "n"], spark) == 0 and (tmp_path / "processed/n/steps/chapters/ch000.txt").exists()
    assert cli.main(["status", *base], spark) == 0 and "[x] novel.chapters" in capsys.readouterr().out
    assert cli.main(["run", *base, "--step", "nothing"], spark) == 1 and cli.main(["run", *base, "--step", "novel.chapters"], spark) == 1
    assert cli.main(["backup", *base], spark) == 0


def test_streams(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", at(s), float(s), s + 1.0, "x") for s in (0, 1, 2, 10, 11)] + [("b", at(3), 3.0, 4.0, "y"), ("z", at(500), 500.0, 501.0, "x")]
    frame = spark.createDataFrame(rows, "key string, at timestamp, start double, end double, label string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, made in {"s": timelines.sessions(stream(), "3 seconds", "1 second"), "g": timelines.capped_groups(stream(), 0.5, 100.0, "1 second"), "w": timelines.windows(stream(), "10 seconds", "10 seconds", "1 second"), "d": timelines.first_of_each(stream(), ["key"], "1 second")}.items():
        timelines.run_once(made, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert {(r.key, r.n) for r in read("s").collect()} >= {("a", 3), ("a", 2), ("b", 1)}
    assert {(r.key, r.start, r.end, r.n) for r in read("g").collect()} >= {("a", 0.0, 3.0, 3)}
    assert read("w").where("label = 'x'").agg(F.sum("n")).first()[0] >= 5 and read("d").count() == 3


def test_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", ["p"]), (2, [0.9, 0.1], "b", ["p", "q"]), (3, [0.0, 1.0], "a", [])], "id long, v array<double>, kind string, known_by array<string>")
    assert [r.id for r in search.nearest(rows, [1.0, 0.0], {"known_by": {"$contains": ["p"]}}, 5).collect()] == [1, 2] and [r.id for r in search.nearest(rows, [1.0, 0.0], {"kind": "a"}, 1).collect()] == [1]
    facts = spark.createDataFrame([("x", ["p"], "one", None), ("y", ["p"], "two", "q"), ("z", ["q"], "one", None), ("w", ["p"], "?", None)], "text string, known_by array<string>, phase string, heard_from string")
    assert rows_of(search.known_to(facts, "p", "two", ["one", "two"]), "shown") == [("(heard from q) y",), ("x",)] and rows_of(search.known_to(facts, "p", "one", ["one", "two"]), "shown") == [("x",)]
    side = rows.select("id", F.col("id").alias("order"), "v")
    got = search.align(side, side.where("id < 3"), 0.99, 3)
    assert set(rows_of(got["candidates"], "left", "right")) >= {(1, 1)} and rows_of(got["left_only"], "left") == [(3,)]
    assert rows_of(search.composite_personas(spark.createDataFrame([(True, True, None), (True, False, False)], "a boolean, b boolean, c boolean"), ["a", "b", "c"]), "composite") == [(False,), (True,)]
