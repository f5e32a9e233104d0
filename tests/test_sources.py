from storyloom.sources import books, subtitles


def test_srt_round_trip(spark, tmp_path):
    p = tmp_path / "a.srt"
    p.write_text("﻿1\r\n00:00:01,500 --> 00:00:02,000\r\n<i>Hi</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n3\n00:01:03.250 --> 00:01:04.000 align:start\nBye\n")
    rows = subtitles.read_subtitles(spark, str(p)).orderBy("start").collect()
    assert [(r.entry_id, r.start, r.end, r.text) for r in rows] == [("utt_000000", 1.5, 2.0, "Hi\nthere"), ("utt_000001", 63.25, 64.0, "Bye")]
    out = subtitles.render_srt(subtitles.read_subtitles(spark, str(p))).first().value
    assert out == "1\n00:00:01,500 --> 00:00:02,000\nHi\nthere\n\n2\n00:01:03,250 --> 00:01:04,000\nBye\n"


def test_ass(spark, tmp_path):
    p = tmp_path / "a.ass"
    p.write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,D,,0,0,0,,{\\b1}One, two\\Nthree\nComment: x\nDialogue: 0,0:00:03.00,0:00:04.00,D,,0,0,0,,{x}\n")
    assert [(r.start, r.end, r.text) for r in subtitles.read_subtitles(spark, str(p)).collect()] == [(1.0, 2.5, "One, two\nthree")]


def test_plain_chapters(spark):
    texts = spark.createDataFrame([("a", "Intro\nChapter 1 X\nbody\nChapter 2\n\nChapter 3\nend"), ("b", "no heads\nat all"), ("c", "")], "doc string, text string")
    got = {(r.doc, r["index"]): (r.title, r.path, r.content) for r in books.split_text(texts).collect()}
    assert got == {("a", 0): ("Intro", "line:1", "Intro"), ("a", 1): ("Chapter 1 X", "line:2", "body"), ("a", 2): ("Chapter 3", "line:6", "end"), ("b", 0): ("no heads", "", "no heads\nat all"), ("c", 0): ("Chapter 1", "", "")}


def test_markdown_chapters(spark):
    texts = spark.createDataFrame([("a", "# Book\npre\n## One\nx\n## Two\ny\n### sub\nz\n## Empty"), ("b", "plain")], "doc string, text string")
    got = [(r.doc, r["index"], r.title, r.path, r.content) for r in books.split_markdown(texts).orderBy("index").collect()]
    assert got == [("a", 0, "One", "line:3", "x"), ("a", 1, "Two", "line:5", "y\n### sub\nz")]
    files = {r.name: r.value for r in books.chapter_files(books.split_markdown(texts)).collect()}
    assert set(files) == {"ch000.txt", "ch001.txt"} and files["ch000.txt"].endswith("---\nx")
