"""Texts as chapters: (doc, index, title, path, content) with 0-based index and the 1-based line as path."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, bound, html_text, html_title, infer_title, normalize_text, strip, strip_frontmatter
from .subtitles import read_whole

# Fixed value: what is a chapter title of its own line.
TITLE = (
    r"(?iuU)^(?:"
    r"(?:chapter|chap\.?)\s+\d+[A-Za-z0-9\-.: ]*"
    r"|第\s*[0-9０-９一二三四五六七八九十百千]+(?:\s*[章話卷巻篇部節])(?:\s+.*)?"
    r"|(?:prologue|epilogue|interlude|afterword|foreword|preface|introduction)\b.*"
    r"|(?:序章|終章|番外編|外伝|幕間|後書き|あとがき|前書き|まえがき|序|プロローグ|エピローグ).*)$"
)
MOST = 120
HEADING = r"(?U)^\s*(#{1,6})\s+(.*\S)\s*$"
MODES = ("auto", "markdown_headers", "text_markers", "none")
TEXTS, MARKDOWN = (".txt", ".text"), (".md", ".markdown")


@dataclass(frozen=True)
class SplitConfig:
    """How texts are cut into chapters; patterns are searched in a title."""

    mode: str = "auto"
    levels: tuple[int, ...] = ()
    matcher: str | None = None
    exclude: str | None = None
    title_levels: tuple[int, ...] = (1,)
    text_matcher: str | None = None

    @staticmethod
    def of(source: dict | None) -> SplitConfig:
        """From a source's nested settings, with defaults."""
        cut = dict((source or {}).get("chapter_split") or {})
        markdown, text = dict(cut.get("markdown") or {}), dict(cut.get("text") or {})
        return SplitConfig(cut.get("mode", "auto"), tuple(map(int, markdown.get("levels", ()))), markdown.get("matcher"), markdown.get("exclude_matcher"), tuple(map(int, markdown.get("title_levels", (1,)))), text.get("matcher"))


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def read_texts(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    """(doc, text) of each file; of Markdown without front matter."""
    value = strip_frontmatter(F.col("value")) if markdown else F.col("value")
    return read_whole(spark, path).select(F.col("path").alias("doc"), normalize_text(value).alias("text"))


def title_in(line: Column, matcher: str | None = None) -> Column:
    """The chapter title that a line is; null if it is none. A Markdown heading must look like a title itself."""
    plain = strip(line)
    heading = F.regexp_extract(plain, HEADING, 2)
    shown = F.when(heading != "", heading).otherwise(plain)
    bare = strip(F.btrim(shown, F.lit("#" + BLANKS)))
    return F.when((bare != "") & (F.length(bare) <= MOST) & bare.rlike(matcher or TITLE), shown)


def lines_of(texts: DataFrame) -> DataFrame:
    return texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "value"))


def gather(lines: DataFrame, title: Column) -> DataFrame:
    """(doc, section, line, title, content): sections that start at lines with a title; section 0 stands before the first.

    The heading line is no content.
    """
    order = Window.partitionBy("doc").orderBy("line")
    marked = lines.withColumn("__title", title).withColumn("section", F.sum(F.col("__title").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.groupBy("doc", "section").agg(F.min("line").alias("line"), F.max("__title").alias("title"), F.array_sort(F.collect_list(F.struct("line", F.when(F.col("__title").isNull(), F.col("value")).alias("value")))).alias("rows"))
    return each.select("doc", "section", "line", strip(F.col("title")).alias("title"), strip(F.array_join(F.transform("rows", lambda r: r["value"]), "\n")).alias("content"))


def chapters_of(sections: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc").orderBy("line")
    return sections.select("doc", (F.row_number().over(order) - 1).alias("index"), F.coalesce("title", infer_title(F.col("content"))).alias("title"), F.concat(F.lit("line:"), F.col("line") + 1).alias("path"), "content")


def whole_texts(texts: DataFrame) -> DataFrame:
    """Each text as one chapter without a path."""
    return texts.select("doc", F.lit(0).alias("index"), infer_title(F.col("text")).alias("title"), F.lit("").alias("path"), F.col("text").alias("content"))


def split_text(texts: DataFrame, matcher: str | None = None) -> DataFrame:
    """Plain text by title lines. What stands before the first is a chapter of its own; empty bodies go.

    A text without titles is one chapter; an empty one is one placeholder.
    """
    sections = gather(lines_of(texts), title_in(F.col("value"), matcher))
    cut = sections.where("section > 0").select("doc").distinct()
    rows = chapters_of(sections.join(cut, "doc", "left_semi").where("content <> ''"))
    return rows.unionByName(whole_texts(texts.join(rows.select("doc"), "doc", "left_anti")))


def chosen_levels(headings: DataFrame, title_levels: tuple[int, ...] = (1,)) -> DataFrame:
    """(doc, chosen): the most frequent level of headings(doc, line, level) that repeats (ties: the upper).

    None repeats: the most frequent of the later ones that are no title levels (or are that of the first); else the first's.
    """
    first = F.first_value("level").over(Window.partitionBy("doc").orderBy("line"))
    rows = headings.select("doc", "line", "level", first.alias("top"), F.row_number().over(Window.partitionBy("doc").orderBy("line")).alias("k"))
    later = (F.col("k") > 1) & (~F.col("level").isin(*title_levels) | (F.col("level") == F.col("top")))
    counts = rows.groupBy("doc", "level").agg(F.count("*").alias("n"), F.count_if(later).alias("m"), F.min("top").alias("top"))
    often = F.min_by("level", F.when(F.col("n") > 1, F.struct(-F.col("n"), "level")))
    after = F.min_by("level", F.when(F.col("m") > 0, F.struct(-F.col("m"), "level")))
    return counts.groupBy("doc").agg(F.coalesce(often, after, F.min("top")).alias("chosen"))


def split_markdown(texts: DataFrame, config: SplitConfig | None = None) -> DataFrame:
    """Markdown by headings of one level: see ``chosen_levels``. Text before the first such heading is not kept."""
    config = config or SplitConfig()
    lines = lines_of(texts).withColumn("level", F.length(F.regexp_extract("value", HEADING, 1))).withColumn("heading", F.regexp_extract("value", HEADING, 2))
    on = F.col("level") > 0
    if config.levels:
        on = on & F.col("level").isin(*config.levels)
    if config.matcher:
        on = on & F.col("heading").rlike(config.matcher)
    if config.exclude:
        on = on & ~F.col("heading").rlike(config.exclude)
    lines = lines.withColumn("on", on)
    chosen = chosen_levels(lines.where("on"), config.title_levels)
    title = F.when(F.col("on") & (F.col("level") == F.col("chosen")), F.col("heading"))
    return chapters_of(gather(lines.join(chosen, "doc"), title).where("section > 0 AND content <> ''"))


def split_markdown_source(texts: DataFrame, config: SplitConfig | None = None) -> DataFrame:
    """By headings, title lines, either in this order (auto), or not at all (none)."""
    config = config or SplitConfig()
    if config.mode not in MODES:
        raise ValueError(f"unknown mode of chapter splitting: {config.mode}")
    if config.mode == "none":
        return whole_texts(texts)
    if config.mode == "text_markers":
        return split_text(texts, config.text_matcher)
    cut = split_markdown(texts, config)
    rest = texts.join(cut.select("doc").distinct(), "doc", "left_anti")
    return cut.unionByName(whole_texts(rest) if config.mode == "markdown_headers" else split_text(rest, config.text_matcher))


def epub_items(data: bytes) -> list[tuple[str, str]]:
    """(path, HTML) of the documents of an EPUB in the order of its manifest."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tag = lambda x: x.tag.rsplit("}", 1)[-1]
        found = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.attrib["full-path"] for x in found.iter() if tag(x) == "rootfile")
        folder = package.rsplit("/", 1)[0] + "/" if "/" in package else ""
        items = [x.attrib for x in ElementTree.fromstring(z.read(package)).iter() if tag(x) == "item"]
        names = set(z.namelist())
        out = []
        for x in items:
            path = folder + unquote(x["href"])
            if x.get("media-type") == "application/xhtml+xml" and "nav" not in x.get("properties", "").split() and path in names:
                out.append((x["href"], z.read(path).decode("utf-8", "ignore")))
        return out


def read_epub(spark: SparkSession, path: str, keep_readings: bool = False) -> DataFrame:
    """A chapter for each document of an EPUB that holds text; the title is its own, or Chapter and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                items = epub_items(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(items), pa.string()), pa.array(range(len(items)), pa.int32()), pa.array([x for x, _ in items], pa.string()), pa.array([x for _, x in items], pa.string())], ["doc", "item", "path", "html"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    items = files.mapInArrow(run, "doc string, item int, path string, html string")
    rows = items.select("doc", "item", "path", html_title(F.col("html")).alias("title"), html_text(F.col("html"), keep_readings).alias("content")).where("content <> ''")
    index = F.row_number().over(Window.partitionBy("doc").orderBy("item")) - 1
    return rows.select("doc", index.alias("index"), "title", "path", "content").select("doc", "index", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chapter "), F.col("index") + 1)).alias("title"), "path", "content")


def read_chapters(spark: SparkSession, path: str, source: dict | None = None, keep_readings: bool = False) -> DataFrame:
    """The chapters of a source by its suffix: EPUB, text or Markdown; others raise an error, and so does a missing file."""
    suffix, config = suffix_of(path), SplitConfig.of(source)
    if suffix == ".epub":
        return read_epub(spark, path, keep_readings)
    if suffix not in TEXTS + MARKDOWN:
        raise ValueError(f"unsupported source: {suffix or 'no suffix'}")
    texts = read_texts(spark, path, suffix in MARKDOWN)
    rows = split_markdown_source(texts, config) if suffix in MARKDOWN else split_text(texts, config.text_matcher)
    n = F.count("*").over(Window.partitionBy("doc"))
    digits = F.length(n.cast("string"))
    named = F.concat(F.lit("text-chapter-"), F.lpad(F.col("index").cast("string"), digits, F.lit("0")))
    return rows.withColumn("path", F.when(F.col("path") == "", named).otherwise(F.col("path")))


def chapter_files(chapters: DataFrame) -> DataFrame:
    """(doc, name, value): the chapter as a file with front matter; names have as many digits as the count needs, three at least."""
    n = F.count("*").over(Window.partitionBy("doc"))
    digits = F.greatest(F.lit(3), F.length(n.cast("string")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("index: "), F.col("index")), F.concat(F.lit("title: "), quoted("title")), F.concat(F.lit("length: "), F.length("content")), F.concat(F.lit("source_file: "), F.element_at(F.split("doc", "/"), -1)), F.concat(F.lit("path: "), quoted("path")), F.lit("---"), F.lit(""))
    return chapters.select("doc", F.concat(F.lit("ch"), F.lpad(F.col("index").cast("string"), digits, F.lit("0")), F.lit(".txt")).alias("name"), F.concat(head, "content").alias("value"))


def parse_chapter_file(value: Column) -> tuple[Column, Column]:
    """Front matter as a map of plain values, and the body without leading line ends; no front matter: no map, all body."""
    parts = F.split(value, "---", 3)
    has = value.startswith("---") & (F.size(parts) >= 3)
    pairs = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.btrim(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit("\"'")).alias("value"))), lambda e: e["key"] != "")
    # Of a key that comes twice the last value counts.
    last = bound(pairs, lambda all_: F.filter(all_, lambda e, k: ~F.exists(F.slice(all_, k + 2, F.size(all_)), lambda later: later["key"] == e["key"])))
    meta = F.map_from_entries(last)
    return F.when(has, meta), F.when(has, F.ltrim(F.get(parts, F.lit(2)), F.lit("\n"))).otherwise(value)


def chapter_order(stem: Column) -> Column:
    """The number in a chapter's name, to sort by."""
    return F.regexp_extract(stem, r"\d+", 0).try_cast("int")
