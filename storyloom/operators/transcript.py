"""Transcripts: sentence and clause splitting, timing of pieces by tokens or length, filters of entries and spans.

Splitting is a small program for each entry and runs in Arrow batches; an entry holds its own tokens, so that nothing
is grouped or shuffled. Everything that windows or expressions can say is a DataFrame expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T

# Fixed values of the splitter.
HARD_PAUSE, SOFT_PAUSE, SOFT_SIDE, CLAUSE = 0.8, 0.35, 1.5, 6
JA_ENDINGS = ("けれども", "けども", "けれど", "だったり", "でしたり", "なくて", "たり", "だり", "けど", "ので", "のに", "から", "して", "くて", "て", "で")
CONJUNCTIONS = "because but and or so yet while although though if when where which who that since as for however therefore thus hence moreover furthermore nevertheless instead meanwhile otherwise rather also besides"
ABBREVIATIONS = "mr mrs ms dr prof sr jr st inc ltd co corp vs etc approx jan feb mar apr jun jul aug sep oct nov dec mon tue wed thu fri sat sun"

_MARK, _SENTENCE, _COMMA = re.compile(T.MARKS), re.compile(r"(?<=[。！？!?])"), re.compile(r"(?<=[、，])")
_JA_WORD = re.compile(r"[一-龯ぁ-んァ-ヶー]")
_JOINED = re.compile(r",\s+(?=(?:" + "|".join(CONJUNCTIONS.split()) + r")\b)", re.I)
_STOP = re.compile(r"([.!?]+[\"')\]]*)\s+")
_ACRONYM, _SHORT = re.compile(r"(?:[A-Z]\.){2,}"), frozenset(ABBREVIATIONS.split())


def language_of(name: str | None) -> str | None:
    """Python's form of ``language_code``."""
    x = (name or "").strip().lower().replace("_", "-")
    return next((k for k in ("ja", "en", "zh", "ko") if x.startswith(k)), x or None)


def _stripped(parts: list[str]) -> list[str]:
    return [p for p in (x.strip() for x in parts) if p]


def japanese_clauses(text: str) -> list[str]:
    """Cuts after clause endings that a Japanese word follows, with CLAUSE characters on both sides."""
    cuts = set()
    for ending in JA_ENDINGS:
        at = text.find(ending, CLAUSE)
        while at >= 0:
            cut = at + len(ending)
            if len(text) - cut >= CLAUSE and _JA_WORD.match(text[cut]):
                cuts.add(cut)
            at = text.find(ending, cut)
    edges = [0, *sorted(cuts), len(text)]
    return _stripped([text[a:b] for a, b in zip(edges, edges[1:])]) or [text]


def joined_short(parts: list[str]) -> list[str]:
    """Parts of under CLAUSE characters go to their neighbour."""
    out: list[str] = []
    for p in _stripped(parts):
        if out and min(len(p), len(out[-1])) < CLAUSE:
            out[-1] += p
        else:
            out.append(p)
    return out or parts


def comma_clauses(text: str) -> list[str]:
    return joined_short(_COMMA.split(text)) if len(_stripped(_COMMA.split(text))) > 1 else [text]


def latin_sentences(text: str) -> list[str]:
    """Cuts after stops, but not after abbreviations, initials and acronyms."""
    edges = [0]
    for m in _STOP.finditer(text):
        word = text[edges[-1] : m.start()].split()[-1:] or [""]
        last = word[0].lstrip("\"'([").lower()
        initial = len(last) == 1 and last.isalpha() and text[m.end() : m.end() + 1].isupper()
        if m[1][0] != "." or m[1][:2] == ".." or not (last in _SHORT or initial):
            edges.append(m.end())
    out: list[str] = []
    for p in _stripped([text[a:b] for a, b in zip(edges, [*edges[1:], len(text)])]):
        if out and _ACRONYM.fullmatch(out[-1]):
            out[-1] += " " + p
        else:
            out.append(p)
    return out or [text]


def conjunction_clauses(text: str) -> list[str]:
    """Two parts around the first comma before a conjunction, if both are long enough."""
    m = _JOINED.search(text)
    parts = [text[: m.start() + 1].strip(), text[m.end() :].strip()] if m else []
    return parts if parts and min(map(len, parts)) >= CLAUSE else [text]


def split_heuristically(text: str, language: str | None) -> list[str]:
    """Sentences; of a single one its clauses, by the rules of its language."""
    parts = _stripped(_SENTENCE.split(text))
    if len(parts) > 1:
        return parts
    code = language_of(language)
    steps = {"ja": (japanese_clauses, comma_clauses), "zh": (comma_clauses,), "ko": (comma_clauses,)}.get(code, (latin_sentences, conjunction_clauses))
    for step in steps:
        if len(parts := step(text)) > 1:
            return parts
    return [text]


def pieces(text: Column, language: Column) -> Column:
    """The pieces of ``split_heuristically``; null text: null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(ArrayType(StringType()))
    def cut(texts: pa.Array, languages: pa.Array) -> pa.Array:
        # A few texts at a time are Python objects; the rest of the batch stays as Arrow holds it.
        out = []
        for low in range(0, len(texts), TEXTS):
            some = zip(texts.slice(low, TEXTS).to_pylist(), languages.slice(low, TEXTS).to_pylist(), strict=True)
            out.append(pa.array([None if t is None else split_heuristically(t, x) for t, x in some], pa.list_(pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return cut(text, language)


def sentences(text: Column) -> Column:
    """Pieces that end in 。！？!?, without blanks at the ends; no Python."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?])"), T.strip), lambda s: s != "")


class Token:
    """A recognised word with its times."""

    __slots__ = ("confidence", "end", "start", "text", "size")

    def __init__(self, text: str, start: float, end: float, confidence: float | None = None):
        self.text, self.start, self.end, self.confidence = text, start, end, confidence
        self.size = sum(counted(text))


def counted(text: str) -> list[bool]:
    """Which characters take part in alignment: no marks, no blanks."""
    return [not (c.isspace() or _MARK.match(c)) for c in text]


def dealt(tokens: list[Token], start: float, end: float) -> list[Token]:
    """The tokens one after another between start and end, by their sizes."""
    weights = [max(t.size, 1) for t in tokens]
    out, at, whole = [], start, max(0.0, end - start)
    for k, (t, w) in enumerate(zip(tokens, weights, strict=True)):
        upto = max(start, end) if k == len(tokens) - 1 else at + whole * w / sum(weights)
        out.append(Token(t.text, at, upto, t.confidence))
        at = upto
    return out


def repaired(tokens: list[Token], start: float, end: float) -> list[Token]:
    """Runs of tokens without duration get the gap between their neighbours."""
    out: list[Token] = []
    k = 0
    while k < len(tokens):
        if tokens[k].end > tokens[k].start:
            out.append(tokens[k])
            k += 1
            continue
        last = next((j for j in range(k, len(tokens)) if tokens[j].end > tokens[j].start), len(tokens))
        out += dealt(tokens[k:last], out[-1].end if out else start, tokens[last].start if last < len(tokens) else end)
        k = last
    return out


def split_by_tokens(text: str, tokens: list[Token], start: float, end: float, language: str | None) -> list[tuple[str, float, float]]:
    """(text, start, end) of the pieces of an entry.

    Cuts: the ends of the heuristic pieces, pauses of HARD_PAUSE between tokens, and pauses of SOFT_PAUSE with
    SOFT_SIDE seconds of speech on both sides. Times come from the tokens that a piece overlaps, in proportion.
    """
    whole = [(text, start, end)]
    if not text or not tokens:
        return whole if text else []
    on = counted(text)
    place = [k for k, x in enumerate(on) if x]  # the display place of each counted character
    rank, n = [], 0  # how many counted characters stand before each place
    for x in on:
        rank.append(n)
        n += x
    rank.append(n)
    spans, at = [], 0  # (first, end) among the counted characters, and the token
    for t in repaired(tokens, start, end):
        if t.size and at < n:
            spans.append((at, min(at + t.size, n), t))
            at += t.size
    if not spans:
        return whole

    cuts: dict[int, bool] = {}
    cursor = 0
    for p in split_heuristically(text, language)[:-1]:
        found = text.find(p, cursor)
        if found < 0:
            cuts.clear()
            break
        cursor = found + len(p)
        cuts[cursor] = True
    for (_, _, one), (first, _, two) in zip(spans, spans[1:]):
        pause = two.start - one.end
        if pause >= HARD_PAUSE:
            cuts[place[first]] = True
        elif pause >= SOFT_PAUSE:
            cuts.setdefault(place[first], False)

    def spoken(a: int, b: int) -> float:
        inside = [t for x, y, t in spans if place[y - 1] >= a and place[x] < b]
        return max(t.end for t in inside) - min(t.start for t in inside) if inside else 0.0

    edges = [0]
    for cut in sorted(cuts):
        if edges[-1] < cut < len(text) and (cuts[cut] or min(spoken(edges[-1], cut), spoken(cut, len(text))) >= SOFT_SIDE):
            edges.append(cut)
    out: list[tuple[str, float, float]] = []
    for a, b in zip(edges, [*edges[1:], len(text)]):
        if not (piece := text[a:b].strip()):
            continue
        low, high = rank[a], rank[b]
        share = lambda t, x, y, k: t.start + (k - x) / (y - x) * (t.end - t.start)
        times = [(share(t, x, y, max(x, low)), share(t, x, y, min(y, high))) for x, y, t in spans if max(x, low) < min(y, high)]
        if times:
            out.append((piece, min(x for x, _ in times), max(y for _, y in times)))
        else:
            out.append((piece, out[-1][2] if out else start, end))
    return out or whole


def reconciled(tokens: list[Token], text: str) -> list[Token]:
    """The tokens of a second transcript, cut to the characters that match the text, under the text's own characters."""
    own = "".join(c for c, x in zip(text, counted(text), strict=True) if x)
    theirs = [(c, k) for k, t in enumerate(tokens) for c, x in zip(t.text, counted(t.text), strict=True) if x]
    out: list[Token] = []
    before = None
    for a, b, size in SequenceMatcher(None, own, "".join(c for c, _ in theirs), autojunk=False).get_matching_blocks():
        for k in range(size):
            owner, place = theirs[b + k][1], a + k
            if before == (owner, place - 1):
                out[-1] = Token(out[-1].text + own[place], out[-1].start, out[-1].end, out[-1].confidence)
            else:
                t = tokens[owner]
                out.append(Token(own[place], t.start, t.end, t.confidence))
            before = (owner, place)
    return out


# Texts that are Python objects at a time.
TEXTS = 64
TOKENS = "array<struct<text:string,start:double,end:double>>"


def split_entries(entries: DataFrame) -> DataFrame:
    """(key, piece, start, end, text): entries(key, start, end, text, language, tokens) cut by tokens, else by length.

    tokens: array of (text, start, end); those without a time or a text don't count. Fewer than two, or one piece: the
    pieces of the text share the time by their length. Null and blank texts have no rows; columns besides these go.
    """
    rows = entries.select("key", F.col("start").cast("double"), F.col("end").cast("double"), T.strip(F.col("text")).alias("text"), F.col("language").cast("string").alias("language"), F.col("tokens").cast(TOKENS).alias("tokens")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                tokens = [Token(t["text"], t["start"], t["end"]) for t in r["tokens"] or [] if t and t["start"] is not None and t["end"] is not None and (t["text"] or "").strip()]
                cut = split_by_tokens(r["text"], tokens, r["start"], r["end"], r["language"]) if len(tokens) > 1 else []
                if len(cut) <= 1:
                    parts = split_heuristically(r["text"], r["language"])
                    cut, at, total = [], r["start"], sum(map(len, parts))
                    for k, p in enumerate(parts):
                        upto = r["end"] if k == len(parts) - 1 else min(r["end"], at + max(r["end"] - r["start"], 0.0) * len(p) / total)
                        cut.append((p, at, upto))
                        at = upto
                out += [(r["key"], k, a, b, t) for k, (t, a, b) in enumerate(cut)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["key", "piece", "start", "end", "text"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, piece int, start double, end double, text string")


def proportional_times(parts: DataFrame) -> DataFrame:
    """parts(key, pos, text, start, end of the whole) with their own piece_start and piece_end by length; the last ends with the whole."""
    w = Window.partitionBy("key").orderBy("pos")
    n, upto = F.sum(F.length("text")).over(Window.partitionBy("key")), F.sum(F.length("text")).over(w)
    whole = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    at = lambda k: F.least(F.col("end"), F.col("start") + whole * k / F.nullif(n, F.lit(0)))
    return parts.select("*", at(upto - F.length("text")).alias("piece_start"), F.when(upto == n, F.col("end")).otherwise(at(upto)).alias("piece_end"))


def passes(entries: DataFrame, least_confidence: float = 0.6, least_seconds: float = 0.3, most_chars: float = 28.0) -> DataFrame:
    """entries(start, end, text, confidence or null) that are sure, long and slow enough."""
    seconds = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    speed = F.when(seconds > 0, F.length("text") / seconds).otherwise(F.lit(float("inf")))
    return entries.where(F.coalesce(F.col("confidence") >= least_confidence, F.lit(True)) & (seconds >= least_seconds) & (speed <= most_chars))


def segment_entries(segments: DataFrame) -> DataFrame:
    """segments(key, chunk_start, chunk_end, start, end, text, avg_logprob, language, tokens: times within the chunk) as cut entries with confidence."""
    at = lambda x: F.col("chunk_start") + F.coalesce(F.col(x), F.lit(0.0))
    moved = F.transform(F.col("tokens").cast(TOKENS), lambda t: F.struct(t["text"].alias("text"), (F.col("chunk_start") + t["start"]).alias("start"), (F.col("chunk_start") + t["end"]).alias("end")))
    rows = segments.select("key", F.greatest(at("start"), F.col("chunk_start")).alias("start"), F.least(at("end"), F.col("chunk_end")).alias("end"), T.strip(F.col("text")).alias("text"), T.chance_of_log(F.col("avg_logprob")).alias("confidence"), "language", moved.alias("tokens"))
    kept = passes(rows.where("text <> ''"))
    return split_entries(kept).join(kept.select("key", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("confidence").alias("stt_confidence")), "key")


def numbered_entries(entries: DataFrame, key: str = "key") -> DataFrame:
    """entries(key, start, end, text, ...) in order of time with entry_id utt_000000, utt_000001, ..."""
    w = Window.partitionBy(key).orderBy("start", "end", "text")
    return entries.withColumn("entry_id", F.format_string("utt_%06d", F.row_number().over(w) - 1))


def speech_spans(segments: DataFrame, totals: DataFrame, least: float = 0.3) -> DataFrame:
    """(key, index, start, end): segments(key, start, end) within 0 and the total of totals(key, total), ``least`` long.

    A key without any segment is one span; one whose segments are all too short has none.
    """
    w = Window.partitionBy("key").orderBy("start", "end")
    clamped = segments.join(totals, "key").select("key", F.greatest(F.col("start"), F.lit(0.0)).alias("start"), F.least("end", "total").alias("end"))
    held = clamped.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= least))
    whole = totals.join(segments.select("key").distinct(), "key", "left_anti").select("key", F.lit(0).alias("index"), F.lit(0.0).alias("start"), F.col("total").alias("end"))
    return held.select("key", (F.row_number().over(w) - 1).alias("index"), "start", "end").union(whole)


def pauses(tokens: DataFrame) -> DataFrame:
    """tokens(key, pos, start, end) with pause (to the next token) and kind: hard, soft or null."""
    gap = F.lead("start").over(Window.partitionBy("key").orderBy("pos")) - F.col("end")
    return tokens.withColumn("pause", gap).withColumn("kind", F.when(gap >= HARD_PAUSE, "hard").when(gap >= SOFT_PAUSE, "soft"))


def alignment_quality(entries: DataFrame) -> DataFrame:
    """entries(..., text, tokens, confidences) with coverage (counted characters in tokens, of the text's) and alignment_confidence."""
    n = F.length(T.compact(F.col("text")))
    held = F.aggregate(F.col("tokens"), F.lit(0), lambda a, t: a + F.length(T.compact(t["text"])))
    mean = F.aggregate(F.col("confidences"), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("confidences"), F.lit(0))
    return entries.select("*", F.least(held / F.greatest(n, F.lit(1)), F.lit(1.0)).alias("coverage"), mean.alias("alignment_confidence"))


def with_speakers(entries: DataFrame, attributions: DataFrame) -> DataFrame:
    """entries(key, entry_id, ...) with the speaker of attributions(key, entry_id, speaker), or UNKNOWN."""
    return entries.join(attributions.select("key", "entry_id", "speaker"), ["key", "entry_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def with_names(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries(speaker, ...) with the confirmed name of names(speaker, name), or the speaker itself."""
    return entries.join(names.select("speaker", "name"), "speaker", "left").withColumn("name", F.coalesce("name", "speaker"))


def first_seen(entries: DataFrame, key: str = "key") -> DataFrame:
    """(key, speaker, first_seen): the first start of each speaker, UNKNOWN left out; without times: 0."""
    return entries.where("speaker <> 'UNKNOWN'").groupBy(key, "speaker").agg(F.coalesce(F.min("start"), F.lit(0.0)).alias("first_seen"))


def alignment_diagnostics(groups: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """groups(key, grp, ...) with what alignment changed: before and after as (start, end, text), their numbers, and moved.

    before and after are entries(key, grp, start, end, text) of the two states; a group's are in order of time, and a
    group is no longer than recognition takes (seconds), so that they fit a row. moved is the greatest change in seconds of a
    start or an end, entry by entry; null if the numbers differ or there are none. Entries of unknown groups are left out.
    """
    entry = F.struct("start", "end", "text")
    state = lambda rows, name: rows.groupBy("key", "grp").agg(F.array_sort(F.collect_list(entry)).alias(name))
    none = F.array().cast("array<struct<start: double, end: double, text: string>>")
    out = groups.join(state(before, "before"), ["key", "grp"], "left").join(state(after, "after"), ["key", "grp"], "left")
    out = out.withColumn("before", F.coalesce("before", none)).withColumn("after", F.coalesce("after", none))
    shift = F.zip_with("before", "after", lambda b, a: F.greatest(F.abs(a["start"] - b["start"]), F.abs(a["end"] - b["end"])))
    out = out.withColumn("n_before", F.size("before").cast("long")).withColumn("n_after", F.size("after").cast("long"))
    return out.withColumn("moved", F.when(F.col("n_before") == F.col("n_after"), F.round(F.array_max(shift), 3)))
