"""Text expressions: normalising, titles, names, times, HTML. Columns in, columns out; null gives null."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as blanks, in any script.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: the marks that alignment ignores.
MARKS = r"[。！？!?、，,.；;：:…—–\-「」『』（）()【】\[\]《》〈〉\"']"


def bound(x: Column, body) -> Column:
    """body of the value of x, which is made once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def tenths(x: Column) -> Column:
    """A double with one digit after the point, as C writes it: of its exact binary value, ties to an even digit.

    Java's format rounds the shortest decimal form instead, and half up: 0.25 gives 0.3 there, 0.35 (a little less) 0.4.
    """

    def told(v: Column) -> Column:
        size = F.abs(v)
        part = size - F.floor(size)
        return bound(F.struct(F.floor(size).alias("whole"), part.alias("f"), F.floor(part * 10).alias("k")), last)

    def last(s: Column) -> Column:
        # 5 f as an exact sum, against the middle between k and k + 1 tenths.
        five, middle = 4 * s["f"] + s["f"], (2 * s["k"] + 1) / 4.0
        left = s["f"] - (five - 4 * s["f"])
        up = (five > middle) | ((five == middle) & ((left > 0) | ((left == 0) & (s["k"] % 2 == 1))))
        k = s["k"] + up.cast("int")
        return F.concat((s["whole"] + F.when(k == 10, 1).otherwise(0)).cast("string"), F.lit("."), (k % 10).cast("string"))

    own = F.concat(F.when(x < 0, "-").otherwise(""), bound(x, told))
    return F.when((x != 0) & (F.abs(x) < 9e18), own).otherwise(F.format_string("%.1f", x))


def strip(text: Column) -> Column:
    """Without blanks of any script at the ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, no blanks at the ends."""
    return strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block between lines of three dashes."""
    return F.when(text.startswith("---\n"), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")).otherwise(text)


def strip_marks(text: Column) -> Column:
    return strip(F.regexp_replace(text, MARKS, ""))


def compact(text: Column) -> Column:
    return F.replace(strip_marks(text), F.lit(" "), F.lit(""))


def infer_title(text: Column, default: str = "Chapter 1") -> Column:
    """The first line that isn't blank, 80 characters at most."""
    line = strip(F.substring_index(F.replace(F.ltrim(text, F.lit(BLANKS)), F.lit("\r"), F.lit("\n")), "\n", 1))
    return F.coalesce(F.nullif(F.substring(line, 1, 80), F.lit("")), F.lit(default))


def safe_name(name: Column) -> Column:
    """A file name: slashes become underscores, NUL goes."""
    return F.translate(name, "/\\\u0000", "__")


def clock(seconds: Column) -> Column:
    """hh:mm:ss, rounded down."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def subtitle_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm with milliseconds rounded half to even; 1000 of them carry into the seconds."""
    ms = F.floor(seconds) * 1000 + F.bround((seconds - F.floor(seconds)) * 1000).cast("long")
    return F.concat(clock(F.floor(ms / 1000)), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _parts(text: Column) -> Column:
    return F.transform(F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))


def parse_clock(text: Column) -> Column:
    """Seconds of h:m:s, m:s or s, with comma or dot; null if it is none of them."""
    p = _parts(text)
    return F.when(F.size(p) <= 3, F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x))


def parse_clock_strict(text: Column) -> Column:
    """Seconds of h:m:s; null for any other number of parts."""
    return F.when(F.size(_parts(text)) == 3, parse_clock(text))


def language_code(name: Column) -> Column:
    """ja, en, zh or ko by prefix; else lower case with dashes."""
    x = F.lower(F.replace(strip(name), F.lit("_"), F.lit("-")))
    named = F.coalesce(*[F.when(x.startswith(k), k) for k in ("ja", "en", "zh", "ko")])
    return F.coalesce(named, F.nullif(x, F.lit("")))


def chance_of_log(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(F.exp(x), F.lit(0.0)), F.lit(1.0)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; the default of everything that takes an estimator."""
    return F.ceil(F.length(text) / 4).cast("long")


# Fixed value: how the encoder cl100k_base cuts texts.
CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""


def token_counter(vocabulary: str, pattern: str = CL100K) -> Callable[[Column], Column]:
    """Counts tokens by a vocabulary file: ranks of tiktoken (cut by ``pattern``), or the JSON of a tokenizer. Null: 0.

    The driver reads the file and sends it with the function; use it where ``token_estimate`` is taken.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    ranks = vocabulary.endswith(".tiktoken")
    held: dict = {}

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "many" not in held and ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            held["many"] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        elif "many" not in held:
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(raw.decode())
            held["many"] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        for texts in batches:
            yield pd.Series(held["many"]([t or "" for t in texts]), dtype="int64")

    return F.pandas_udf(counted, "long")


def content_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def is_true(text: Column) -> Column:
    """Whether a setting says yes."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def canonical_json(row: Column) -> Column:
    """JSON text with the keys of an object in order, whatever the order they were written in."""
    kept = F.from_json(row, "map<string,string>")
    entries = F.array_sort(F.map_entries(kept))
    return F.when(kept.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(F.to_json(F.array(e["value"])), F.lit("null")))), ","), F.lit("}")))


def decode_entities(text: Column) -> Column:
    """Character references as characters; unknown ones stay."""
    pattern = r"&(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);"
    named = F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, v)])

    def char(ref: Column) -> Column:
        code = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 8), 16, 10).cast("int")).when(ref.startswith("#"), F.substring(ref, 2, 8).cast("int")).otherwise(F.try_element_at(named, ref))
        known = code.isNotNull() & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&"), ref, F.lit(";")))

    def decoded(x: Column) -> Column:
        refs, rest = F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.split(x, pattern, -1)
        joined = F.array_join(F.zip_with(rest, refs, lambda s, r: F.concat(s, F.coalesce(char(r), F.lit("")))), "")
        return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)

    return bound(text, decoded)


def _without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", "")


def _bare_ruby(html: Column) -> Column:
    """Annotated words without their reading: the text of rb elements, then what stands bare."""
    pattern = r"(?is)<ruby\b[^>]*>.*?</ruby\s*>"
    inner = lambda r: F.regexp_replace(r, r"(?is)^<ruby\b[^>]*>|</ruby\s*>$", "")
    based = lambda r: F.array_join(F.regexp_extract_all(r, F.lit(r"(?is)<rb\b[^>]*>(.*?)</rb\s*>"), F.lit(1)), "")
    bare = lambda r: _without_tags(F.regexp_replace(inner(r), r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>", ""))

    def bare_words(x: Column) -> Column:
        words = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda r: F.concat(based(r), bare(r)))
        joined = F.array_join(F.zip_with(F.split(x, pattern, -1), words, lambda s, w: F.concat(s, F.coalesce(w, F.lit("")))), "")
        return F.when(F.contains(F.lower(x), F.lit("<ruby")), joined).otherwise(x)

    return bound(html, bare_words)


def html_text(html: Column, keep_readings: bool = False) -> Column:
    """Text of well-formed HTML: no scripts or styles, a line for each break and paragraph, no blank lines.

    Readings of annotated words go unless they are kept.
    """
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\b[^>]*>", "\n"), r"(?i)</p\s*>", "\n\n")
    x = x if keep_readings else _bare_ruby(x)
    lines = F.transform(F.split(decode_entities(_without_tags(x)), "\n"), lambda s: strip(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def html_title(html: Column) -> Column:
    """The first of h1 (also an empty one), title, and a strong of under 100 characters; null if there is none."""
    found = lambda tag: F.get(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), F.lit(0))
    plain = lambda x: strip(decode_entities(_without_tags(x)))
    strong = plain(found("strong"))
    return F.coalesce(html_text(found("h1")), plain(found("title")), F.when(F.length(strong).between(1, 99), strong))
