"""Secret scans: fixed patterns, and a sliding-window Shannon entropy for each character class.

Narrow: one pass over the texts, no shuffle, memory of one Arrow batch.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_value, table, text_of

# The three base patterns of the contract, with the least length of a match.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """A class of characters whose windows of ``width`` with ``limit`` bits a character and ``digits`` digits are hot."""

    name: str
    chars: str
    width: int
    limit: float
    digits: int


#: Thresholds lie above what words, numbers and paths reach: log2(16) is 4, log2(64) is 6; letters of prose give about 3.6.
CLASSES = (
    CharClass("hex", "0-9A-Fa-f", 20, 3.1, 4),
    CharClass("base32", "A-Z2-7", 20, 3.6, 2),
    CharClass("base36", "0-9a-z", 20, 3.6, 3),
    CharClass("base64", "0-9A-Za-z+/=_-", 24, 4.0, 2),
)
#: Parts of candidates that match are no secrets: identifiers in the form of a UUID, placeholders, ordered runs, paths and host names.
ALLOW = (
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|123456789|abcdefgh",
    r"(?<![A-Za-z_-])(?:[A-Za-z_-]++/){3}",  # from the start of a segment on; segments are read once
)


def hot_spans(text: str, cls: CharClass) -> list[tuple[int, int]]:
    """Unions of the hot windows of a run of the class's characters. Counts change by one character in, one out."""
    counts: dict[str, int] = {}
    width, digits, held = cls.width, 0, 0.0  # held: the sum of c * log2(c)
    xlog = [0.0, *(c * math.log2(c) for c in range(1, width + 2))]
    least = (math.log2(width) - cls.limit) * width + 1e-9
    spans: list[list[int]] = []
    for at, char in enumerate(text):
        c = counts.get(char, 0)
        held += xlog[c + 1] - xlog[c]
        counts[char] = c + 1
        digits += char.isdigit()
        if at >= width:
            old = text[at - width]
            c = counts[old]
            held += xlog[c - 1] - xlog[c]
            counts[old] = c - 1
            digits -= old.isdigit()
        if at >= width - 1 and digits >= cls.digits and held <= least:
            start = at - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [(a, b) for a, b in spans]


class Scanner:
    """Finds the spans of one text: (start, place of the kind in KINDS, end) in order."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.assign, self.access = re.compile(ASSIGN), re.compile(ACCESS)
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # a maximal run is a match of HEX, and only the long ones count
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.width},}}")) for c in classes]
        self.candidate = re.compile("[A-Za-z0-9+/=_-]{%d,}" % min(c.width for c in classes))
        self.allow = [re.compile(x) for x in allow]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if "=" in text or ":" in text else []
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        base = sorted((a, b) for a, _, b in found)
        hot: list[list[int]] = []
        at = 0  # base spans from here on may reach into this candidate or later ones
        ends = list(itertools.accumulate((b for _, b in base), max))
        for m in self.candidate.finditer(text):
            word = m[0]
            while at < len(base) and ends[at] <= m.start():
                at += 1
            if word.isalpha():
                continue
            # The base spans stand for what they cover, and what is allowed is silent; the rest is searched piece by piece.
            taken = [(a - m.start(), b - m.start()) for a, b in itertools.takewhile(lambda x: x[0] < m.end(), itertools.islice(base, at, None))]
            for x in self.allow:
                k = 0
                while (f := x.search(word, k)) is not None:
                    taken.append(f.span())
                    k = f.start() + 1
            first = 0
            for a, b in [*sorted(taken), (len(word), len(word))]:
                piece = word[first : max(a, first)]
                for cls, run in self.classes:
                    for r in run.finditer(piece):
                        if cls.digits and sum(map(r[0].count, "0123456789")) < cls.digits:
                            continue  # no window of it can have so many
                        hot += [[m.start() + first + r.start() + i, m.start() + first + r.start() + j] for i, j in hot_spans(r[0], cls)]
                first = max(first, b)
        union: list[list[int]] = []
        for a, b in sorted(hot):
            if union and a <= union[-1][1]:
                union[-1][1] = max(b, union[-1][1])
            else:
                union.append([a, b])
        found += [(a, 3, b) for a, b in union]
        return sorted(found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan_secrets(documents: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """A row for each row of documents(doc_id, text), with the spans as ``kind:start:end`` in code points.

    Null and empty texts have no spans; null ids stay null; repeated rows stay repeated; further columns are ignored.
    Hot windows outside base spans are added; a match of the allow-list silences the windows that overlap it, no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [], [])
            digests, told = [], []
            for text in batch.column(1):
                spans = scanner.spans(text.as_py() or "")
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest())
                told.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(told, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return text_of(documents).mapInArrow(run, SCHEMA)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, repeated rows and empty tables as in ``scan_secrets``."""
    return scan_secrets(table(spark, sf_dir, "documents"))


by_value(__name__)
