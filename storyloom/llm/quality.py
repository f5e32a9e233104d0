"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. Cutoffs come from labelled rows, for each stratum: those rules
and cutoffs are taken of which it is certified that they reject few good documents. Certified: the exact binomial
(Clopper-Pearson) upper bound of the false rejection rate, at a confidence shared out over all rules and strata
(Bonferroni), stays within the rule's share of the risk. Cutoffs of a rule are tested from lenient to strict and
testing stops at the first failure (fixed sequence), which needs no further correction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, table, text_of


@dataclass(frozen=True)
class Rule:
    """Rejects what is above a cutoff of the grid, which runs from lenient to strict."""

    name: str
    grid: tuple[float, ...]


def _down(top: float, low: float, n: int = 24) -> tuple[float, ...]:
    return tuple(float(x) for x in np.geomspace(top, low, n))


RULES = (
    Rule("symbols_per_word", _down(4, 0.02)),
    Rule("dup_line_share", _down(0.95, 0.02)),
    Rule("repeat_word_share", _down(0.5, 0.005)),
    Rule("chars_per_word", _down(40, 4)),
    Rule("words_per_char", _down(1, 0.1)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_BLANK = dict.fromkeys([0x20, *range(9, 14)])
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    for w in words:
        ids.setdefault(w, len(ids))
    a = np.fromiter((ids[w] for w in words), np.int64, n)
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 2_000_000:  # else three ids fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(ids) + a[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    marked[:-2] |= twice
    marked[1:-1] |= twice
    marked[2:] |= twice
    return int(marked.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of COUNTS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(bytes([c])) for c in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def values(counts: tuple[int, ...]) -> tuple[float, ...]:
    """The measure of each of RULES."""
    words, chars, symbols, dup, repeat, lines = counts
    return symbols / max(words, 1), dup / max(lines, 1), repeat / max(words, 1), chars / max(words, 1), words / max(chars, 1)


def measured(documents: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, the counts, and for each rule how many cutoffs of its grid the text's value exceeds."""
    grids = [np.sort(np.asarray(r.grid)) for r in RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(t.as_py() or "") for t in batch.column(1)]
            kinds = np.array([values(c) for c in counts], float).reshape(-1, len(RULES))
            above = [pa.array(np.searchsorted(g, kinds[:, k], side="left"), pa.int32()) for k, g in enumerate(grids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))), *above], ["doc_id", "stratum", *COUNTS, *(f"above_{r.name}" for r in RULES)])

    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"above_{r.name} int" for r in RULES)
    return text_of(documents.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")), "doc_id", "text", "stratum").mapInArrow(run, schema)


def upper_bound(k: int, n: int, miss: float) -> float:
    """Clopper-Pearson: the rate at which k or fewer of n have the chance ``miss``."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p >= 1:
            break
        chance = np.exp(choose + i * math.log(max(p, 1e-300)) + (n - i) * math.log1p(-p)).sum()
        low, high = (p, high) if chance > miss else (low, p)
    return high


def choose_cutoffs(found: list[tuple[str, int, int, int, int]], risk: float, miss: float) -> dict[str, list[int]]:
    """For each stratum and rule the number of exceeded cutoffs from which a text is rejected; beyond the grid: never.

    found: (stratum, rule, above, good, n). Of the certified cutoffs the most lenient one that rejects the most bad
    documents is taken, and none if it rejects no bad one.
    """
    strata = sorted({x[0] for x in found})
    hist = {(s, r): np.zeros((2, len(RULES[r].grid) + 1), np.int64) for s in strata for r in range(len(RULES))}
    for s, r, above, good, n in found:
        hist[s, r][good, above] += n
    least = math.log(1 / miss) / (risk / len(RULES))  # fewer good rows than this certify nothing
    tested = [s for s in strata if hist[s, 0][1].sum() >= least] or [""]
    share = miss / (len(RULES) * len(tested))
    out = {}
    for s in tested if tested != [""] or "" in strata else []:
        for r, rule in enumerate(RULES):
            bad, good = hist[s, r]
            n, best, take = int(good.sum()), 0, len(rule.grid) + 1
            for cut in range(len(rule.grid), 0, -1):  # rejects what exceeds at least so many cutoffs: all of them is lenient
                k = int(good[cut:].sum())
                if k > n * risk / len(RULES) or upper_bound(k, n, share) > risk / len(RULES):
                    break
                if (caught := int(bad[cut:].sum())) > best:
                    best, take = caught, cut
            out.setdefault(s, []).append(take)
    return out


def apply_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, miss: float = 0.05) -> DataFrame:
    """A row for each row of documents(doc_id, text, stratum); labels(doc_id, quality: 1 good, 0 bad).

    At most ``risk`` of a stratum's good documents are rejected by the method, with confidence 1 - ``miss`` over all
    strata. Strata with too few labels to certify a cutoff keep everything the base rules keep.

    Null and empty text: no words, hence base_failed. A document with labels of both kinds counts as bad; labels
    without an id, a quality or a document are ignored. Repeated rows stay repeated. Null strata form one stratum.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "quality")
    rows = scratch.write("measured", measured(documents, stratum))
    grades = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    above = [f"above_{r.name}" for r in RULES]
    hist = scratch.write("hist", rows.select("doc_id", "stratum", F.posexplode(F.array(*above)).alias("rule", "above")).join(grades, "doc_id").groupBy("stratum", "rule", "above", "good").count())
    enough = math.log(1 / miss) / (risk / len(RULES))
    known = hist.where("rule = 0 AND good = 1").groupBy("stratum").agg(F.sum("count").alias("n")).where(F.col("n") >= enough).select("stratum")
    found = hist.join(known, "stratum", "left_semi").collect()  # strata with enough labels: no more than labels / enough
    cutoffs = choose_cutoffs([tuple(x) for x in found], risk, miss)
    never = [len(r.grid) + 1 for r in RULES]
    limits = spark.createDataFrame([(s, *c) for s, c in cutoffs.items()] or [("", *never)], "stratum string, " + ", ".join(f"cut_{r.name} int" for r in RULES))
    judged = rows.join(F.broadcast(limits) if len(cutoffs) <= 10_000 else limits, "stratum", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for r, n in zip(RULES, never, strict=True):
        rejected = rejected | (F.col(f"above_{r.name}") >= F.coalesce(F.col(f"cut_{r.name}"), F.lit(n)))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"above_{r.name}") >= F.coalesce(F.col(f"cut_{r.name}"), F.lit(n)), r.name) for r, n in zip(RULES, never, strict=True)])), ",")
    return judged.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), reasons.alias("rules"), F.col("stratum"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` by all of ``labels``; nulls, ties and empty tables as in ``apply_rules``."""
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


by_value(__name__)
