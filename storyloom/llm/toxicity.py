"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K-1 share one weight vector w: P(grade > k) = 1 / (1 + exp(theta_k - w x)) with ordered
thresholds theta_0 < theta_1 < ...; the expected severity is the sum of these chances. Features are the distinct words
of a text and the starts of its words, hashed; a whole text counts.

The fit uses a bounded sample of labelled rows, ``SAMPLE`` for each grade (those of smallest id hash), weighted back to
the grades' shares; every document is then scored in one narrow pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, small_batches, table, text_of, without_ids

SAMPLE, SLOTS, LEAST_EVIDENCE = 3000, 1 << 18, 25.0
STARTS = (4, 6)
_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """The slots of a word: itself, and its starts if it is longer than them."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % SLOTS]
    return out + [zlib.crc32(b"p" + word[:n].encode("utf-8", "surrogatepass")) % SLOTS for n in STARTS if len(word) > n]


def slots_of(text: str, known: dict[str, list[int]]) -> np.ndarray:
    found: set[int] = set()
    for w in words_of(text):
        if w not in known:
            known[w] = features(w)
        found.update(known[w])
    return np.fromiter(found, np.int32, len(found))


class OrdinalModel:
    """Weights by slot and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row for each margin w x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(margin, float)[:, None], -500, 500)))

    @staticmethod
    def fit(rows: list[np.ndarray], grades: np.ndarray, shares: np.ndarray, grades_n: int, ridge: float = 3e-5, steps: int = 800) -> OrdinalModel:
        """Gradient descent (Adam) on the weighted likelihood with a ridge, over slots that pass ``telling``.

        shares: of each grade in all labels.
        """
        counts = np.bincount(grades, minlength=grades_n)
        weight = (shares / np.maximum(counts, 1))[grades]
        weight = weight / weight.sum()
        sizes = np.array([len(r) for r in rows])
        cols, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        slots = telling(cols, owner, grades > 0)
        at = np.full(SLOTS, -1)
        at[slots] = np.arange(len(slots))
        use = at[cols] >= 0
        cols, owner, n = at[cols[use]], owner[use], len(slots)
        more = np.cumsum(shares[::-1])[::-1][1:] / shares.sum()  # P(grade > k)
        theta = np.log((1 - more + 1e-6) / (more + 1e-6))
        x = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(n)])
        m, v, k = np.zeros(len(x)), np.zeros(len(x)), grades_n - 1
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for step in range(1, steps + 1):
            theta = np.cumsum(np.concatenate([[x[0]], np.exp(x[1:k])]))
            margin = np.bincount(owner, x[k:][cols], minlength=len(rows))
            bounds = np.concatenate([[-np.inf], theta, [np.inf]])
            low, high = sig(bounds[grades] - margin), sig(bounds[grades + 1] - margin)
            p = np.maximum(high - low, 1e-12)
            at_high, at_low = weight * high * (1 - high) / p, weight * low * (1 - low) / p
            by_theta = np.bincount(grades, -at_high, minlength=k + 1)[:k] + np.bincount(grades, at_low, minlength=k + 1)[1:]
            by_place = np.concatenate([[by_theta.sum()], [by_theta[j:].sum() * np.exp(x[j]) for j in range(1, k)]])
            g = np.concatenate([by_place, np.bincount(cols, (at_high - at_low)[owner], minlength=n) + ridge * x[k:]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - 0.1 * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights = np.zeros(SLOTS, np.float32)
        weights[slots] = x[k:]
        return OrdinalModel(weights, np.cumsum(np.concatenate([[x[0]], np.exp(x[1:k])])))


def telling(cols: np.ndarray, owner: np.ndarray, toxic: np.ndarray, least: float = LEAST_EVIDENCE) -> np.ndarray:
    """Slots whose presence tells toxic rows from others: a likelihood ratio statistic of ``least`` or more."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    a1, a0 = np.bincount(cols, toxic[owner], minlength=SLOTS), np.bincount(cols, ~toxic[owner], minlength=SLOTS)
    part = lambda x, want: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(want, 1e-300)), 0)
    share = (a1 + a0) / max(n1 + n0, 1)
    g2 = 2 * (part(a1, n1 * share) + part(a0, n0 * share) + part(n1 - a1, n1 * (1 - share)) + part(n0 - a0, n0 * (1 - share)))
    return np.flatnonzero(g2 >= least)


def train(documents: DataFrame, grades: DataFrame, grades_n: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on up to ``sample`` rows of each grade of grades(doc_id, grade); repeated labels of an id: the highest.

    Two grades (toxic or not) become three by ``split_toxic``; of rows that share an id the smallest text counts.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = scratch.write("labels", grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade")))
    shares = np.zeros(grades_n)
    for g, n in labels.where(F.col("grade").between(0, grades_n - 1)).groupBy("grade").count().collect():
        shares[g] = n
    chosen = [labels.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in range(grades_n)]
    picked = chosen[0]
    for c in chosen[1:]:
        picked = picked.union(c)
    picked = scratch.write("picked", picked)  # no more than grades_n * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = [slots_of(t.as_py(), known).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.binary())], ["grade", "slots"])

    # One text for each picked id, however often it is repeated: the smallest.
    texts = text_of(documents).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    found = texts.mapInArrow(run, "grade int, slots binary").toArrow().sort_by([("grade", "ascending"), ("slots", "ascending")])
    rows = [np.frombuffer(x.as_py(), np.int32) for x in found["slots"]]
    labels_of = found["grade"].to_numpy().astype(int)
    if len(set(labels_of)) < 2:
        return OrdinalModel(np.zeros(SLOTS, np.float32), np.full(grades_n - 1, 50.0) + np.arange(grades_n - 1))
    if grades_n == 2:
        labels_of, shares = split_toxic(rows, labels_of, shares)
    return OrdinalModel.fit(rows, labels_of, np.maximum(shares, 1e-3), len(shares))


def score(documents: DataFrame, model: OrdinalModel, *more: str) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade > 0)) for each row of documents."""
    packed = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # SLOTS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*packed.value)
        weights, known = own.weights.tolist(), {}
        for batch in batches:
            margins = []
            for text in batch.column(1):
                slots: set[int] = set()
                for w in words_of(text.as_py()):
                    if w not in known:
                        if len(known) > 300_000:
                            known.clear()
                        known[w] = [k for k in features(w) if weights[k]]  # what weighs nothing is left out
                    if known[w]:
                        slots.update(known[w])
                margins.append(sum(sorted(weights[k] for k in slots)))
            above = own.above(np.array(margins, float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1).round(6)), pa.array(above[:, 0].round(6))], ["doc_id", "severity", "p_toxic"])

    return text_of(documents).mapInArrow(run, "doc_id long, severity double, p_toxic double")


def split_toxic(rows: list[np.ndarray], grades: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three grades from two, by evidence that does not come from the row's own label.

    A model of two grades is fitted on each half of the rows and judges the other half; toxic rows that it places above
    the median of the toxic ones have the higher grade.
    """
    half, margin = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for k in (0, 1):
        learned, judged = np.flatnonzero(half != k), np.flatnonzero(half == k)
        if len(set(grades[learned])) < 2:
            return grades, shares
        model = OrdinalModel.fit([rows[i] for i in learned], grades[learned], shares, 2, steps=300)
        scores = np.array([model.weights[rows[i]].sum() for i in judged], float)
        toxic = grades[judged] > 0
        spread = scores[toxic].std() if toxic.any() else 0.0
        margin[judged] = (scores - (np.median(scores[toxic]) if toxic.any() else 0.0)) / (spread or 1.0)
    high = (grades > 0) & (margin > 0)
    if not high.any() or high.sum() == (grades > 0).sum():
        return grades, shares
    part = high.sum() / (grades > 0).sum()
    return grades + high, np.array([shares[0], shares[1] * (1 - part), shares[1] * part])


def grade_documents(documents: DataFrame, labels: DataFrame, limit: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of documents(doc_id, text): doc_id, severity, p_toxic, rejected (p_toxic above ``limit``).

    labels(doc_id, toxic). Null and empty texts have no features and the severity of none. Without labels of
    two grades nothing is rejected. Labels with a null id or grade don't count. Repeated rows stay repeated, null ids
    stay null, further columns are ignored.
    """
    grades = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))
    model = train(documents, grades, 2, sample)
    return score(documents, model).withColumn("rejected", F.col("p_toxic") > limit)


def drop_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """documents without the rejected ids; rows without an id stay, and so do all their columns."""
    with small_batches(documents.sparkSession):
        graded = Scratch(documents.sparkSession, "toxicity-drop").write("graded", grade_documents(documents, labels, limit))
    return without_ids(documents, graded.where("rejected AND doc_id IS NOT NULL").select("doc_id").distinct())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` by all of ``labels``; nulls, ties and empty tables as in ``grade_documents``."""
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


by_value(__name__)
