"""Benchmark decontamination: which documents contain (most of) a test item. DataFrame functions only.

A test item is far shorter than the documents that may hold it, so the score is containment: the share of the item's
five-word shingles that the document has. Items are partitioned by size, and an item's MinHash sketch has as many
values as its size asks for: of n distinct shingles, a containment of t leaves out at most n - ceil(t n), so the
n - ceil(t n) + 1 smallest hashes can't all be missing. A document is a candidate of a size class if it has one of its
items' values; no candidate is lost, however long the document. Each class has a bar, its largest sketch value: the
larger its items, the lower the bar, and only hashes up to it are looked up in the class. Candidates are verified on
the shingles of the class itself.

(Plain banded MinHash of whole documents can't do this: a 30-word item in a text of 20,000 words has a Jaccard
similarity of 0.001, and no signature of bearable length finds that.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast, table, text_of, without_ids

SHINGLE = 5


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def shingled(rows: DataFrame, key: str) -> DataFrame:
    """(key, words, at) for each shingle of rows(key, words)."""
    return rows.where(F.size("words") >= SHINGLE).select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("at"))


def at(k: int) -> Column:
    return F.get("words", F.col("at") + k)


SMALL_ITEMS = 2_000_000  #: shingles of items up to which they are broadcast (about 200 MB); beyond, joins shuffle


def contained(documents: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of each pair with at least ``percent`` % containment.

    documents(doc_id, text), items(item_id, text). Case, punctuation and blanks don't count. Null and empty texts and
    those of fewer than five words contain nothing and are contained nowhere. Rows that share an id count as one
    document or item with all their shingles; rows without an id are not tested, and items without one are not sought.
    Equal items under two ids are both found. Empty tables give no rows. Extra columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    hashed = F.xxhash64(*[at(k) for k in range(SHINGLE)])
    written = F.concat_ws(" ", *[at(k) for k in range(SHINGLE)])
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    parts = scratch.write("items", shingled(tests, "item_id").select("item_id", hashed.alias("h"), written.alias("shingle")).distinct())
    need = F.ceil(F.col("n_shingles") * percent / 100)
    sizes = scratch.write("sizes", parts.groupBy("item_id").agg(F.count("*").alias("n_shingles")).withColumn("need", need.cast("long")).withColumn("size_class", F.floor(F.log2("n_shingles")).cast("int")))
    ranked = parts.join(sizes, "item_id").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    sketch = scratch.write("sketch", ranked.where("rank <= n_shingles - need + 1").select("size_class", "h").distinct())
    bars = sorted((x["size_class"], x["bar"]) for x in sketch.groupBy("size_class").agg(F.max("h").alias("bar")).collect())  # no more rows than log2 of a size
    small = fits_broadcast(parts, SMALL_ITEMS)
    near = F.broadcast if small else (lambda df: df)

    docs = text_of(documents).select("doc_id", words_of(F.col("text")).alias("words"))
    probes = shingled(docs, "doc_id").select("doc_id", hashed.alias("h")).where(F.col("h") <= F.lit(max((b for _, b in bars), default=-(1 << 63))))
    classes = F.array(*[F.when(F.col("h") <= F.lit(b), F.lit(c)) for c, b in bars]) if bars else F.array().cast("array<int>")
    probes = probes.select("doc_id", "h", F.explode(classes).alias("size_class")).where("size_class IS NOT NULL")
    held = scratch.write("candidates", probes.join(near(sketch), ["size_class", "h"]).select("doc_id", "size_class").distinct())
    ids = held.select("doc_id").distinct()
    chosen = docs.join(F.broadcast(ids) if fits_broadcast(ids, 2_000_000) else ids, "doc_id", "left_semi")
    classed = parts.join(sizes.select("item_id", "size_class"), "item_id").select("item_id", "size_class", "shingle")
    found = shingled(chosen, "doc_id").select("doc_id", written.alias("shingle")).join(near(classed), "shingle").join(F.broadcast(held) if fits_broadcast(held, 2_000_000) else held, ["doc_id", "size_class"], "left_semi")
    counted = found.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_found"))
    scored = counted.join(near(sizes.select("item_id", "n_shingles", "need")), "item_id").where("n_found >= need")
    return scored.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def decontaminate(documents: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """documents without those that contain an item, all their columns kept; rows without an id are not tested and stay.

    Rows that share an id stay or go together; of empty documents nothing is left, and without items all stay.
    """
    scratch = Scratch(documents.sparkSession, "decontaminate-keep")
    return without_ids(documents, scratch.write("leaks", contained(documents, items, percent).select("doc_id").where("doc_id IS NOT NULL").distinct()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words(table: str, key: str) -> str:
    return rf"SELECT {key}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table}"


def _shingles(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM ({_words(table, key)}) t, range(1, len(t.w) - 3) r(i) WHERE len(w) >= 5"


ORACLE = f"""
    WITH q AS ({_shingles("benchmark", "item_id")}), d AS ({_shingles("documents", "doc_id")}),
    n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
    FROM c JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_shingles"""
