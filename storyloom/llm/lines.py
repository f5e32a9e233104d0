"""Line dedup by winnowing over line hashes. DataFrame functions only.

A text is cut into units: lines, and the sentences of a line. A run of units counts as repeated if it has ``LEAST`` words
(a unit counts as one at least), and an equal run of units occurs earlier, in another text or this one. Every unit of a
repeated run is deleted from the later place.

Fingerprints are hashes of two units in a row; winnowing selects those that are no larger than a neighbour's, and pairs
of ``LEAST`` words; a unit of that many words is a fingerprint of its own. Every run that counts holds a selected
fingerprint, which is selected in the earlier place too: that is guaranteed. Fingerprints that occur once go.

Matches extend both ways around the places of the others: of the runs that just count and whose smallest fingerprint it
is, those that begin at a unit before it and those that end at a unit after it are looked up, and the first place of each
wins.
A repeated run is the union of such shortest runs (one begins at each of its units, or else one ends at its last unit and
reaches back over it), so that nothing of it is lost wherever its parts occurred first, and however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

LEAST = 20
CUT = r"(?<=\n|[.!?]\x20)(?!\n)(?!\z)|(?<=\n|[.!?]\x20)(?=\z)"
MARK = "\u0001"
NONE = -(1 << 63)


def units_of(text: Column) -> Column:
    """The units of a text, cut after line ends (the last of several) and sentence ends; joined they give the text again."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    marked = F.replace(marked, F.lit(MARK + "\n"), F.lit("\n"))
    # Splitting at one character needs no regular expression.
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, CUT, -1)).otherwise(F.split(marked, MARK, -1))


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and id and th, which name a row whatever the order in which rows are read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(NONE)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"))


def pinned(rows: DataFrame) -> DataFrame:
    """rows whose columns are values: the optimizer would else write them into lambdas, to be made anew for every unit."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("__row")).select("__row.*")


def with_sizes(rows: DataFrame, names: dict[str, str], least: int) -> DataFrame:
    """rows with a column for each of names (words of units -> new column): for each unit how many units from it on just count; 0 if the text ends before.

    Sums of 1, 2, 4, ... units in a row; then, from the longest down, what still stays under ``least`` is passed over.
    """
    steps = [1 << k for k in range(least.bit_length())]
    bits = least.bit_length() + 1  # a unit's state is one number: units passed over, then their words in so many bits

    def doubled(sums: str, k: int) -> Column:
        return F.transform(sums, lambda x, i: x + F.get(sums, i + k))

    def passed(done: Column, sums: str, k: int) -> Column:
        more = lambda r, i: F.get(sums, i + F.shiftright(r, bits))
        return F.transform(done, lambda r, i: F.when(r.bitwiseAND((1 << bits) - 1) + more(r, i) < least, r + more(r, i) + (k << bits)).otherwise(r))

    own = rows.columns
    rows = rows.select("*", *[F.col(w).alias(f"__{w}_1") for w in names])
    for k in steps[:-1]:
        rows = pinned(rows.select("*", *[doubled(f"__{w}_{k}", k).alias(f"__{w}_{2 * k}") for w in names]))
    for w, out in names.items():
        done = F.array_repeat(F.lit(0), F.size(w))
        for k in reversed(steps):
            done = passed(done, f"__{w}_{k}", k)
        n = F.size(w)
        rows = rows.withColumn(out, F.transform(done, lambda r, i: F.when(i + F.shiftright(r, bits) < n, F.shiftright(r, bits) + 1).otherwise(0)))  # noqa: B023
    return rows.select(*own, *names.values())


def fingerprints(units: DataFrame) -> DataFrame:
    """(id, th, at, key): the selected fingerprints of each text and the units at which they begin."""
    spread = units.select("id", "th", "hashes", "pairs", "ahead", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("at"))
    g = lambda k: F.get("pairs", F.col("at") + k)
    size = lambda k: F.get("ahead", F.col("at") + k)
    chosen = F.coalesce(g(0) <= g(-1), F.lit(False)) | F.coalesce(g(0) <= g(1), F.lit(False)) | (size(0) == 2)
    key = F.when(size(0) == 1, F.xxhash64(F.get("hashes", F.col("at")), F.lit("alone"))).when((size(1) != 1) & chosen, g(0))
    return spread.select("id", "th", "at", key.alias("key")).where("key IS NOT NULL")


def runs_around(hits: DataFrame) -> DataFrame:
    """(id, th, first, size, key): the shortest runs around a hit; hits(id, th, hits, hashes, pairs, ahead, back, most).

    A run is looked up if its smallest fingerprint is a hit: that one is selected wherever the run occurs.
    """
    each = hits.select("id", "th", "hashes", "pairs", "ahead", "back", "most", F.explode("hits").alias("at"))
    begins = each.select("*", F.explode(F.sequence(F.greatest(F.col("at") - F.col("most") + 1, F.lit(0)), F.col("at"))).alias("first")).withColumn("size", F.get("ahead", F.col("first")))
    ends = each.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + F.col("most") - 1, F.size("hashes") - 1))).alias("last"))
    ends = ends.withColumn("size", F.get("back", F.col("last"))).withColumn("first", F.col("last") - F.col("size") + 1).drop("last")
    both = begins.where((F.col("size") > 0) & (F.col("first") + F.col("size") > F.col("at"))).unionByName(ends.where((F.col("size") > 0) & (F.col("first") <= F.col("at"))))
    # A long unit, which can only be the first or the last of such a run, marks it; else its smallest pair does (ties: any).
    last, long_ = F.col("first") + F.col("size") - 1, lambda at: F.get("ahead", at) == 1
    smallest = F.array_min(F.slice("pairs", F.col("first") + 1, F.col("size") - 1)) == F.get("pairs", F.col("at"))
    least = F.when(long_(F.col("first")), F.col("at") == F.col("first")).when(long_(last), F.col("at") == last).otherwise((F.col("at") < last) & smallest)
    return both.where(least).select("id", "th", "first", "size", F.xxhash64(F.slice("hashes", F.col("first") + 1, F.col("size"))).alias("key"))


def repeated_units(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """identified documents, and (id, th, n_units, dropped) of each text: the unit numbers that go, ascending; null if none."""
    scratch = Scratch(documents.sparkSession, "lines")
    docs = identified(documents)
    told = F.transform(units_of(F.col("text")), lambda u: F.struct(F.xxhash64(F.btrim(u, F.lit(" \n\r\t"))).alias("h"), F.greatest(F.regexp_count(u, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).alias("w")))
    told = pinned(docs.select("id", "th", told.alias("told")))
    told = pinned(told.select("id", "th", F.col("told.h").alias("hashes"), F.col("told.w").alias("words"), F.reverse("told.w").alias("backwards")))
    pairs = F.transform("hashes", lambda h, k: F.xxhash64(h, F.get("hashes", k + 1)))
    told = pinned(with_sizes(told.withColumn("pairs", F.slice(pairs, F.lit(1), F.size("hashes") - 1)), {"words": "ahead", "backwards": "back"}, least).withColumn("back", F.reverse("back")))
    # A run that ends here and is also the shortest one that begins at its first unit is looked up anyhow.
    back = F.transform("back", lambda n, i: F.when(F.get("ahead", i - n + 1) == n, 0).otherwise(n))
    units = told.select("id", "th", "hashes", "pairs", "ahead", back.alias("back"))
    units = scratch.write("units", units.select("*", F.greatest(F.array_max("ahead"), F.array_max("back")).alias("most"), F.size("hashes").alias("n_units")))
    sizes = scratch.write("sizes", units.select("id", "th", "n_units").distinct())
    units = units.drop("n_units")
    marks = fingerprints(units)
    often = scratch.write("often", marks.groupBy("key").count().where("count > 1").select("key"))  # a table, so that the join below can split a hot key
    hits = marks.join(often, "key").groupBy("id", "th").agg(F.collect_set("at").alias("hits"))
    hits = scratch.write("hits", units.join(hits, ["id", "th"]).where("most > 0"))
    scratch.drop("units", "often")
    runs = scratch.write("runs", runs_around(hits))
    scratch.drop("hits")
    place = F.struct("id", "th", "first")
    firsts = scratch.write("firsts", runs.groupBy("key").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("key", "earliest"))
    later = runs.join(firsts, "key").where(place > F.col("earliest"))
    spans = later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    dropped = F.sort_array(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["size"] - 1)))))
    gone = scratch.write("gone", spans.select("id", "th", dropped.alias("dropped")))
    scratch.drop("runs", "firsts")
    return docs, sizes.join(gone, ["id", "th"], "left")


def dedup_lines(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each row of documents(doc_id, text): doc_id, n_units, dropped (unit numbers from 0, ascending), text.

    Blanks at a unit's ends don't count, all else does. The order of texts is that of doc_id (null first), equal ids in
    the order of their texts' hashes: of exact copies the first stays, and the others keep no run that counts. The first
    place of every unit stays. Null and empty texts have one empty unit, which is never deleted. A run repeated within
    one text is deleted there too. Rows of equal id and text share their result. An empty table gives an empty table.
    Extra columns are ignored.
    """
    docs, told = repeated_units(documents, least)
    out = docs.join(told, ["id", "th"], "left")
    whole, none = F.col("dropped").isNull(), F.size("dropped") == F.col("n_units")
    # Only texts that lose a part are cut again. The generator keeps the optimizer from doing so anew for every unit.
    out = out.select("doc_id", "text", "n_units", "dropped", F.explode(F.array(F.when(~(whole | none), units_of(F.col("text"))))).alias("units"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("units") - 1), F.col("dropped"))
    left = F.array_join(F.transform(stay, lambda k: F.get("units", k)), "")
    return out.select("doc_id", "n_units", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.when(whole, F.col("text")).when(none, F.lit("")).otherwise(left).alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, ties and empty tables as in ``dedup_lines``."""
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_units", "dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
