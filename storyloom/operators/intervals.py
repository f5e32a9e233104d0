"""Interval algebra over timelines: rows are (key, id, start, end[, label]) with seconds as doubles.

Rows without a start or an end take no part where starts and ends are compared. Columns of the caller keep their names;
those made on the way begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(*more: str) -> Window:
    return Window.partitionBy("key").orderBy("start", *more, "id")


def folded(rows: DataFrame, columns: list[str], step, schema: str) -> DataFrame:
    """Folds over the rows of each key in order of (start, end, id), without gathering a key.

    ``step(key, row)`` gets rows one by one, and None at a key's end; it yields tuples of the schema. Rows come sorted
    in Arrow batches, so that a key may be of any size.
    """
    sorted_ = rows.select("key", *columns).repartition("key").sortWithinPartitions("key", *[c for c in ("start", "end", "id") if c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fold, last = [x.strip().split(" ")[0] for x in schema.split(",")], None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if fold is None or r["key"] != last:
                    if fold is not None:
                        out += fold(last, None)
                    fold, last = step(), r["key"]
                out += fold(last, r)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)
        if fold is not None and (out := list(fold(last, None))):
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return sorted_.mapInArrow(run, schema)


def islands(rows: DataFrame, gap: float, new_if: Column | None = None) -> DataFrame:
    """rows with ``island``: a row starts a new one if it begins over ``gap`` after all before it have ended."""
    w = order()
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("start") - reach > gap)
    return rows.withColumn("__new", (new if new_if is None else new | new_if).cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge(rows: DataFrame, gap: float = 0.0) -> DataFrame:
    """(key, island, start, end, n): intervals that overlap, touch or lie within ``gap`` as one."""
    return islands(rows, gap).groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def merge_same_label(rows: DataFrame, gap: float, *labels: str) -> DataFrame:
    """Rows that follow each other with the same labels (default: label) within ``gap`` as one."""
    w, labels = order(), labels or ("label",)
    turned = ~F.lag(F.struct(*labels)).over(w).eqNullSafe(F.struct(*labels))
    marked = rows.withColumn("__turn", F.sum(turned.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("key", "__turn").orderBy("start", "id")
    reach = F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("__new", (reach.isNull() | (F.col("start") - reach > gap)).cast("int")).withColumn("__part", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "__turn", "__part").agg(*[F.first(x).alias(x) for x in labels], F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("__turn", "__part")


def padded(rows: DataFrame, by: float = 0.2) -> DataFrame:
    """(key, id, start, end): intervals longer by ``by`` at both ends, from 0 on, and merged."""
    wider = rows.select("key", "id", F.greatest(F.col("start") - by, F.lit(0.0)).alias("start"), (F.col("end") + by).alias("end"))
    return merge(wider).select("key", F.col("island").alias("id"), "start", "end")


def bucketed_pairs(a: DataFrame, b: DataFrame, width: float, condition: Column, most: int = 64) -> DataFrame:
    """Pairs of overlapping intervals of one key. Both are dealt to time buckets; a pair is kept in its first shared one.

    Columns of b are start_b, end_b, id_b. An equi-join on (key, bucket) in place of a nested loop over the key.
    Intervals of over ``most`` buckets are dealt to wider ones, by powers of ``most``, so that none is dealt often;
    each pair meets in buckets of the wider one of the two.
    """

    def dealt(rows: DataFrame, end: str) -> tuple[DataFrame, Column]:
        length = (F.col(f"end{end}") - F.col(f"start{end}")) / width
        return rows.where(F.col(f"start{end}").isNotNull() & F.col(f"end{end}").isNotNull()), F.greatest(F.lit(0), F.ceil(F.log(float(most), F.greatest(length, F.lit(1.0)))) - 1).cast("int")

    left, level = dealt(a, "")
    right, level_b = dealt(b.select("key", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "key"]), "_b")
    left, right = left.withColumn("__level", level), right.withColumn("__level_b", level_b)
    top = max([x[0] or 0 for x in (left.agg(F.max("__level")).first(), right.agg(F.max("__level_b")).first())])
    found = None
    for k in range(top + 1):
        step = width * most**k
        place = lambda x, step=step: F.floor(F.col(x) / step)
        one = left.where(F.col("__level") <= k).withColumn("__bucket", F.explode(F.sequence(place("start"), place("end"))))
        two = right.where(F.col("__level_b") <= k).withColumn("__bucket", F.explode(F.sequence(place("start_b"), place("end_b"))))
        once = (F.col("__bucket") == F.greatest(place("start"), place("start_b"))) & (F.greatest("__level", "__level_b") == k)
        some = one.join(two, ["key", "__bucket"]).where(once & condition).drop("__bucket", "__level", "__level_b")
        found = some if found is None else found.union(some)
    return found


def overlaps(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    return bucketed_pairs(a, b, width, (F.col("end") > F.col("start_b")) & (F.col("start") < F.col("end_b")))


def contained_in(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    return bucketed_pairs(a, b, width, (F.col("start") >= F.col("start_b")) & (F.col("end") <= F.col("end_b")))


def overlap_share(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """(key, id, share): how much of each interval of a the merged intervals of b cover."""
    whole = merge(b).withColumnRenamed("island", "id")
    part = overlaps(a, whole, width).groupBy("key", "id").agg(F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("__held"))
    return a.join(part, ["key", "id"], "left").select("key", "id", (F.coalesce("__held", F.lit(0.0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))).alias("share"))


def longest_overlap(a: DataFrame, b: DataFrame, width: float, default: str) -> DataFrame:
    """(key, id, label): for each interval of a the label of the one of b that overlaps it longest; ties: the smallest id of b."""
    met = overlaps(a.select("key", "id", "start", "end"), b.select("key", "id", "start", "end", F.col("label").alias("tag")), width)
    size = F.round(F.least("end", "end_b") - F.greatest("start", "start_b"), 9)
    best = met.groupBy("key", "id").agg(F.max_by("tag_b", F.struct(size, -F.col("id_b"))).alias("__label"))
    return a.join(best, ["key", "id"], "left").select("key", "id", F.coalesce("__label", F.lit(default)).alias("label"))


def nearest_in_time(rows: DataFrame, known: Column, value: str) -> DataFrame:
    """rows with ``nearest``: the value of the known row nearest in start, itself included; ties: the earlier."""
    w = order()
    at, val = F.when(known, F.col("start")), F.when(known, F.col(value))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumn("__t0", F.last(at, True).over(back)).withColumn("__v0", F.last(val, True).over(back)).withColumn("__t1", F.first(at, True).over(ahead)).withColumn("__v1", F.first(val, True).over(ahead))
    earlier = F.col("__t1").isNull() | (F.col("start") - F.col("__t0") <= F.col("__t1") - F.col("start"))
    return out.withColumn("nearest", F.when(F.col("__t0").isNotNull() & earlier, F.col("__v0")).otherwise(F.col("__v1"))).drop("__t0", "__v0", "__t1", "__v1")


def last_known(rows: DataFrame, value: str) -> DataFrame:
    """rows with ``known``: the last value that was not null at or before each row of its key."""
    return rows.withColumn("known", F.last(value, True).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def sliding_windows(rows: DataFrame, size: float, hop: float, least: float) -> DataFrame:
    """(key, id, win, start, end): windows of ``size`` every ``hop``, the last one flush with the end; short rows: one whole window."""
    length = F.col("end") - F.col("start")
    steps = F.floor((length - size) / hop + 1e-9)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(steps, F.lit(0))), lambda k: F.col("start") + k * hop)
    tail = F.when(steps * hop + size < length - 1e-9, F.array(F.col("end") - size)).otherwise(F.array().cast("array<double>"))
    all_ = F.when(length < least, F.array().cast("array<double>")).when(length < size, F.array("start")).otherwise(F.concat(starts, tail))
    return rows.select("key", "id", F.posexplode(all_).alias("win", "s"), "end").select("key", "id", "win", F.col("s").alias("start"), F.least(F.col("s") + size, F.col("end")).alias("end"))


def file_windows(rows: DataFrame, size: float, hop: float) -> DataFrame:
    """(key, id, win, start, end): windows every ``hop`` from the start on, ends cut at the end of the row."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / hop), F.lit(0)).cast("long")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: F.col("start") + k * hop)
    return rows.where(n > 0).select("key", "id", F.posexplode(starts).alias("win", "s"), "end").select("key", "id", "win", F.col("s").alias("start"), F.least(F.col("s") + size, F.col("end")).alias("end"))


def frames(rows: DataFrame, size: int = 512) -> DataFrame:
    """(key, id, frame, samples): samples in frames of ``size``, the last one padded with zeros."""
    n = F.size("samples")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda k: F.slice("samples", k + 1, size))
    each = rows.where(n > 0).select("key", "id", F.posexplode(cut).alias("frame", "s"))
    return each.select("key", "id", "frame", F.concat("s", F.array_repeat(F.lit(0.0), size - F.size("s"))).alias("samples"))


def frame_mean(rows: DataFrame, chances: DataFrame, size: int = 512) -> DataFrame:
    """rows(key, id, start, end: samples) with quality: the mean of chances(key, values) of the frames they touch, four digits; none: 0."""
    first = F.floor(F.col("start") / size)
    many = F.greatest(F.ceil(F.col("end") / size), first + 1) - first
    some = F.slice("values", (first + 1).cast("int"), many.cast("int"))
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))
    return rows.join(chances.select("key", "values"), "key", "left").withColumn("quality", F.coalesce(F.when(F.col("end") > F.col("start"), F.round(mean, 4)), F.lit(0.0))).drop("values")


def runs(rows: DataFrame, on: Column, ends: DataFrame, least: float = 3.0) -> DataFrame:
    """(key, start, end): runs of rows(key, id, start) where ``on`` holds, over ``least`` long.

    A run ends where the next row begins that is off; the last one at the total of ends(key, total).
    """
    w = order()
    marked = rows.withColumn("__on", F.coalesce(on, F.lit(False))).withColumn("__next", F.lead("start").over(w))
    marked = marked.withColumn("__run", F.sum((F.col("__on") != F.coalesce(F.lag("__on").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = marked.where("__on").groupBy("key", "__run").agg(F.min("start").alias("start"), F.max(F.struct("start", "id", "__next")).alias("__last"))
    both = held.join(ends.select("key", "total"), "key").select("key", "start", F.coalesce("__last.__next", "total").alias("end"))
    return both.where(F.col("end") - F.col("start") > least)


def supported(rows: DataFrame, gap: float = 0.6) -> DataFrame:
    """rows whose neighbour before or after has the same label and lies within ``gap``."""
    w = order()
    before = F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.lag("end").over(w) >= F.col("start") - gap)
    after = F.lead("label").over(w).eqNullSafe(F.col("label")) & (F.lead("start").over(w) <= F.col("end") + gap)
    marked = rows.withColumn("__held", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    return marked.where("__held").drop("__held")


def above_mean(rows: DataFrame, value: str, times: float = 1.5) -> DataFrame:
    """rows with ``on``: whether the value is over ``times`` the mean of its key."""
    mean = rows.groupBy("key").agg((F.avg(value) * times).alias("__bar"))
    return rows.join(mean, "key").withColumn("on", F.col(value) > F.col("__bar")).drop("__bar")


def clamped(rows: DataFrame, totals: DataFrame, least: float = 0.04) -> DataFrame:
    """rows(key, id, start, end, ...) within 0 and the total of their key, three digits, with reason: too_short or null."""
    out = rows.join(totals.select("key", "total"), "key").withColumn("start", F.greatest(F.col("start"), F.lit(0.0))).withColumn("end", F.least("end", "total")).drop("total")
    return out.withColumn("reason", F.when(F.col("end") - F.col("start") < least, "too_short")).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


def repair_overlaps(rows: DataFrame, least: float = 0.04) -> DataFrame:
    """(key, id, start, end, quality, reason): overlapping neighbours are cut in the middle of their overlap, leaving ``least`` to each.

    What is too short then is dropped, with a reason; each cut changes the row before, so that this is a fold.
    """

    def step():
        held: list[dict] = []  # rows that a later one may still reach into
        told = lambda key, r, reason=None: (key, r["id"], r["start"], r["end"], r["quality"], reason)

        def fold(key, row):
            while held and (row is None or held[0]["end"] <= row["start"]):
                yield told(key, held.pop(0))
            if row is None:
                return
            row = dict(row)
            if held and row["start"] < held[-1]["end"]:
                last = held[-1]
                cut = min(max(round((last["end"] + row["start"]) / 2, 3), round(last["start"] + least, 3)), round(row["end"] - least, 3))
                last["end"] = row["start"] = cut
                if last["end"] - last["start"] < least:
                    yield told(key, held.pop(), "overlap_repair_prev_too_short")
                if row["end"] - row["start"] < least:
                    yield told(key, row, "overlap_repair_next_too_short")
                    return
            held.append(row)

        return fold

    kinds = dict(rows.dtypes)
    return folded(rows, ["id", "start", "end", "quality"], step, f"key {kinds['key']}, id {kinds['id']}, start double, end double, quality double, reason string")


def rescued(base: DataFrame, more: DataFrame, totals: DataFrame, guard: float, least: float = 0.08) -> DataFrame:
    """(key, id, start, end, quality) of ``more`` that lie farther than ``guard`` from all of base and from those taken before.

    Rows are (key, id, start, end, quality). One pass over both in order of time: the latest end so far and the next
    base interval decide.
    """
    held = more.join(totals.select("key", "total"), "key").select("key", "id", F.greatest(F.col("start"), F.lit(0.0)).alias("start"), F.least("end", "total").alias("end"), "quality").where(F.col("end") - F.col("start") >= least)
    both = base.select("key", "id", "start", "end", "quality", F.lit(True).alias("old")).unionByName(held.withColumn("old", F.lit(False)))
    w = Window.partitionBy("key").orderBy("start", F.desc("old"), "end", "id")
    before = F.max(F.when(F.col("old"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("old"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    far = both.withColumn("__far", ~F.coalesce(F.col("start") < before + guard, F.lit(False)) & ~F.coalesce(F.col("end") > after - guard, F.lit(False))).where("NOT old AND __far")

    def step():
        upto = [float("-inf")]

        def fold(key, row):
            if row is not None and row["start"] >= upto[0] + guard:
                upto[0] = max(upto[0], row["end"])
                yield (key, row["id"], round(row["start"], 3), round(row["end"], 3), row["quality"])

        return fold

    kinds = dict(base.dtypes)
    return folded(far, ["id", "start", "end", "quality"], step, f"key {kinds['key']}, id {kinds['id']}, start double, end double, quality double")


def with_rescued(base: DataFrame, more: DataFrame, totals: DataFrame, guard: float, least: float = 0.08, shortest: float = 0.04) -> DataFrame:
    """(key, id, start, end, quality, reason): base and what ``rescued`` adds to it as one timeline, clamped and repaired again.

    Rows that end up shorter than ``shortest`` carry a reason, as after ``repair_overlaps``; the others have null. Ids of both are
    taken to differ. Keys without a total are left out.
    """
    columns = ["key", "id", "start", "end", "quality"]
    both = base.select(*columns).unionByName(rescued(base, more, totals, guard, least).select(*columns))
    held = clamped(both.withColumn("quality", F.col("quality").cast("double")), totals, shortest)
    out = repair_overlaps(held.where("reason IS NULL").select(*columns), shortest)
    return out.unionByName(held.where("reason IS NOT NULL").select(out.columns))


def sound_timeline(voice: DataFrame, ambience: DataFrame, gap: float) -> DataFrame:
    """Events(key, id, start, end, label) of two detectors as one timeline; those of one label within ``gap`` are one, whoever heard them.

    A repeated row merges with itself; rows without times have no part.
    """
    columns = ["key", "id", "start", "end", "label"]
    return merge_same_label(voice.select(*columns).unionByName(ambience.select(*columns)), gap, "label")


def capped_groups(rows: DataFrame, gap: float, most: float) -> DataFrame:
    """(key, grp, first, last, start, end, n): rows in order, joined while the gap is at most ``gap`` and the whole at most ``most`` long.

    The cap depends on where a group began, so that it is a fold over sorted rows.
    """

    def step():
        group: list = []

        def fold(key, row):
            if row is not None and group and row["start"] - group[3] <= gap and row["end"] - group[2] <= most:
                group[1], group[3], group[4] = row["id"], row["end"], group[4] + 1
                return
            if group:
                yield (key, *group)
            if row is not None:
                group[:] = [row["id"], row["id"], row["start"], row["end"], 1]

        return fold

    kinds = dict(rows.dtypes)
    found = folded(rows, ["id", "start", "end"], step, f"key {kinds['key']}, first {kinds['id']}, last {kinds['id']}, start double, end double, n long")
    return found.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("start", "first")) - 1).alias("grp"), "first", "last", "start", "end", "n")


def speech_statistics(rows: DataFrame) -> DataFrame:
    """(key, n, seconds, mean_quality, n_low, shift_ms): rows(key, start, end, quality, shift_ms)."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), 3).alias("seconds"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 4).alias("mean_quality"), F.count_if(F.col("quality") < 0.3).alias("n_low"), F.round(F.coalesce(F.max(F.abs("shift_ms")), F.lit(0.0)), 2).alias("shift_ms"))


def chunk_boundaries(segments: DataFrame, totals: DataFrame, seconds: float = 1200.0) -> DataFrame:
    """(key, boundary): equal chunks of about ``seconds``, each inner boundary moved to the middle of the nearest silence; repeats go.

    Silences lie between segments(key, start, end), and at the ends of totals(key, total). Ties: the earlier silence.
    """
    w = Window.partitionBy("key").orderBy("start", "end")
    rows = segments.join(totals, "key").select("key", "start", "end", "total", F.lead("start").over(w).alias("__next"), F.lag("end").over(w).alias("__before"))
    mids = rows.select("key", F.explode(F.array(F.when(F.col("__before").isNull() & (F.col("start") > 0), F.col("start") / 2), F.when(F.col("__next").isNotNull(), (F.col("end") + F.col("__next")) / 2), F.when(F.col("__next").isNull() & (F.col("end") < F.col("total")), (F.col("end") + F.col("total")) / 2))).alias("mid")).where("mid IS NOT NULL")
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / seconds)).cast("int")
    wanted = totals.where(n > 1).select("key", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: k * (F.col("total") / n))).alias("want"))
    near = wanted.join(mids, "key", "left").groupBy("key", "want").agg(F.min_by("mid", F.struct(F.abs(F.col("mid") - F.col("want")), "mid")).alias("mid"))
    inner = near.select("key", F.coalesce("mid", "want").alias("boundary"))
    return inner.union(totals.select("key", F.explode(F.array(F.lit(0.0), "total")))).distinct()


def without_silent_chunks(boundaries: DataFrame, segments: DataFrame, width: float = 1200.0) -> DataFrame:
    """(key, boundary) without those between a silent chunk and its neighbour; the first and the last boundary stay.

    An inner boundary stays if the chunk before it has speech and any chunk after it has.
    """
    w = Window.partitionBy("key").orderBy("boundary")
    chunks = boundaries.select("key", "boundary", F.row_number().over(w).alias("id"), F.lag("boundary").over(w).alias("start"), F.col("boundary").alias("end"))
    said = overlaps(chunks.where("start IS NOT NULL"), segments.select("key", "start", "end", F.lit(0).alias("id")), width).select("key", "id").distinct()
    marked = chunks.join(said.withColumn("__said", F.lit(1)), ["key", "id"], "left")
    later = F.sum("__said").over(w.rowsBetween(1, Window.unboundedFollowing))
    outer = F.col("start").isNull() | F.lead("boundary").over(w).isNull()
    return marked.select("key", "boundary", (outer | (F.col("__said").isNotNull() & (later > 0))).alias("__on")).where("__on").drop("__on")
