"""Near copies by SimHash probes, verified on word shingles: a similarity of 0.8 and more over five words.

A text's five-word shingles change five at a time with a word, so that their fingerprints lie too far apart to probe.
Its set of distinct words changes one at a time. The probed fingerprint is that of the words, at up to ``distance``
bits, by the generalised pigeonhole of ``simhash``; a second one, of the shingles, drops chance meetings; what is left
is held against the whole sets of shingles.

Near copies of such a similarity may lie further apart than that, the short ones above all. What the probes leave is
found by a prefix filter, which is exact: put in one order, two sets of so high a similarity share one of their first
``n - ceil(similarity * n) + 1`` shingles, and indeed as many of them as the rest of the sets can't make up for.
Shingles that most documents hold come last in the order, which makes the meetings few and changes no result.

Components are all that is wanted, so that links come in rounds: each text with the smallest one it meets, then with the
one it shares most keys with, again and again, and only what stays apart is paired in full, block by block. Pairs
within a component need no look.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_value, one_row_of_each_id, small_batches, summed, text_of, without_ids
from .graph import components
from .simhash import allot, bit_statistics, signed

#: A key that so many fingerprints share shows the probes its smallest member alone; the prefix filter finds the rest.
CROWD = 32
#: Shingle fingerprints of pairs at a similarity of 0.8 differ in 12 bits at the median, in 14 at the 99th percentile.
FAR = 18
#: Shingles that come late in the order, members in a block of a key, and bytes of text to a part of the counted shingles.
OFTEN, BLOCK, PART = 200_000, 1_000, 8 << 20
#: Shingles of a task that are counted at once.
HELD = 1 << 20
ROUNDS, KNOWN = 3, 300_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class Hasher:
    """Hashes of words and of their shingles; A-Z count as lower case, ASCII blanks part words."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for w in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        if len(known) > KNOWN:
            known.clear()
        return np.array(out, np.uint64)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """A hash for each shingle, repeats included (fewer words: the whole sequence)."""
        k = min(self.shingle, len(words))
        if not k:
            return words
        n = len(words) - k + 1
        h = words[:n].copy()
        for i in range(1, k):
            h = h * _P + words[i : i + n]
        h ^= h >> np.uint64(31)
        h *= _Q
        h ^= h >> np.uint64(29)
        return h


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; none: 0."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketches(documents: DataFrame, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, same (a hash of the set of shingles), fp of the distinct words, far of the shingles, n (their number), and keys: the first ones in the common order."""
    order = documents.sparkSession.sparkContext.broadcast(often)  # OFTEN numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (hashes, counts) = Hasher(shingle), order.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                same, fp, far, sizes, keys = [], [], [], [], []
                for t in some.column(1):
                    words = hasher.words(t.as_py() or "")
                    shingles = hasher.shingles(words)
                    h = np.unique(shingles).view(np.int64)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    fp.append(signed(majority(np.unique(words))))
                    far.append(signed(majority(shingles)))
                    met = np.zeros(len(h), np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        met = np.where(hashes[at] == h, counts[at], 0)
                    sizes.append(len(h))
                    keys.append(h[np.lexsort((h, met))][: prefix_size(len(h), similarity)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(same, pa.binary()), pa.array(fp, pa.int64()), pa.array(far, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "fp", "far", "n", "keys"])

    return text_of(documents).mapInArrow(run, "doc_id long, same binary, fp long, far long, n int, keys array<long>")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id and h: its distinct shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                sets = [np.unique(hasher.shingles(hasher.words(t.as_py() or ""))).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "h"])

    return text_of(documents).mapInArrow(run, "doc_id long, h array<long>")


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def probed(nodes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """Pairs a < b of nodes(id, fp, far): each b with the smallest a that the probes bring it together with."""
    prints = scratch.write("prints", nodes.groupBy("fp").agg(F.min(F.struct("id", "far")).alias("n")).select("fp", "n.id", "n.far"))
    alike = nodes.join(prints.select("fp", F.col("id").alias("id2"), F.col("far").alias("far2")), "fp").where((F.col("id") != F.col("id2")) & (apart("far", "far2") <= FAR))
    n, both = bit_statistics(prints)
    parts = allot(max(n, 2), both, distance, 1.0)  # dear pairs: keys stay long enough for few to be crowded
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(p.mask)).alias("key")) for k, p in enumerate(parts)])
    keyed = scratch.write("keyed", prints.select("id", "fp", "far", F.explode(keys).alias("k")).select("id", "fp", "far", "k.part", "k.key"))
    crowded = scratch.write("crowded", keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "far")).alias("least")).where(F.col("n") > CROWD))
    shown = keyed.join(crowded, ["part", "key"], "left_anti").union(crowded.select("least.*", "part", "key")).select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.col("far").alias("far2"), F.col("part").alias("part2"), F.col("key").alias("key2"))
    flips = F.coalesce(*[F.when(F.col("part") == k, F.array(*[F.lit(m) for m in p.flips()])) for k, p in enumerate(parts)])
    probes = keyed.select("id", "fp", "far", "part", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    near = (F.col("id") > F.col("id2")) & (apart("fp", "fp2") <= distance) & (apart("far", "far2") <= FAR)
    met = probes.join(shown, (F.col("part") == F.col("part2")) & (F.col("key") == F.col("key2")) & near)
    out = scratch.write("probed", met.select("id", "id2").union(alike.select("id", "id2")).groupBy(F.col("id").alias("b")).agg(F.min("id2").alias("a")).select("a", "b"))
    scratch.drop("prints", "keyed", "crowded")
    return out


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets of shingles are as similar as that."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(common >= similarity * (F.size("ha") + F.size("hb") - common) - 1e-9).select("a", "b")


def dealt(h: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, once, h, n): the shingles h, which are sorted in place, by equal ranges of hashes: those met once, and the others with their counts.

    One sort, and ranges in place of remainders, so that nothing is put in a second order.
    """
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(first, append=len(h))
    h = h[first]
    # The part of a hash is its upper half times parts, over 2^32; the least hash of each part bounds its range.
    bounds = np.array([-((-k << 32) // parts) << 32 for k in range(1, parts)], np.uint64)
    ends = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
    rows = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
    once, several, counts = [], [], []
    for _, at in rows:
        alone = n[at] == 1
        once.append(h[at][alone].tobytes())
        several.append(h[at][~alone].tobytes())
        counts.append(n[at][~alone].tobytes())
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *[pa.array(x, pa.binary()) for x in (once, several, counts)]], ["part", "once", "h", "n"])


def often_met(documents: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that most documents hold, ascending, and in how many they are: over all of them.

    Tasks add up what they hold and deal it by hash, as arrays: eight bytes for a shingle that a task met once.
    """
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    parts = size // PART + 1
    schema = "part int, once binary, h binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            return dealt(h, parts)

        some = 0
        for batch in batches:
            for t in batch.column(1):
                h = np.unique(hasher.shingles(hasher.words(t.as_py() or "")))
                if len(h):
                    held.append(h)
                    some += len(h)
                if some > HELD:
                    yield added()
                    some = 0
        if held:
            yield added()

    def add(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])
        once, several = read("once", np.uint64), read("h", np.uint64)
        h, n = summed(np.concatenate([once, several]), np.concatenate([np.ones(len(once), np.int64), read("n", np.int64)]))
        return pa.table({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    met = text_of(documents).mapInArrow(run, schema).groupBy("part").applyInArrow(add, "h long, n long")
    table = met.orderBy(F.desc("n"), "h").limit(OFTEN).orderBy("h").toArrow()  # OFTEN bounds it
    return table["h"].to_numpy(), table["n"].to_numpy()


def may_be(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets can be as similar as that if this is the first shingle in order that they share; exact.

    All that they share then stands at or after its places. A common passage's shingles come late in the order, so that
    texts that share nothing before them don't meet.
    """
    return F.least(a["n"] - a["at"], b["n"] - b["at"]) >= similarity / (1 + similarity) * (a["n"] + b["n"]) - 1e-9


def labelled(keyed: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The keyed rows with their component as ``label``, and the keys that several components share."""
    if labels is None:
        named = keyed.withColumn("label", F.col("id"))
    else:
        named = keyed.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    shared = named.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return named, shared


def to_most_met(named: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b): each text b with the text a of another component that it shares most keys with.

    Of each key the smallest text of its smallest component stands for it: linear in the rows.
    """
    small = named.join(shared.select("key", F.col("low").alias("label")), ["key", "label"]).groupBy("key", "label").agg(F.min("id").alias("id"))
    ones = named.join(small.select("key", "id"), ["key", "id"]).select("key", F.struct("id", "n", "at", "label").alias("one"))
    rows = named.join(ones, "key").select(F.struct("id", "n", "at", "label").alias("two"), "one")
    met = rows.where((F.col("one.label") != F.col("two.label")) & may_be(F.col("one"), F.col("two"), similarity)).groupBy(F.col("one.id").alias("a"), F.col("two.id").alias("b")).count()
    best = met.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_pairs(named: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of each key's members of different components, BLOCK by BLOCK."""
    rows = named.join(shared.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key")
    rows = rows.select("key", F.struct("id", "n", "at", "label").alias("doc"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left, right = rows.select("key", F.col("mine").alias("i"), F.col("other").alias("j"), F.col("doc").alias("one")), rows.select("key", F.col("other").alias("i"), F.col("mine").alias("j"), F.col("doc").alias("two"))
    apart_ = (F.col("one.id") < F.col("two.id")) & (F.col("one.label") != F.col("two.label")) & may_be(F.col("one"), F.col("two"), similarity)
    return left.join(right, ["key", "i", "j"]).where(apart_).select(F.col("one.id").alias("a"), F.col("two.id").alias("b")).distinct()


def with_keys_enough(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows(doc_id, n, keys) whose first keys share as many as they must; exact.

    Sets a and b in one order, with first parts of p_a and p_b shingles of which c are common: what else they share lies
    in the rest of a or in the rest of b, so that c + max(n_a - p_a, n_b - p_b) shingles are common at most.
    """
    of = lambda side: rows.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("keys").alias(f"k{side}"))
    c, rest = F.size(F.array_intersect("ka", "kb")), lambda x: F.col(f"n{x}") - F.size(f"k{x}")
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(c + F.greatest(rest("a"), rest("b")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def near_copies(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, component_id) of the documents(doc_id, text) that have a copy of a smaller doc_id, doc_ids being unique.

    Copies are texts of equal shingles, A-Z in lower case, and all others of that similarity; component_id is the
    smallest doc_id that links reach. Texts without words are copies of each other. Rows without an id take no part.
    Fingerprints at up to ``distance`` bits find most links at little cost, the prefix filter all others.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near-copies")
    documents = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    with small_batches(spark):
        rows = scratch.write("sketches", sketches(documents, shingle, similarity, often_met(documents, shingle)))
    nodes = scratch.write("nodes", rows.groupBy("same").agg(F.min("doc_id").alias("id")))
    firsts = scratch.write("firsts", rows.select("doc_id", "same").join(nodes.withColumnRenamed("id", "first"), "same").where("first <> doc_id").select("doc_id", "first"))
    whole = without_ids(rows, firsts.select("doc_id"))
    edges, labels, rounds = None, None, 0

    def link(pairs: DataFrame) -> bool:
        """Verifies the pairs and adds those that hold to the edges; whether there are any. Pairs within a component need no look."""
        nonlocal edges, labels, rounds
        rounds += 1
        if labels is not None:
            of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(la, a) <=> coalesce(lb, b)").select("a", "b")
        pairs = scratch.write(f"pairs-{rounds}", pairs)
        some = False
        if pairs.limit(1).count():
            members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            with small_batches(spark):
                sets = scratch.write(f"sets-{rounds}", shingle_sets(documents.join(members, "doc_id", "left_semi"), shingle))
            held = scratch.write(f"edges-{rounds}", verified(pairs, sets, similarity))
            scratch.drop(f"sets-{rounds}")
            if some := bool(held.limit(1).count()):
                edges = held if edges is None else edges.union(held)
                labels = components(edges, scratch)
        scratch.drop(f"pairs-{rounds}")
        return some

    link(probed(whole.where("n > 0").select(F.col("doc_id").alias("id"), "fp", "far"), distance, scratch))
    keyed = whole.select(F.col("doc_id").alias("id"), "n", F.posexplode("keys").alias("at", "key"))
    often = keyed.groupBy("key").count().where("count > 1").select("key")
    keyed = scratch.write("shared", keyed.join(often, "key", "left_semi"))
    scratch.drop("probed")
    for k in range(ROUNDS):
        if not link(to_most_met(*labelled(keyed, labels), similarity)):
            break
        # Keys whose members are all linked by now need no further look.
        keyed = scratch.write(f"shared-{k}", keyed.join(labelled(keyed, labels)[1].select("key"), "key", "left_semi"))
        scratch.drop(f"shared-{k - 1}" if k else "shared")
    link(with_keys_enough(all_pairs(*labelled(keyed, labels), similarity), whole, similarity))
    scratch.drop("sketches", "nodes", *[x for x in scratch.paths if x.startswith("shared")])
    if labels is None:
        return firsts.withColumnRenamed("first", "component_id")
    near = labels.where("label <> node")
    copies = firsts.join(near.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("label", "first").alias("component_id"))
    return copies.union(near.select(F.col("node").alias("doc_id"), F.col("label").alias("component_id")))


def one_of_each_group(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 3) -> DataFrame:
    """documents without those that have a copy or near copy of a smaller doc_id, over any number of links.

    Rows that share an id count as one document, of which the row with the smallest text stays. Rows without an id stay.
    """
    scratch = Scratch(documents.sparkSession, "near-copies-keep")
    documents = one_row_of_each_id(documents, scratch)
    gone = scratch.write("gone", near_copies(documents, similarity, shingle, distance).select("doc_id"))
    return without_ids(documents, gone)


by_value(__name__)
