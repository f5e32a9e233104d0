"""LM scoring by logistic context mixing, beside a unigram base score.

A text is the stream of its lower-case words, each closed by a blank, and a line end at the end. Each byte is coded bit
by bit. Predictors count zeros and ones by context: for every order from 0 to ``ORDERS - 1`` the last bytes of the word,
hashed into ``SLOTS`` slots, and the whole start of the word so far. Their chances are stretched to logits and combined
by weights that a gate selects: the bit's place and how often the longest known context was met. The mix is refined by
an adaptive table that maps what was predicted to what came. The sum of -log2 over all bits, divided by bytes, is the
text's bits per byte.

The last bytes reach over a word's start, as far as the orders do: a word's first ``HEAD`` bytes hang on the last ones of
the word before it, all further ones on the word alone. So the bytes from there on are evaluated once for each distinct
word, and the first ones once for each distinct four bytes around a blank, a ``head``, however often they occur. A text
begins as after a blank. The counts of the starts of words have no fixed size: they grow with the vocabulary and lie in a
table that is dealt by the words' first ``cut`` bytes (sorted words share a start in a row). Starts of fewer bytes are
hashed like the orders.

Training covers all training texts and is spread: word counts, head counts and context counts add up over tasks; weights
and the refining table are learned online by each task, mini-batch by mini-batch with a bit's own occurrence taken out of
the counts, and are averaged. Scores use the frozen model, so that they don't depend on how rows are dealt.

Words that occur most often, ``HEAVY`` at most, are looked up in a broadcast table, all others by a join. So are heads,
``HEADS`` at most; all others are evaluated where they are met.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, summed, table, text_of

ORDERS, SLOT_BITS, BLOCK, HEAVY = 4, 19, 1 << 13, 100_000
SLOTS, TABLES = 1 << SLOT_BITS, ORDERS + 1  # the last table: starts of words of fewer bytes than the cut
BUCKETS, PRIOR, RATE = 33, 0.05, 0.02
MET = np.array([1.5, 3.5, 15.5, 255.5])  #: how often a start was met: the borders of the gate's classes
GATES = 2 * 8 * (ORDERS + len(MET) + 1)  # the second half is that of heads
DEPTH, CHUNK, GROUP, MINI = 32, 20_000, 1 << 18, 1 << 12
END = b""  #: the end token; no word is empty
HEAD = ORDERS - 2  #: first bytes of a word whose contexts reach over the blank before it, and as many bytes before that
HEADS, PARTS, PASSES = 1 << 20, 64, 4
BATCH = 1 << 20
LEARNER = 1 << 16  #: distinct words of a learner
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEADING = np.array([8] + [7 - int(x).bit_length() + 1 for x in range(1, 256)], np.int32)  # zero bits before the first one
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def coded(token: bytes) -> bytes:
    """A word and the blank that closes it, or the end."""
    return token + b" " if token else b"\n"


def grams_of(data: np.ndarray, at: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The bytes at these places and their ORDERS - 1 predecessors, as one number; a blank before the word, zeros before that."""
    out = data[at].astype(np.uint64)
    for k in range(1, ORDERS):
        before = data[at - np.minimum(k, depth)].astype(np.uint64)
        before = np.where(np.asarray(depth) >= k, before, np.where(np.asarray(depth) == k - 1, np.uint64(32), np.uint64(0)))
        out |= before << np.uint64(8 * k)
    return out


def heads_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The heads of all words and ends of these texts, and how many each text has.

    A head: the two bytes before a blank and the two after it, as a number. Zeros stand where a text has no bytes.
    """
    data = np.frombuffer(b"".join([b" ".join([b"\0\0", *words, b"\n\0"]) for words in texts]), np.uint8)
    at = np.flatnonzero(data == 32)
    heads = np.zeros(len(at), np.uint32)
    for k in (-2, -1, 1, 2):
        heads = heads << np.uint32(8) | data[at + k]
    return heads, np.array([len(words) + 1 for words in texts], np.int64)


def contexts_of(grams: np.ndarray) -> list[np.ndarray]:
    """For each order the mixed last bytes before the present one."""
    return [((grams >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)) * _MIX + np.uint64(order + 1) for order in range(ORDERS)]


def start_context(heads: np.ndarray, depth: int) -> np.ndarray:
    """The mixed first ``depth`` bytes, of the first eight as one number."""
    first = heads >> np.uint64(8 * (8 - depth)) if depth else np.zeros_like(heads)
    return first * _MIX + np.uint64(100 + depth)


def slots_of(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of each context and node; nodes are the bits of the present byte so far."""
    mixed = (context + node) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    mixed >>= np.uint64(64 - SLOT_BITS)
    return mixed.view(np.int64)


def node_of(grams: np.ndarray, bit: int) -> np.ndarray:
    """The bits of the last byte above ``bit`` (7 is the first), after a one, mixed."""
    return ((np.uint64(256) | (grams & np.uint64(255))) >> np.uint64(bit + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def bits_of(grams: np.ndarray, bit: int) -> np.ndarray:
    return ((grams >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)


class Words:
    """Distinct words in coded order with their training counts; all that share ``cut`` first bytes are here.

    ``data`` holds the coded words one after the other, ``heads`` the first eight bytes of each as a number, and
    ``shared`` how many first bits each has in common with the word before it, DEPTH bytes at most. From ``begin`` on
    bytes are coded here, and those before it by ``Heads``.
    """

    gate = 0

    def __init__(self, tokens: list[bytes], counts: list[int], cut: int, begin: int = 0):
        text = [coded(t) for t in tokens]
        order = sorted(range(len(text)), key=text.__getitem__)
        text = [text[k] for k in order]
        self.order, self.cut, self.begin = np.array(order, np.int64), cut, begin
        self.n = np.array(counts, float)[self.order]
        self.data = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(x) for x in text], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        flat = np.frombuffer(b"".join([x[:DEPTH].ljust(DEPTH, b"\0") for x in text]), np.uint8).reshape(-1, DEPTH)
        self.heads = np.ascontiguousarray(flat[:, :8]).view(">u8").ravel().astype(np.uint64)
        differ = flat[1:] != flat[:-1]
        at = differ.argmax(1)
        row = np.arange(len(at))
        bits = 8 * at + _LEADING[flat[1:][row, at] ^ flat[:-1][row, at]]
        self.shared = np.concatenate([[0], np.where(differ.any(1), bits, 8 * DEPTH)])

    def places(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(words, grams, bit, zeros, ones) for every coded bit; zeros and ones: the counts of the start of the word.

        starts: the hashed table of the starts of under ``cut`` bytes.
        """
        for d in range(self.begin, min(DEPTH, int(self.size.max(initial=0)))):
            alive = np.flatnonzero(self.size > d)
            grams = grams_of(self.data, self.first[alive] + d, d)
            n, shared = self.n[alive], self.shared[alive]
            context = start_context(self.heads[alive], d) if d < self.cut else None
            for bit in range(7, -1, -1):
                if context is not None:
                    zeros, ones = starts[slots_of(context, node_of(grams, bit))].T.astype(float)
                else:  # words in a row that share all bits before this one
                    new = shared < 8 * d + 7 - bit
                    new[0] = True
                    begins, which = np.flatnonzero(new), np.cumsum(new) - 1
                    ones = np.add.reduceat(n * bits_of(grams, bit), begins)[which]
                    zeros = np.add.reduceat(n, begins)[which] - ones
                yield alive, grams, bit, zeros, ones
        for k in np.flatnonzero(self.size > DEPTH):  # no counts of starts so long
            for low in range(DEPTH, int(self.size[k]), 1 << 16):
                depth = np.arange(low, min(int(self.size[k]), low + (1 << 16)))
                grams = grams_of(self.data, self.first[k] + depth, depth)
                none = np.zeros(len(depth))
                for bit in range(7, -1, -1):
                    yield np.full(len(depth), k), grams, bit, none, none

    def add_counts(self, counts: np.ndarray) -> None:
        """counts[table, 2 * slot + bit] takes the words' occurrences."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        for low in range(0, len(owner), 1 << 20):
            words = owner[low : low + (1 << 20)]
            at = np.arange(low, low + len(words))
            depth, n = at - self.first[words], self.n[words]
            coded_here = depth >= self.begin
            grams = grams_of(self.data, at, depth)
            contexts = contexts_of(grams)
            early = [(d, np.flatnonzero(depth == d)) for d in range(self.cut)]
            starts = [(some, start_context(self.heads[words[some]], d)) for d, some in early if len(some)]
            for bit in range(8):
                came, node = bits_of(grams, bit), node_of(grams, bit)
                for order in range(ORDERS):
                    counts[order] += np.bincount((2 * slots_of(contexts[order], node) + came)[coded_here], n[coded_here], minlength=2 * SLOTS).astype(np.int64)
                for some, context in starts:
                    np.add.at(counts[ORDERS], 2 * slots_of(context, node[some]) + came[some], n[some].astype(np.int64))


class Heads:
    """Distinct heads with their training counts: the first bytes of words after the last ones of the words before."""

    gate = GATES // 2

    def __init__(self, heads: np.ndarray, counts: np.ndarray):
        heads = heads.astype(np.uint64)
        self.order, self.n = np.arange(len(heads)), counts.astype(float)
        self.stream = heads >> np.uint64(16) << np.uint64(24) | np.uint64(32 << 16) | heads & np.uint64(0xFFFF)
        self.heads = heads << np.uint64(48)
        self.size = np.where(heads >> np.uint64(8) & np.uint64(255) == 10, 1, HEAD)  # an end has one byte

    def places(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """As ``Words.places``."""
        for d in range(HEAD):
            alive = np.flatnonzero(self.size > d)
            grams = self.stream[alive] >> np.uint64(8 * (HEAD - 1 - d)) & np.uint64((1 << 8 * ORDERS) - 1)
            context = start_context(self.heads[alive], d)
            for bit in range(7, -1, -1):
                zeros, ones = starts[slots_of(context, node_of(grams, bit))].T.astype(float)
                yield alive, grams, bit, zeros, ones

    def add_counts(self, counts: np.ndarray) -> None:
        """counts[order, 2 * slot + bit] takes the heads' occurrences; the starts of words are counted with the words."""
        for some, grams, bit, _, _ in self.places(np.zeros((SLOTS, 2), np.int8)):
            for order, context in enumerate(contexts_of(grams)):
                counts[order] += np.bincount(2 * slots_of(context, node_of(grams, bit)) + bits_of(grams, bit), self.n[some], minlength=2 * SLOTS).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], cut: int, most: int = CHUNK) -> Iterator[Words]:
    """Rows (token, c) in chunks of about ``most`` words; if sorted, these never part words of the same ``cut`` first bytes."""
    tokens, counts, size = [], [], 0
    for batch in batches:
        for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if tokens and (len(tokens) >= most or size > 1 << 21) and (not cut or token[:cut] != tokens[-1][:cut]):
                yield Words(tokens, counts, cut, HEAD)
                tokens, counts, size = [], [], 0
            tokens.append(token)
            counts.append(c)
            size += len(token)
    if tokens:
        yield Words(tokens, counts, cut, HEAD)


def first_weights() -> np.ndarray:
    return np.tile([0.15] * ORDERS + [0.7], (GATES, 1))


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -9, 9)


class Mixer:
    """Weights by gate and the refining table over frozen context counts (TABLES, 2 * SLOTS)."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None, came: np.ndarray | None = None, learns: bool = False):
        n = counts.reshape(TABLES, SLOTS, 2)
        self.starts = n[ORDERS]
        self.plain = np.stack([stretch(n[k, :, 0].astype(np.float32), n[k, :, 1].astype(np.float32)).astype(np.float32) for k in range(ORDERS)])
        self.total = n[:ORDERS].sum(2, dtype=np.int64)
        self.seen = self.total > int(learns)  # while learning, one occurrence is the bit's own
        del self.total
        if learns:  # logits without one occurrence of the bit that comes, by 2 * slot + bit
            self.without = np.stack([np.stack([stretch(np.maximum(n[k, :, 0].astype(np.float32) - 1, 0), n[k, :, 1].astype(np.float32)), stretch(n[k, :, 0].astype(np.float32), np.maximum(n[k, :, 1].astype(np.float32) - 1, 0))], 1).ravel().astype(np.float32) for k in range(ORDERS)])
        self.weights = first_weights() if weights is None else weights
        self.told = np.zeros(GATES)  # the bits that each gate has learned from
        self.came = np.zeros((GATES, BUCKETS, 2)) if came is None else came  # zeros and ones by gate and predicted logit

    def inputs(self, grams: np.ndarray, bit: int, zeros: np.ndarray, ones: np.ndarray, came: np.ndarray | None, first_gate: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Stretched chances by predictor, the gate and the mix. came: bits to take out once, as they are among the counts."""
        node, logits, level = node_of(grams, bit), [], np.zeros(len(grams), np.int64)
        for order, context in enumerate(contexts_of(grams)):
            slot = slots_of(context, node)
            logits.append(self.plain[order][slot] if came is None else self.without[order][2 * slot + came])
            level[self.seen[order][slot]] = order
        if came is not None:
            zeros, ones = np.maximum(zeros - (came == 0), 0), np.maximum(ones - (came == 1), 0)
        logits.append(stretch(zeros, ones))
        met = zeros + ones
        gate = first_gate + 8 * np.where(met > 0, ORDERS + np.searchsorted(MET, met), level) + bit
        return logits, gate, sum(x * self.weights[:, k][gate] for k, x in enumerate(logits))

    def refined(self, mix: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mean of the mix's chance and of what came at such logits, between the two nearest buckets."""
        p = 1 / (1 + np.exp(-np.clip(mix, -30, 30)))
        x = (np.clip(mix, -8, 8) + 8) * (BUCKETS - 1) / 16
        low = np.minimum(x.astype(np.int64), BUCKETS - 2)
        own = 1 / (1 + np.exp(8 - np.arange(BUCKETS) * 16 / (BUCKETS - 1)))
        table = (self.came[:, :, 1] + 4 * own) / (self.came.sum(2) + 4)
        part = x - low
        return np.clip((p + table[gate, low] * (1 - part) + table[gate, low + 1] * part) / 2, 1e-6, 1 - 1e-6)

    def learn(self, words: Words | Heads) -> None:
        """One online pass over the words with their occurrences."""
        for some, grams, bit, zeros, ones in words.places(self.starts):
            n = words.n[some]
            mixed = np.flatnonzero(n > 0)
            mixed = mixed[np.argsort(grams[mixed] * _MIX, kind="stable")]  # mini-batches of mixed contexts, the same each time
            for k in range(0, len(mixed), MINI):
                at = mixed[k : k + MINI]
                came, weight = bits_of(grams[at], bit), n[at]
                logits, gate, mix = self.inputs(grams[at], bit, zeros[at], ones[at], came, words.gate)
                x = np.rint((np.clip(mix, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)
                self.came += np.bincount((gate * BUCKETS + x) * 2 + came, weight, minlength=self.came.size).reshape(self.came.shape)
                err = weight * (came - 1 / (1 + np.exp(-np.clip(mix, -30, 30))))
                total = np.bincount(gate, weight, minlength=GATES)
                self.told += total
                total = np.maximum(total, 1)
                for order in range(TABLES):
                    self.weights[:, order] += RATE * np.bincount(gate, err * logits[order], minlength=GATES) / total

    def log10(self, words: Words | Heads) -> np.ndarray:
        """log10 of the chance of each word's bytes that are coded here, in the order in which the words were given."""
        total, chance = np.zeros(len(words.size)), np.empty(0)
        for some, grams, bit, zeros, ones in words.places(self.starts):
            _, gate, mix = self.inputs(grams, bit, zeros, ones, None, words.gate)
            p = self.refined(mix, gate)
            p = np.where(bits_of(grams, bit) == 1, p, 1 - p)
            chance = p if bit == 7 else chance * p  # eight factors of a millionth at least
            if bit == 0:
                total += np.bincount(some, np.log10(chance), minlength=len(total))
        out = np.empty(len(total))
        out[words.order] = total
        return out


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of about BATCH bytes of text with the words of each text; a longer text comes alone."""
    for batch in batches:
        first, size, words = 0, 0, []
        for k in range(batch.num_rows):
            text = batch.column(0)[k].as_py()
            if words and size + len(text) > BATCH:
                yield batch.slice(first, k - first), words
                first, size, words = k, 0, []
            words.append(words_of(text))
            size += len(text)
        if words:
            yield batch.slice(first), words


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary), c (occurrences in training texts) and n (in all) over all of docs(text, held_out), the end too."""
    trains = F.when(F.col("held_out"), 0).otherwise(1).cast("long").alias("one")
    words = docs.select(trains, F.explode(F.split(F.translate("text", UPPER, LOWER), r"[\x20\x09-\x0D]+", -1)).alias("token")).where("token <> ''")
    counted = words.groupBy("token").agg(F.sum("one").alias("c"), F.count("*").alias("n"))
    ends = docs.agg(F.coalesce(F.sum(trains), F.lit(0)).alias("c"), F.count("*").alias("n")).where("n > 0").select(F.lit("").alias("token"), "c", "n")
    return counted.union(ends).select(F.col("token").cast("binary").alias("token"), "c", "n")


def head_counts(docs: DataFrame) -> DataFrame:
    """part, heads (sorted), c (occurrences in training texts) and n (in all), as arrays of a part, over all of docs(text, held_out)."""
    schema = "part int, heads binary, c binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch, words in streams(batches):
            heads, sizes = heads_of(words)
            trains = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
            held.append(summed(heads, trains.astype(np.int64), np.ones(len(heads), np.int64)))
            size += len(held[-1][0])
            if size > 1 << 21:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0]) // 2  # at least as many again come before the next time
        if held:
            heads, c, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            part = (heads.astype(np.uint64) * _MIX >> np.uint64(58)).astype(np.int32)
            rows = [(k, part == k) for k in np.unique(part)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *[pa.array([x[at].astype(kind).tobytes() for _, at in rows], pa.binary()) for x, kind in ((heads, "<u4"), (c, "<i8"), (n, "<i8"))]], ["part", "heads", "c", "n"])

    def add(table: pa.Table) -> pa.Table:
        arrays = [np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]]) for name, kind in (("heads", "<u4"), ("c", "<i8"), ("n", "<i8"))]
        return pa.table({"part": table["part"].slice(0, 1), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("heads", "c", "n"), summed(*arrays), strict=True)}})

    return docs.select("text", "held_out").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema)


def heads_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Heads]:
    """The heads of training texts, of rows (heads, c)."""
    for batch in batches:
        for heads, c in zip(batch.column(0), batch.column(1), strict=True):
            heads, c = np.frombuffer(heads.as_py(), "<u4"), np.frombuffer(c.as_py(), "<i8")
            if (c > 0).any():
                yield Heads(heads[c > 0], c[c > 0])


def context_counts(tokens: DataFrame, heads: DataFrame, cut: int) -> np.ndarray:
    """(TABLES, 2 * SLOTS) counts of hashed contexts, added up by Spark; the driver gets the sum, of fixed size."""
    schema = "block int, part int, payload binary"

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for words in chunks(batches, 0, 5 * CHUNK):
            words.cut = cut
            yield words

    def counted(read: Callable[[Iterator[pa.RecordBatch]], Iterator[Words | Heads]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: run(read(batches))

    def run(every: Iterator[Words | Heads]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = None
        for some in every:
            counts = np.zeros((TABLES, 2 * SLOTS), np.int64) if counts is None else counts
            some.add_counts(counts)
        if counts is not None:
            blocks = counts.reshape(-1, BLOCK)
            full = np.flatnonzero(blocks.any(1))
            payload = [zlib.compress(blocks[b].astype("<i8").tobytes(), 1) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([TaskContext.get().partitionId() % 64] * len(full), pa.int32()), pa.array(payload, pa.binary())], ["block", "part", "payload"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table["payload"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return pa.table({"block": table["block"].slice(0, 1), "part": table["part"].slice(0, 1), "payload": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    counts = np.zeros(TABLES * 2 * SLOTS, np.int64)
    found = tokens.where("c > 0").select("token", "c").mapInArrow(counted(words_in), schema).union(heads.select("heads", "c").mapInArrow(counted(heads_in), schema))
    found = found.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    for x in found.select("block", "payload").toLocalIterator():
        counts[x["block"] * BLOCK : (x["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(x["payload"]), "<i8")
    most = int(counts.max(initial=0))
    return np.ceil(counts * ((2**32 - 1) / most)).astype(np.uint32) if most >= 2**32 else counts.astype(np.uint32)  # scaled, not clipped


def cut_of(tokens: DataFrame) -> int:
    """The fewest first bytes, three to eight, by which no group has over GROUP words."""
    for cut in range(3, 8):
        most = tokens.groupBy(F.substring("token", 1, cut).alias("start")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= GROUP:
            return cut
    return 8


def trained(tokens: DataFrame, heads: DataFrame, cut: int) -> tuple[Broadcast, Broadcast]:
    """The model that is trained on tokens(token, c) and heads(heads, c): context counts; weights and the refining table.

    Learners are groups of about LEARNER words, by a hash of their first bytes, and the parts of the heads. Each begins
    anew and goes through its words in order, and what they learn is averaged: so the model is the same however rows are dealt.
    """
    spark = tokens.sparkSession
    model = spark.sparkContext.broadcast(context_counts(tokens, heads, cut))
    schema = "at int, value double"

    def learned_of(mixer: Mixer) -> pa.RecordBatch:
        values = np.concatenate([(mixer.weights * mixer.told[:, None]).ravel(), mixer.came.ravel(), mixer.told])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in groupby(runs_of(batches), key=lambda x: x[0]):
            mixer = Mixer(model.value, learns=True)
            for words in chunks((batch for _, batch in some), cut):
                mixer.learn(words)
            yield learned_of(mixer)

    def learn_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in heads_in(batches):  # a part of the heads each
            mixer = Mixer(model.value, learns=True)
            for _ in range(PASSES):  # heads are few beside words
                mixer.learn(some)
            yield learned_of(mixer)

    edge, end = GATES * TABLES, GATES * (TABLES + 2 * BUCKETS)
    learned = np.zeros(end + GATES)
    learners = max(1, tokens.count() // LEARNER)
    start = F.substring("token", 1, cut)
    words = tokens.select(F.pmod(F.xxhash64(start), F.lit(learners)).alias("learner"), "token", "c").repartition("learner").sortWithinPartitions("learner", "token")
    told = words.mapInArrow(learn, schema).union(heads.select("heads", "c").mapInArrow(learn_heads, schema))
    # Decimals add up to the same in any order.
    for x in told.groupBy("at").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("value")).collect():
        learned[x["at"]] = x["value"]
    seen = learned[end:, None]
    weights = np.where(seen > 0, learned[:edge].reshape(GATES, TABLES) / np.maximum(seen, 1), first_weights())
    return model, spark.sparkContext.broadcast((weights, learned[edge:end].reshape(GATES, BUCKETS, 2)))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The learners of sorted rows (learner, token, c), each with its rows of a batch."""
    for batch in batches:
        learner = batch.column(0).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], learner[1:] != learner[:-1]])[: len(learner)])
        for low, high in zip(new, [*new[1:], len(learner)], strict=True):
            yield int(learner[low]), batch.slice(low, high - low).select([1, 2])


def dealt(tokens: DataFrame, cut: int) -> DataFrame:
    return tokens.repartition(F.substring("token", 1, cut)).sortWithinPartitions("token")


def word_scores(tokens: DataFrame, cut: int, model: Broadcast, frozen: Broadcast) -> DataFrame:
    """token, c, n and lm, the log10 chance of the word's bytes after its head."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = None
        seen: list[pa.RecordBatch] = []

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen.append(batch)
                yield batch

        done, at = 0, 0  # rows of seen[0] that are given back
        for words in chunks(kept(), cut):
            mixer = mixer or Mixer(model.value, *frozen.value)
            lm = mixer.log10(words)
            while at < len(lm):
                some = seen[0].slice(done, len(lm) - at)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lm[at : at + some.num_rows])], ["token", "c", "n", "lm"])
                at, done = at + some.num_rows, done + some.num_rows
                if done == seen[0].num_rows:
                    seen.pop(0)
                    done = 0
            at = 0

    return dealt(tokens, cut).select("token", "c", "n").mapInArrow(judge, "token binary, c long, n long, lm double")


def head_scores(heads: DataFrame, model: Broadcast, frozen: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The heads that occur most often, HEADS at most, ascending, and their log10 chances."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heads, n in zip(batch.column(0), batch.column(1), strict=True):
                heads, n = np.frombuffer(heads.as_py(), "<u4"), np.frombuffer(n.as_py(), "<i8")
                at = np.argsort(-n, kind="stable")[: HEADS // PARTS]  # heads are dealt evenly to the parts
                yield pa.RecordBatch.from_arrays([pa.array([heads[at].tobytes()], pa.binary())], ["heads"])

    kept = [np.frombuffer(x["heads"], "<u4") for x in heads.select("heads", "n").mapInArrow(most, "heads binary").collect()]  # HEADS numbers
    every = np.sort(np.concatenate([*kept, np.empty(0, "<u4")])).astype(np.uint32)
    mixer = Mixer(model.value, *frozen.value)
    return every, np.concatenate([mixer.log10(Heads(x, np.zeros(len(x)))) for x in np.array_split(every, len(every) // GROUP + 1)])


def score(documents: DataFrame) -> DataFrame:
    """A row for each row of documents(doc_id, text).

    doc_id, held_out (crc32 of the id as text leaves 1 modulo 5: such texts aren't learned from), n_tokens, n_known,
    train_tokens, base_score and score (log10 chances of the tokens and of the stream), bits_per_byte.

    Null and empty texts are the end alone. A null id is never held out. Repeated rows stay repeated and all count in
    training. Without training texts each token's chance is that of an unseen one. Further columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lm")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = text_of(documents).select("text", "doc_id", F.monotonically_increasing_id().alias("uid"), out.alias("held_out"))
    counted = scratch.write("counted", token_counts(docs))
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    unit = float(np.log10(max(total + 0.5 * (distinct + 1), 1e-300)))
    base_of = F.log10(F.col("c") + 0.5) - F.lit(unit)
    heads, cut = scratch.write("heads", head_counts(docs)), cut_of(counted)
    model, frozen = trained(counted, heads, cut)
    tokens = scratch.write("tokens", word_scores(counted, cut, model, frozen).select("token", "n", (F.col("c") > 0).alias("known"), base_of.alias("base"), "lm"))
    often = spark.sparkContext.broadcast(head_scores(heads, model, frozen))
    scratch.drop("counted", "heads")

    size, least, n = F.floor(F.log2("n") * 4), None, 0
    for at, some in sorted((tuple(x) for x in tokens.groupBy(size.alias("size")).count().collect()), reverse=True):
        n += some
        if n > HEAVY:
            break
        least = at
    heavy = tokens.where(size >= least).collect() if least is not None else []  # HEAVY rows at most
    known = spark.sparkContext.broadcast({bytes(x["token"]): (x["base"], x["lm"], int(x["known"])) for x in heavy})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, (heads, chances), mixer = known.value, often.value, None
        for batch, words in streams(batches):
            met_heads, sizes = heads_of(words)
            chance, new = np.zeros(len(met_heads)), np.ones(len(met_heads), bool)
            if len(heads):
                at = np.minimum(np.searchsorted(heads, met_heads), len(heads) - 1)
                chance, new = chances[at], heads[at] != met_heads
            if new.any():
                mixer = mixer or Mixer(model.value, *frozen.value)
                some, which = np.unique(met_heads[new], return_inverse=True)
                chance[new] = mixer.log10(Heads(some, np.zeros(len(some))))[which]
            of_heads = np.add.reduceat(chance, np.cumsum(sizes) - sizes).tolist()
            base, lm, met, rare, times, ends = [], [], [], [], [], [0]
            for w, of_head in zip(words, of_heads, strict=True):
                sums, n_known = [0.0, of_head], 0
                for token, n in Counter([*w, END]).items():
                    if (x := looked.get(token)) is None:
                        rare.append(token)
                        times.append(n)
                    else:
                        sums[0] += n * x[0]
                        sums[1] += n * x[1]
                        n_known += n * x[2]
                base.append(sums[0])
                lm.append(sums[1])
                met.append(n_known)
                ends.append(len(rare))
            ends = pa.array(ends, pa.int32())
            others = [pa.ListArray.from_arrays(ends, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            sizes = [sum(map(len, w)) + len(w) + 1 for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(met, pa.int64()), pa.array(base, pa.float64()), pa.array(lm, pa.float64()), pa.array(sizes, pa.int64()), *others], ["uid", "doc_id", "held_out", "n_tokens", "met", "base", "lm", "bytes", "rare", "times"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, met long, base double, lm double, bytes long, rare array<binary>, times array<bigint>"
    scored = scratch.write("scored", docs.select("text", "uid", "doc_id", "held_out").mapInArrow(judge, schema))
    loose = scored.select("uid", F.explode(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("n"))).alias("r")).select("uid", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    rest = loose.join(tokens.drop("n"), "token").groupBy("uid").agg(F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("also"), F.sum(F.col("times") * F.col("base")).alias("more_base"), F.sum(F.col("times") * F.col("lm")).alias("more_lm"))
    joined = scored.drop("rare", "times").join(rest, "uid", "left").withColumn("score", F.col("lm") + F.coalesce("more_lm", F.lit(0.0)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, repeated rows and empty tables as in ``score``."""
    return score(table(spark, sf_dir, "documents"))


by_value(__name__)
