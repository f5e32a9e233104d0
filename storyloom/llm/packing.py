"""Packing of documents into sequences of one length: first-fit decreasing with a tournament tree, group by group.

Each document's ids and the end id are cut into pieces of a whole sequence and a rest. Whole ones are sequences as they
are and move nowhere. Rests go to random groups of about GROUP tokens, so that a group fits in a task whatever the input
is, and are packed there by first-fit decreasing: a tournament tree over the free places of the bins gives the first bin
that takes a piece in O(log bins). What first-fit leaves open is closed by cutting: the emptiest bins' pieces fill the
gaps of ``least_cut`` places and more, and the last bin is cut into sequences of powers of two, which need no padding.

Null texts are empty: the end id alone. Null ids and repeated rows are packed like others, each row by itself. Other
columns are not looked at. An empty table gives no sequences.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, table, text_of

LENGTH, GROUP, SLICE = 2048, 1 << 22, 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Fixed value: the pre-tokenizer's pattern in the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens that need no look at Unicode's tables: Latin letters that are composed and stay single when lower-cased, a
#: digit, ASCII marks but the apostrophe.
LATIN = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c3\u01cd-\u01ef\u01f4-\u0220\u0222-\u0233]+"
LETTERS = re.compile(LATIN).fullmatch
PARTS = re.compile(LATIN + r"|[0-9]|[!-&(-/:-@\[-`{-~]+").findall
PIECES = "doc_id long, start long, length int, doc_tokens long, uid long, ids binary"
PLACED = "array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"
SEQUENCES = f"sequence_id long, n_tokens int, size int, ids binary, pieces {PLACED}"


class Words(dict):
    """Ids by word: what is not held comes from the words held before, or is told anew."""

    def __init__(self, tell, before: dict):
        self.tell, self.before = tell, before

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        self[word] = ids = self.tell(word) if ids is None else ids
        return ids


class WordEncoder:
    """Ids of texts by the tokenizers library; a word between blanks is encoded once and its ids are kept.

    That holds for tokenizers that drop white space and whose normalizers work on single characters (or on a letter and
    its marks); texts of others are encoded whole. Beyond ``most`` words a new generation begins, and what it does not
    ask for goes: time changes, not ids. Words of Latin letters, digits and ASCII marks are cut as the pre-tokenizer
    cuts them and go to the library's model at once; all others go through its whole chain.
    """

    def __init__(self, blob: str, most: int = 250_000):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        self.model, self.most, self.tried = Tokenizer.from_str(blob), most, False
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.kind, self.model_of = "H" if self.dtype.itemsize == 2 else "I", self.model.model.tokenize
        norms = (spec.get("normalizer") or {}).get("normalizers") or ([spec["normalizer"]] if spec.get("normalizer") else [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in norms)
        cut = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not any(x.get("add_prefix_space") for x in pre)
        added = spec.get("added_tokens", [])
        sole = not any(x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in added)
        self.by_word = bool(sys.byteorder == "little" and plain and cut and sole and not spec.get("post_processor"))
        self.by_part = {"type": "Lowercase"} in norms and pre[0].get("pattern") == {"Regex": SPLIT} and [x["type"] for x in pre[1:]] == ["ByteLevel"] and all(x["content"].startswith("<|") for x in added)
        # The byte-level alphabet: printable Latin-1 stands for itself, each other byte for the next character from 256 on.
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = dict(zip([b for b in range(256) if b not in same], range(256, 512), strict=False))
        self.kept, self.parts = Words(self.word, {}), Words(self.part, {})

    def part(self, x: str) -> bytes:
        """The ids of one pre-token."""
        x = x.lower()
        return array(self.kind, [t.id for t in self.model_of(x if x.isascii() else x.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def word(self, raw: bytes) -> bytes:
        x = raw.decode("utf-8", "replace")
        if self.by_part:
            if LETTERS(x):
                return self.part(x)
            parts = PARTS(x)
            if "".join(parts) == x and "<|" not in x:
                return b"".join(map(self.parts.__getitem__, parts))
        return self.whole([raw])[0]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [array(self.kind, x.ids).tobytes() for x in self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.by_word and not self.tried:  # what the tokenizer does must be what the words assume
            self.tried, some = True, [t[:20_000] for t in texts[:64]]
            self.by_word = self.encode(some) == self.whole(some)
        if not self.by_word:
            return self.whole(texts)
        for name in ("kept", "parts"):
            if len(held := getattr(self, name)) > self.most:
                held.before = {}
                setattr(self, name, Words(held.tell, held))
        return [b"".join(map(self.kept.__getitem__, t.split())) for t in texts]

    def long_text(self, text: bytes) -> bytes:
        """Slice by slice, each of which ends at a blank."""
        if not self.by_word:
            return self.whole([text])[0]
        out, low = [], 0
        while low < len(text):
            end = BLANK.search(text, low + SLICE)
            high = end.end() if end else len(text)
            out += self.encode([text[low:high]])
            low = high
        return b"".join(out)


def encoder(blob: str) -> WordEncoder:
    """One for each Python worker, which serves task after task."""
    held = sys.__dict__.setdefault("_storyloom_word_encoders", {})
    if (key := hash(blob)) not in held:
        held[key] = WordEncoder(blob)
    return held[key]


def encoded_pieces(documents: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Rows of PIECES: each document's ids with the end id, cut at multiples of ``length``. uid numbers them by task and place."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        model, uid, held, size = encoder(vocabulary.value), TaskContext.get().partitionId() << 33, [], 0
        end, step = np.array([end_id], model.dtype).tobytes(), length * model.dtype.itemsize

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "length", "doc_tokens", "uid", "ids"])

        def grouped(doc_ids: list, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
            ids, some, n = [], [], 0
            for i, t in zip(doc_ids, texts, strict=True):
                raw = t.as_py()
                if len(raw) > SLICE:
                    yield [i], [model.long_text(raw)]
                    continue
                ids.append(i)
                some.append(raw)
                n += len(raw)
                if n > SLICE:
                    yield ids, model.encode(some)
                    ids, some, n = [], [], 0
            if ids:
                yield ids, model.encode(some)

        gc.disable()  # words come as millions of small objects, none of them in a cycle
        try:
            for batch in batches:
                for ids, encoded in grouped(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    for doc_id, x in zip(ids, encoded, strict=True):
                        x += end
                        total = len(x) // model.dtype.itemsize
                        for low in range(0, len(x), step):
                            part = x[low : low + step]
                            held.append((doc_id, low // model.dtype.itemsize, len(part) // model.dtype.itemsize, total, uid, part))
                            uid += 1
                            size += len(part)
                            if size > SLICE:
                                yield out()
                                held, size = [], 0
            if held:
                yield out()
        finally:
            gc.enable()

    return text_of(documents).mapInArrow(run, PIECES)


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given: the first with room for it, told by a tournament tree of free places."""
    most = min(len(lengths), 2 * -(-sum(lengths) // capacity) + 1)  # first fit leaves at most one bin half empty
    size = 1 << max(most - 1, 0).bit_length()
    tree = [capacity] * (2 * size)  # node k: the most free places below it; leaves are bins, all open from the start
    out = []
    for n in lengths:
        k = 1
        while k < size:
            k *= 2
            if tree[k] < n:
                k += 1
        out.append(k - size)
        tree[k] -= n
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    return out


def pack_lengths(lengths: list[int], capacity: int = LENGTH, least_cut: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start within it, length): first-fit decreasing, gaps filled by cutting, the last bin in powers of two."""
    bins: dict[int, list[tuple[int, int, int]]] = {}
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    for k, b in zip(order, first_fit([lengths[k] for k in order], capacity), strict=True):
        bins.setdefault(b, []).append((k, 0, lengths[k]))
    used = {b: sum(p[2] for p in some) for b, some in bins.items()}
    gaps = sorted((b for b in bins if used[b] < capacity), key=lambda b: (used[b], b))  # the emptiest first: they give
    done, last = [bins[b] for b in bins if used[b] == capacity], []
    low, high = 0, len(gaps) - 1
    giving: list[tuple[int, int, int]] = []
    while low <= high or giving:
        if not giving:
            giving = bins[gaps[low]][::-1]
            low += 1
        if low > high:
            last = giving[::-1]
            break
        takes = bins[gaps[high]]
        room = capacity - sum(p[2] for p in takes)
        if room >= least_cut:
            while room and giving:
                k, start, n = giving.pop()
                takes.append((k, start, min(n, room)))
                if n > room:
                    giving.append((k, start + room, n - room))
                room -= min(n, room)
            if room >= least_cut:
                continue  # the giver is empty; the next one fills the rest
        done.append(takes)
        high -= 1
    while last:
        want, some = 1 << (sum(p[2] for p in last).bit_length() - 1), []
        while want:
            k, start, n = last.pop(0)
            some.append((k, start, min(n, want)))
            if n > want:
                last.insert(0, (k, start + want, n - want))
            want -= min(n, want)
        done.append(some)
    return done


def padded_size(n: int, capacity: int) -> int:
    return n if n & (n - 1) == 0 else capacity


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, pad_id: int = 0, group: int = GROUP, least_cut: int = 32) -> DataFrame:
    """documents(doc_id, text) in sequences: rows of SEQUENCES.

    ids: n_tokens ids and padding up to ``size``, which is ``length``, or n_tokens where that is a power of two; unsigned,
    little-endian, of 2 bytes if the vocabulary allows it, else 4. pieces: what lies where, gapless from offset 0.
    Pieces are written once, so that groups and sequence ids stay the same if tasks run again.
    """
    spark = documents.sparkSession
    pieces = Scratch(spark, "packing").write("pieces", encoded_pieces(documents, tokenizer, end_id, length))
    whole, rest = F.col("length") == length, F.col("length") < length
    total = pieces.where(rest).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group))

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("uid")
        doc_ids, starts, lengths, totals = (found[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens"))
        ids = found["ids"].to_pylist()
        width, rows = len(ids[0]) // lengths[0], []
        pad, base = pad_id.to_bytes(width, "little"), found["g"][0].as_py() << 32
        for n, some in enumerate(pack_lengths(lengths, length, least_cut)):
            at, placed, raw = 0, [], []
            for k, start, m in some:
                raw.append(ids[k][start * width : (start + m) * width])
                placed.append({"doc_id": doc_ids[k], "start": starts[k] + start, "length": m, "offset": at, "doc_tokens": totals[k]})
                at += m
            size = padded_size(at, length)
            rows.append((2 * (base + n) + 1, at, size, b"".join(raw) + pad * (size - at), placed))
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "offset", "doc_tokens")]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), kind), strict=True)], ["sequence_id", "n_tokens", "size", "ids", "pieces"])

    placed = F.array(F.struct("doc_id", "start", F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("offset"), "doc_tokens")).cast(PLACED)
    alone = pieces.where(whole).select((F.col("uid") * 2).alias("sequence_id"), F.col("length").alias("n_tokens"), F.col("length").alias("size"), "ids", placed.alias("pieces"))
    shared = pieces.where(rest).withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("g").applyInArrow(run, SEQUENCES)
    return alone.unionByName(shared)


def placed_pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece, read from the sequences' ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence_id, size, ids, pieces in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "size", "ids", "pieces")), strict=True):
                x = np.frombuffer(ids, f"<u{len(ids) // size}").astype("<u4")
                for p in pieces:
                    crc = zlib.crc32(x[p["offset"] : p["offset"] + p["length"]].tobytes())
                    rows.append((p["doc_id"], p["start"], p["length"], crc, p["doc_tokens"], sequence_id, p["offset"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 2048, a row for each piece; nulls, ties and empty tables as in ``pack``."""
    import public_tokenizers

    return placed_pieces(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


by_value(__name__)
