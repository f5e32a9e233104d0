"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read by memory map.

A data set is a folder of shards and a manifest. Shard k holds ``shard-k.bin`` (ids, 2 bytes each if the vocabulary
allows it, else 4, little-endian) and ``shard-k.idx`` (magic, width, number of documents, then int64 document ids, a
null flag byte for each id, and int64 offsets into the ids, one more than documents). ``manifest.json`` lists each
shard's documents and ids with the prefix sums that make offsets global. Shards follow each other in ascending doc_id.

Files go through a file system named by the folder's URI (local, or any that pyarrow opens), under a name of the
attempt that is then moved into place, so that a repeated or speculative task leaves whole files only.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, shared_folder, table, text_of

MAGIC, SHARD = b"SLTOKID1", 256 << 20
#: A piece that can stand alone: no blank at its ends but one leading space. One that ends in a letter and a stop.
SOUND = re.compile(r" ?(?!\s).*\S", re.S).fullmatch
#: One pre-token: letters (of blocks that all Unicode versions agree on) after at most one space.
LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: What a piece is cut into further: such letters, other signs, a line end between two that are no blanks.
PARTS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[^\w\s']+|\n(?!\n)").findall


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def file_uri(uri: str) -> str:
    """A URI as Hadoop writes it (``file:/x``, ``s3a://x``), in the form that pyarrow reads."""
    if uri.startswith(("s3a://", "s3n://")):
        return "s3" + uri[3:]
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class ShardWriter:
    """Appends documents to one shard; ``close`` moves its files into place."""

    def __init__(self, folder: str, shard: int, dtype: str):
        self.fs, self.path = open_folder(folder)
        self.shard, self.dtype, self.name = shard, np.dtype(dtype), f"shard-{shard:06d}"
        self.part = f"{self.path}/.{self.name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part + ".bin")
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_ids: list[int | None], encoded: list[bytes]) -> None:
        self.out.write(b"".join(encoded))
        self.ids += doc_ids
        self.lengths += [len(x) // self.dtype.itemsize for x in encoded]

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        offsets = np.concatenate([[0], np.cumsum(np.asarray(self.lengths, np.int64))]).astype("<i8")
        with self.fs.open_output_stream(self.part + ".idx") as f:
            f.write(MAGIC + np.array([self.dtype.itemsize, len(self.ids)], "<i8").tobytes())
            f.write(np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes() + offsets.tobytes())
        for end in (".bin", ".idx"):
            self.fs.move(self.part + end, f"{self.path}/{self.name}{end}")
        return self.shard, len(self.ids), int(offsets[-1])


class Shard:
    """A shard read in place: memory-mapped if it is a local file, else by ranges."""

    def __init__(self, folder: str, shard: int):
        fs, path = open_folder(folder)
        opened = lambda end: pa.memory_map(f"{path}/shard-{shard:06d}{end}") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{path}/shard-{shard:06d}{end}")
        with opened(".idx") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{path}: not a token shard")
            width, n = np.frombuffer(f.read(16), "<i8")
            ids, null = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), "u1")
            self.offsets = np.frombuffer(f.read(8 * (n + 1)), "<i8")
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.dtype = np.dtype(f"<u{width}")
        self.data = opened(".bin") if self.offsets[-1] else None

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, at: int) -> np.ndarray:
        a, b = int(self.offsets[at]), int(self.offsets[at + 1])
        if a == b:
            return np.empty(0, self.dtype)
        return np.frombuffer(self.data.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


class PieceEncoder:
    """Encodes texts piece by piece with the tokenizers library, and keeps the ids of the pieces that it has met.

    A byte-level pre-tokenizer never joins characters across a space between two others that are no blanks: the space
    starts a new pre-token. Texts are cut there, and the pieces where letters meet other signs or a single line end;
    the ids of a text are those of its pieces. A text with other blanks at a cut, and all texts of other tokenizers,
    are encoded whole. When ``kept`` holds over ``most`` pieces, those met once only go: that changes time only.
    """

    def __init__(self, blob: str, dtype: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.model, self.dtype, self.most = Tokenizer.from_str(blob), dtype, most
        spec = json.loads(blob)
        pre = spec.get("pre_tokenizer") or {}
        self.kind, self.model_of = "H" if dtype == "<u2" else "I", self.model.model.tokenize
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.by_piece = sys.byteorder == "little" and not any(LETTERS(x) for x in self.added) and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec.get("added_tokens", []))
        self.tried = False
        kind = spec.get("model") or {}
        self.by_piece = self.by_piece and kind.get("type") == "BPE" and not kind.get("dropout") and not kind.get("continuing_subword_prefix") and not kind.get("end_of_word_suffix") and not kind.get("ignore_merges")
        self.kept: dict[str, bytes] = {}  # without the leading space
        self.hot: set[str] = set()  # met twice or more
        # The byte-level alphabet: printable Latin-1 stands for itself, each other byte for the next character from 256 on.
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = dict(zip([b for b in range(256) if b not in same], range(256, 512), strict=False))

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: set[str], kept: dict[str, bytes], lead: str) -> None:
        """Fills ``kept`` with the ids of lead + x; what can't stand alone gets no entry."""
        rest, made, known = set(), [], {}
        for x in missing:
            y = lead + x
            if LETTERS(y):
                kept[x] = self.word(y)
            elif not y or any(z in y for z in self.added):
                if not y or SOUND(y):
                    made.append((x, (y,)))
                    rest.add(y)
            elif "".join(parts := PARTS(y)) == y:
                made.append((x, parts))
                for z in parts:
                    if z not in known:
                        if z[0] == " " and (ids := self.kept.get(z[1:])) is not None:
                            known[z] = ids
                        elif LETTERS(z):
                            known[z] = self.word(z)
                            if z[0] == " ":
                                self.kept[z[1:]] = known[z]
                        else:
                            rest.add(z)
            elif SOUND(y):
                made.append((x, (y,)))
                rest.add(y)
        listed = list(rest)
        known.update(zip(listed, self.encode_whole(listed), strict=True))
        for x, parts in made:
            kept[x] = known[parts[0]] if len(parts) == 1 else b"".join([known[y] for y in parts])

    def word(self, y: str) -> bytes:
        """The ids of a single pre-token, which goes to the model at once."""
        if y.isascii():
            y = "\u0120" + y[1:] if y[0] == " " else y
        else:
            y = y.encode().decode("latin-1").translate(self.bytes)
        return array(self.kind, [t.id for t in self.model_of(y)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.by_piece and not self.tried:  # what the tokenizer does must be what the pieces assume
            self.tried, some = True, texts[:64]
            self.by_piece = self.encode(some) == self.encode_whole(some)
        if not self.by_piece:
            return self.encode_whole(texts)
        pieces = [x.split(" ") for x in texts]
        heads = [x.pop(0) for x in pieces]
        firsts: dict[str, bytes] = {}
        self.learn(set(heads), firsts, "")
        met = set().union(*pieces)
        missing = met - self.kept.keys()
        again = met - missing
        self.hot |= again
        if len(self.kept) > self.most:
            if len(self.hot) > self.most // 2:
                self.hot = again
            self.kept = {x: self.kept[x] for x in self.hot}
        if missing:
            self.learn(missing, self.kept, " ")
        out: list[bytes | None] = []
        for head, some in zip(heads, pieces, strict=True):
            try:
                out.append(firsts[head] + b"".join(map(self.kept.__getitem__, some)))
            except KeyError:
                out.append(None)
        whole = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(whole, self.encode_whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


def encoder(blob: str, dtype: str) -> PieceEncoder:
    """One for each Python worker, which serves task after task."""
    held = sys.__dict__.setdefault("_storyloom_encoders", {})
    key = hash(blob), dtype
    if key not in held:
        held[key] = PieceEncoder(blob, dtype)
    return held[key]


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of df's input; 0 if it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encodes documents(doc_id, text) into shards under ``folder``; returns and writes the manifest's rows.

    Rows: shard, documents, ids, first_document, first_id. Null and empty texts are the end id alone. Null ids come
    first; equal ids stand in the order of their texts' hashes; repeated rows stay repeated. An empty table has no shards.
    Texts are spread by ranges of doc_id over ``partitions`` tasks (default: spark.sql.shuffle.partitions, and more if
    these would get over SHARD bytes each).
    """
    spark = documents.sparkSession
    folder = file_uri(folder)
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with open(tokenizer, encoding="utf-8") as f:
        blob = f.read()  # a vocabulary file of a few MB; executors need no copy of their own
    vocabulary = spark.sparkContext.broadcast(blob)
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(blob).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        gc.disable()  # ids come as millions of small lists, none of them in a cycle; on again at the task's end
        writer = model = None
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            model = model or encoder(vocabulary.value, dtype)
            writer = writer or ShardWriter(folder, TaskContext.get().partitionId(), dtype)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            first = 0
            while first < len(doc_ids):
                last, size, some = first, 0, []
                while last < len(doc_ids) and size < 1 << 22:
                    some.append(texts[last].as_py())
                    size += len(some[-1])
                    last += 1
                writer.add(doc_ids[first:last], [x + end for x in model.encode(some)])
                first = last
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in done], ["shard", "documents", "ids"])
        gc.enable()

    rows = text_of(documents)
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(documents) // SHARD))
    # Ranges are told from a sample of these two numbers; texts never reach the driver.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    scratch = Scratch(spark, "tokens")
    shards = scratch.write("shards", ranged.mapInArrow(run, "shard long, documents long, ids long"))
    listed = sorted(tuple(x) for x in shards.collect())  # one row for each task
    scratch.drop("shards")
    out, doc, at = [], 0, 0
    for shard, n, ids in listed:
        out.append((shard, n, ids, doc, at))
        doc, at = doc + n, at + ids
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "shards": [dict(zip(("shard", "documents", "ids", "first_document", "first_id"), x, strict=True)) for x in out]}).encode())
    return manifest(spark, out)


def manifest(spark: SparkSession, rows: list[tuple[int, ...]]) -> DataFrame:
    return spark.createDataFrame(rows, "shard long, documents long, ids long, first_document long, first_id long")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fs, path = open_folder(file_uri(folder))
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        listed = json.loads(f.read())["shards"]
    return manifest(spark, [tuple(x[k] for k in ("shard", "documents", "ids", "first_document", "first_id")) for x in listed])


def digest_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files; a task for each shard."""
    folder = file_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.offsets[:-1] + row["first_id"], pa.int64()), pa.array(np.diff(shard.offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return shards.repartition(min(n, 10_000), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_dataset(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of documents into the shared folder and returns the digest of what the files hold."""
    spark = documents.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    return digest_tokens(write_tokens(documents, folder, tokenizer), folder)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; nulls, repeated rows and empty tables as in ``write_tokens``."""
    return token_dataset(table(spark, sf_dir, "documents"))


by_value(__name__)
