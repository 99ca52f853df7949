"""Token-id files: ids in the fewest bits the vocabulary needs, readable at any block.

A file holds, little-endian throughout: MAGIC, version, bits, ids to a block, number of ids, of documents, of blocks;
the blocks' byte offsets (8 bytes each, from the payload's start, one more for its end); the documents' first ids (8
bytes each, one more for the end); the documents' own ids (8 bytes each) and a bit each whether that id is null; the
payload. Ids are packed low bit first, and each block begins at a byte, so any block unpacks by itself in numpy.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_replay import encoder_slices
from .common import parts, read_file, shared_dir, text_or_empty, write_file, written
from .tokens import library_encoder, vocabulary_size

MAGIC, VERSION, BLOCK = b"LFTOKENS", 1, 4096
_HEAD = struct.Struct("<8sIIQQQQ")
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Ids after which a file is closed; a document is never split over files.
FILE_IDS = 2_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in so many bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):
        part = ids[i : i + (1 << 16)].astype("<u4")
        out.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    out, step = np.empty(n, "<u4"), 1 << 16
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, n, step):
        m = min(step, n - i)
        b = np.unpackbits(raw[i * bits // 8 : ((i + m) * bits + 7) // 8], bitorder="little")[: m * bits].reshape(m, bits)
        full = np.zeros((m, 32), np.uint8)
        full[:, :bits] = b
        out[i : i + m] = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
    return out


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> list[bytes]:
    """The parts of a file that holds these documents."""
    if block % 8:
        raise ValueError("a block must hold a multiple of 8 ids")
    flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError("an id doesn't fit the vocabulary's bits")
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype="<i8")]).astype("<i8")
    blocks = -(-len(flat) // block)
    payload = pack(flat, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<i8") * (block * bits // 8), len(payload)).astype("<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes()
    own = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return [_HEAD.pack(MAGIC, VERSION, bits, block, len(flat), len(ids), blocks), offsets.tobytes(), first.tobytes(), own, null, payload]


class TokenFile:
    """A file's documents, or any range of its ids, from its bytes."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, self.n_ids, self.n_docs, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.first = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        doc_ids = np.frombuffer(data, "<i8", self.n_docs, at).tolist()
        at += 8 * self.n_docs
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-self.n_docs // 8), at), bitorder="little")[: self.n_docs]
        self.doc_ids = [None if z else d for d, z in zip(doc_ids, nulls, strict=True)]
        self.payload = memoryview(data)[at + -(-self.n_docs // 8) :]
        if len(self.payload) != int(self.offsets[-1]):
            raise ValueError("the token file is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block, -(-stop // self.block)
        n = min(b * self.block, self.n_ids) - a * self.block
        return unpack(self.payload[int(self.offsets[a]) : int(self.offsets[b])], n, self.bits)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes documents and writes their ids in ascending doc_id order; returns one row a file.

    Columns: uri, part, file, n_docs, n_ids, base (ids in all files before it). Null text counts as empty: it has only
    the end id. Null doc_ids come first; rows with the same doc_id follow each other in the order of their texts.
    Partitions are ranges of (doc_id, hash of the text), so a doc_id on many rows is dealt over several. Each task
    streams: it holds one file's ids. Only one total for each partition goes to the driver.
    """
    spark = docs.sparkSession
    bits = bits_for(max(vocabulary_size(vocabulary), end_id + 1))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder = library_encoder(vocabulary, "byte_level")
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        docs_, ids, n, k = [], [], 0, 0

        def close():
            nonlocal docs_, ids, n, k
            uri = f"{folder}/part-{part:06d}-{k:05d}.tok"
            write_file(uri, file_bytes(docs_, ids, bits), attempt)
            row = pa.RecordBatch.from_pylist([{"uri": uri, "part": part, "file": k, "n_docs": len(docs_), "n_ids": n}], schema=schema)
            docs_, ids, n, k = [], [], 0, k + 1
            return row

        schema = pa.schema([("uri", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for b in batches:
            at = 0
            for texts in encoder_slices(b.column(1)):
                for d, raw in zip(b.column(0).slice(at, len(texts)).to_pylist(), encoder.many(texts), strict=True):
                    x = np.frombuffer(raw + end, "<u4")
                    docs_.append(d)
                    ids.append(x)
                    n += len(x)
                    if n >= file_ids:
                        yield close()
                at += len(texts)
        if docs_:
            yield close()

    order = ["doc_id", "h", "text"]
    ranged = docs.select("doc_id", text_or_empty()).withColumn("h", F.xxhash64("text")).repartitionByRange(parts(spark, 0, 1), "doc_id", "h").sortWithinPartitions(*order)
    files = written(ranged.select("doc_id", "text").mapInArrow(run, "uri string, part int, file int, n_docs long, n_ids long"), folder + "-index", "files")
    base, bases = 0, []
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each partition
        bases.append((r["part"], base))
        base += r["n"]
    before = spark.createDataFrame(bases, "part int, part_base long")
    w = "sum(n_ids) over (partition by part order by file rows between unbounded preceding and 1 preceding)"
    return files.join(F.broadcast(before), "part").withColumn("base", F.col("part_base") + F.coalesce(F.expr(w), F.lit(0))).drop("part_base")


def read(files: DataFrame) -> DataFrame:
    """The documents of token files (uri, base): doc_id, start, n_tokens, ids_crc32; one file at a time in a task."""

    def run(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(read_file(uri))
                ids = f.ids(0, f.n_ids)
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.first[:-1] + base, pa.int64()), pa.array(np.diff(f.first), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    return files.select("uri", "base").repartition(parts(spark, 0, 1), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, shared_dir(spark), public_tokenizers.path(VOCABULARY)))
