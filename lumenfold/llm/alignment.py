"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents link two ids.

The texts of a batch are laid end to end. numpy's cumsum gives the byte at which each token ends, intersect1d the cuts
common to both tokenizers, searchsorted the group of each token, and a repeat-based expansion all pairs of tokens whose
bytes overlap; no loop runs over tokens.

An id pair counts once for each document that holds it. Each task counts the distinct pairs of a chunk of documents
(CHUNK_BYTES of text) by itself; a two-stage sum, salted by chunk, adds the chunks' counts up. Every chunk then gets the
counts of its own pairs back by a join on the pair, and its documents are scored beside them: no table of all pairs
is held anywhere. The largest count of each A id is broadcast, which the vocabulary bounds.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, text_or_empty, written
from .tokens import library, library_encoder

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text to a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Characters that are aligned at a time (a longer text at once).
SLICE_CHARS = 250_000
#: Parts of texts whose B ids a worker keeps.
MOST_PARTS = 300_000
#: Chunks that share a salt's partial sum of a pair.
CHUNKS_A_SALT = 256
_SPACE = "▁"
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level token as the vocabulary writes it: printable bytes as themselves, others moved up."""
    return bytes(_moved()[c] for c in token)


@functools.lru_cache(maxsize=1)
def _moved() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = {chr(b): b for b in plain}
    return own | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in own)}


def piece_bytes(piece: str) -> bytes:
    m = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(m[1], 16)]) if m else piece.replace(_SPACE, " ").encode()


class Side:
    """A tokenizer: texts to ids, ids to bytes."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.size = len(table)
        self.lengths = np.array([len(t) for t in table], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])


@functools.lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """ids of space + text."""
    vocabulary = library(path).get_vocab(with_added_tokens=True)
    special = {t.content for t in library(path).get_added_tokens_decoder().values()}
    table = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        table[i] = t.encode() if t in special else byte_level_bytes(t)
    encoder = library_encoder(path, "byte_level")
    return Side(lambda texts: encoder.many([" " + t for t in texts]), table)


class PieceParts:
    """Ids of texts by a sentencepiece model, whose parts are encoded once each.

    Where no piece of the model has a space behind another character, or a line break beside one, merges never pass
    such a place, so the ids of a text are those of its parts in turn; a model with such pieces gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.safe = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.pieces) and m.encode("\n x") == m.encode("\n") + m.encode("x")
        self.lead = len(m.encode("\n"))
        self.known: dict[str, bytes] = {}
        self.space = np.array(m.encode("\n")[: -len(m.encode("\n\n")) + self.lead], "<u4").tobytes()  # an empty text gets none
        self.parts = re.compile(r"\n| *[^ \n]+| +")

    def _learn(self, new: list[str]) -> None:
        self.known[" "] = self.space
        led = [p for p in new if p[0] == " " and p != " "]
        for p, ids in zip(led, self.model.encode([p[1:] for p in led], num_threads=1), strict=True):  # the model puts the first space itself
            self.known[p] = np.array(ids, "<u4").tobytes()
        bare = [p for p in new if p[0] != " "]
        for p, ids in zip(bare, self.model.encode(["\n" + p for p in bare], num_threads=1), strict=True):
            self.known[p] = np.array(ids[self.lead :], "<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.safe:
            return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]
        cut = [self.parts.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        known = self.known
        new = list(dict.fromkeys(p for own in cut for p in own if p not in known))
        if new:
            self._learn(new)
        return [b"".join([known[p] for p in own]) for own in cut]


@functools.lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    own = PieceParts(path)
    return Side(own.many, [piece_bytes(p) for p in own.pieces])


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them) for each i in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token, group of each B token, and the links: (A token, B token), in the order of A."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), "right")  # the B token that holds A's first byte
    counts = np.searchsorted(ends_b, ends_a, "left") + 1 - first
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.repeat(np.arange(len(ends_a)), counts), expanded(first, counts)


def pair_type(size_a: int, size_b: int) -> str:
    """How a pair (A id * size_b + B id) is stored."""
    return "<u4" if size_a * size_b <= 1 << 32 else "<i8"


class Aligned:
    """Some texts aligned together: per text the counts, the groups' digest, its distinct id pairs and how often each is linked."""

    def __init__(self, a: Side, b: Side, labels: tuple[list[bytes], ...], texts: list[str]):
        ids_a, ids_b, n_a, n_b = [], [], [], []
        for t, x, y in zip(texts, a.encode(texts), b.encode(texts), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            whole = b" " + t.encode("utf-8", "replace")
            if not t or a.joined(x.tolist()) != whole or b.joined(y.tolist()) != whole:
                x = y = x[:0]
            ids_a.append(x)
            ids_b.append(y)
            n_a.append(len(x))
            n_b.append(len(y))
        self.n_a, self.n_b = n_a, n_b
        ids_a, ids_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        group_a, group_b, left, right = align(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
        cut_a, cut_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        cut_g = np.concatenate([group_a, [group_a[-1] + 1 if len(group_a) else 0]])[cut_a]  # every text begins a group
        self.n_groups = np.diff(cut_g).tolist()
        cut_l = np.searchsorted(left, cut_a)
        self.n_links = np.diff(cut_l).tolist()
        self.digests = self._digests(labels, ids_a, ids_b, group_a, group_b, cut_a, cut_b)
        owner = np.repeat(np.arange(len(texts)), np.diff(cut_l))
        key, times = np.unique((owner << 40) | (ids_a[left] * b.size + ids_b[right]), return_counts=True)  # ids: 40 bits a pair
        self.pairs, self.times = (key & ((1 << 40) - 1)).astype(pair_type(a.size, b.size)), times
        self.cut_p = np.searchsorted(key, np.arange(len(texts) + 1) << 40).tolist()

    @staticmethod
    def _digests(labels, ids_a, ids_b, group_a, group_b, cut_a, cut_b) -> list[str]:
        """Each group is its A ids, then its B ids; the last id of a kind in a group has the mark that follows."""
        comma_a, bar, comma_b, semi = labels
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        code = np.concatenate([ids_a + last_a * len(comma_a), ids_b + 2 * len(comma_a) + last_b * len(comma_b)])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        table = comma_a + bar + comma_b + semi
        code, cut = code[order].tolist(), (cut_a + cut_b).tolist()
        return [hashlib.sha256(b"".join([table[c] for c in code[i:j]])[:-1]).hexdigest() if j > i else "" for i, j in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def _labels(n_a: int, n_b: int) -> tuple[list[bytes], ...]:
    return tuple([b"%d%s" % (i, mark) for i in range(n)] for n, mark in ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";")))


_ROWS = "chunk long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, of_chunk boolean"


def _encoded(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """A row for each document (pairs: its distinct id pairs, times: how often each), and one for each chunk
    (of_chunk: its distinct pairs and the number of its documents with each)."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("of_chunk", pa.bool_())])

    def run(batches):
        a, b = byte_side(a_path), piece_side(b_path)
        labels = _labels(a.size, b.size)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def closed():
            nonlocal chunk, size
            keys, counts = merged()
            row = {"chunk": chunk, "pairs": keys.tobytes(), "times": counts.astype("<u4").tobytes(), "of_chunk": True}
            held.clear()
            chunk, size = chunk + 1, 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_pylist()
            at = 0
            while at < len(sizes):
                end, chars = at, 0
                while end < len(sizes) and (end == at or chars + sizes[end] <= SLICE_CHARS):
                    chars += sizes[end]
                    end += 1
                own = Aligned(a, b, labels, batch.column(1).slice(at, end - at).to_pylist())
                cells = [[chunk] * (end - at), batch.column(0).slice(at, end - at), own.n_a, own.n_b, own.n_groups, own.n_links, own.digests]
                cuts = list(zip(own.cut_p[:-1], own.cut_p[1:], strict=True))
                cells += [[own.pairs[i:j].tobytes() for i, j in cuts], [own.times[i:j].astype("<u4").tobytes() for i, j in cuts], [False] * (end - at)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
                held.append(np.unique(own.pairs, return_counts=True))
                size += chars
                if len(held) > 40:
                    held[:] = [merged()]
                if size >= chunk_bytes:
                    yield closed()
                at = end
        if held:
            yield closed()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return own.mapInArrow(run, T._parse_datatype_string(_ROWS.format(id="long"))).withColumn("doc_id", F.col("doc_id").cast(kind))


def _unpacked(chunks: DataFrame, kind: str) -> DataFrame:
    """chunk, pair, k: a row for each distinct pair of a chunk."""

    def run(batches):
        for b in batches:
            for c, keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, kind).astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
                for i in range(0, len(keys), 50_000):
                    k = keys[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c)), pa.array(k), pa.array(counts[i : i + 50_000])], ["chunk", "pair", "k"])

    return chunks.select("chunk", "pairs", "times").mapInArrow(run, "chunk long, pair long, k long")


def pair_counts(each: DataFrame) -> DataFrame:
    """pair, n: documents that hold it linked; summed by pair and salt first, so a pair of every chunk isn't one task's."""
    salted = each.groupBy("pair", F.pmod(F.xxhash64(F.col("chunk")), F.lit(CHUNKS_A_SALT)).alias("salt")).agg(F.sum("k").alias("k"))
    return salted.groupBy("pair").agg(F.sum("k").alias("n"))


def _scored(docs: pa.Table, counts: pa.Table, kind: str) -> pa.Table:
    """A chunk's documents beside the counts of its pairs."""
    pair = counts["pair"].to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], counts["n"].to_numpy()[order], counts["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_best, total = [], []
    for keys, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, t = np.searchsorted(pair, np.frombuffer(keys, kind)), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int((best[at] * t).sum()) if len(t) else 0)
        total.append(int((n[at] * t).sum()) if len(t) else 0)
    own = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return own.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def aligned(docs: DataFrame, a_path: str, b_path: str, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text).

    Null and empty texts, and texts whose tokens of either side don't give back space + text (a text that holds the
    model's own sign for a space, or characters that its normalizer changes), have no tokens: zeros and an empty digest;
    they count for no pair. Every row is a document: repeated rows, and rows with the same or a null doc_id, count each.
    Other columns aren't read; doc_id is an integer. Texts of any length are aligned whole. An empty table has no rows.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = written(_encoded(docs, a_path, b_path, chunk_bytes), folder, "encoded")
    size_b = piece_side(b_path).size
    form = pair_type(byte_side(a_path).size, size_b)
    each = _unpacked(rows.where("of_chunk"), form)
    counts = written(pair_counts(each).withColumn("a", F.expr(f"pair div {size_b}")), folder, "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row for each A id at most
    marked = counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    replies = each.select("chunk", "pair").join(marked, "pair")
    own = rows.where("not of_chunk").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda docs, counts: _scored(docs, counts, form), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
