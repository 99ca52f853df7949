"""Byte-level BPE by corpus-level merge replay.

A slice of the corpus (what a task holds at a time) is cut into the matches of the split pattern, and its distinct
matches form one word list. An inverted index maps each mergeable pair to its positions in that list; the merges are
replayed in rank order over the index, and a merge touches only the two pairs next to it. The words' ids are kept in a
bounded table, so a frequent word is replayed once a worker, and texts are assembled from the table.

No shuffle: a text is encoded where it is read. Only the rank file (fixed size) is loaded by each worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import text_or_empty
from .tokens import _PIECE, PieceEncoder, byte_level_parts

#: Words whose ids a worker keeps, about; the table is emptied beyond.
MOST_WORDS = 250_000
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes lists of byte strings ("words") under ranks, as the lowest-rank-first merge of each word would."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 1_500_000):
        self.ranks, self.most_pairs = ranks, most_pairs
        self.token = {r: t for t, r in ranks.items()}
        byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(byte) < 0:
            raise ValueError("the ranks lack a single byte")
        self.byte = np.array(byte, np.int64)
        self.byte_pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.wide = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}  # left id * wide + right id, to the rank of their merge, or -1

    def _rank(self, key: int) -> int:
        a, b = divmod(key, self.wide)
        r = self.pairs[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is itself a token is that token."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        owners = [w for w, x in enumerate(out) if not x and words[w]]
        if not owners:
            return out
        # Symbols of all these words in turn, each word a chain; -1 in ids: merged into the symbol before it.
        raw = np.frombuffer(b"".join([words[w] for w in owners]), np.uint8).astype(np.int64)
        n = len(raw)
        starts = np.cumsum([0, *(len(words[w]) for w in owners)])
        first, last = np.zeros(n + 1, bool), np.zeros(n, bool)
        first[starts] = True
        last[starts[1:] - 1] = True
        ids = self.byte[raw].tolist()
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(first[:-1], -1, np.arange(-1, n - 1)).tolist()
        # The inverted index: the rank that a pair merges into, to the positions of such pairs.
        merges = np.where(last[:-1], -1, self.byte_pair[raw[:-1] * 256 + raw[1:]])
        at = np.flatnonzero(merges >= 0)
        at = at[np.argsort(merges[at], kind="stable")]
        ranks, cuts = np.unique(merges[at], return_index=True)
        flat, cuts = at.tolist(), [*cuts.tolist(), len(at)]
        index = {r: flat[cuts[k] : cuts[k + 1]] for k, r in enumerate(ranks.tolist())}
        queue = list(index)  # in order: a heap
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        wide, known, rank_of = self.wide, self.pairs.get, self._rank
        push, pop = heapq.heappush, heapq.heappop
        held: set[int] = set()  # words in which a lower rank came up: it goes first there
        word_of = None
        while queue:
            r = pop(queue)
            places = index.pop(r)
            places.sort()
            for p in places:
                a, q = ids[p], after[p]
                if a < 0 or q < 0:
                    continue  # an earlier merge took one of the two
                key = a * wide + ids[q]
                x = known(key)
                if (rank_of(key) if x is None else x) != r:
                    continue
                if held and word_of[p] in held:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        push(queue, r)
                    continue
                ids[p], ids[q] = r, -1
                nxt = after[p] = after[q]
                prv = before[p]
                if nxt >= 0:
                    before[nxt] = p
                    key = r * wide + ids[nxt]
                    x = known(key)
                    if x is None:
                        x = rank_of(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            push(queue, x)
                        if x < r:
                            if word_of is None:
                                word_of = np.repeat(np.arange(len(owners)), np.diff(starts)).tolist()
                            held.add(word_of[p])
                if prv >= 0:
                    key = ids[prv] * wide + r
                    x = known(key)
                    if x is None:
                        x = rank_of(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(prv)
                        else:
                            index[x] = [prv]
                            push(queue, x)
                        if x < r:
                            if word_of is None:
                                word_of = np.repeat(np.arange(len(owners)), np.diff(starts)).tolist()
                            held.add(word_of[p])
            held.clear()
        left = np.array(ids)
        kept = np.flatnonzero(left >= 0)
        edges = np.searchsorted(kept, starts).tolist()
        left = left[kept].tolist()
        for k, w in enumerate(owners):
            out[w] = left[edges[k] : edges[k + 1]]
        return out


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> tuple[PieceEncoder, list[bytes], list[str]]:
    """Encoder, bytes of each id, decimal form of each id; one of each a worker."""
    ranks = read_ranks(path)
    replay = MergeReplay(ranks)
    known: dict[str, bytes] = {}  # matches of the pattern

    def encode(parts: list[str], spaced: bool) -> list[bytes]:
        matches = [_PIECE.findall(" " + p if spaced else p) for p in parts]  # each is encoded by itself
        if len(known) > MOST_WORDS:
            known.clear()
        new = list(dict.fromkeys(m for ms in matches for m in ms if m not in known))
        ids = replay.encode([m.encode("utf-8", "replace") for m in new])
        flat = np.fromiter((i for x in ids for i in x), "<u4").tobytes()
        at = 0
        for m, x in zip(new, ids, strict=True):
            end = at + 4 * len(x)
            known[m] = flat[at:end]
            at = end
        return [known[ms[0]] if len(ms) == 1 else b"".join([known[m] for m in ms]) for ms in matches]

    table = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    return PieceEncoder(byte_level_parts, encode, small=False, breaks=True), table, [str(i) for i in range(len(table))]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4") for b in _codec(path)[0].many(texts)]


def decode_ids(path: str, ids) -> bytes:
    table = _codec(path)[1]
    return b"".join([table[i] for i in ids])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, in place of the text. Null text: no ids. Ids and repeated rows are kept as they are."""

    def run(batches):
        for b in batches:
            ids = encode_texts(path, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, ids array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encodes each text, decodes its ids, and returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null or empty text: no ids, and digests of the empty string. One row for each row, repeated ones too; null doc_ids
    stay null; other columns are not read. Texts of any length are encoded whole.
    """

    def run(batches):
        encoder, table, decimal = _codec(path)
        sha = hashlib.sha256
        for b in batches:
            rows: list[list] = [[], [], []]
            for part in encoder_slices(b.column(1)):
                for raw in encoder.many(part):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    rows[0].append(len(ids))
                    rows[1].append(sha(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    rows[2].append(sha(b"".join([table[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoder_slices(column, rows: int = 500):
    """Lists of a few hundred texts at a time, so that a batch isn't held as Python strings at once."""
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANK_FILE))
