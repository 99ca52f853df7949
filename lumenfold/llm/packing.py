"""Packing into sequences by first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt into random groups of about GROUP_BYTES of text, and each group is packed by itself. A document
longer than a sequence is cut into full pieces and a rest. First fit needs the first bin with room: the tree holds in
each node the most room of any bin below it, so the bin is found and updated in log time. What room is left then is
filled by cutting pieces of the emptiest bins, so that at most one bin of a group isn't full; that one is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import give_back
from .bpe_replay import encoder_slices
from .common import input_bytes, text_or_empty
from .tokens import MOST, library_encoder

VOCABULARY, END_ID, LENGTH = "word_bpe_49k.json", 1, 2048
#: Text of a group, about; its ids are held in memory at once.
GROUP_BYTES = 4_000_000
SEED = 20_011


class TournamentTree:
    """Room of bins in their order; finds the first bin with at least so much room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin in which size fits, with that room taken; there must be one."""
        most, at = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has that room")
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        own = at - self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            x = max(most[2 * at], most[2 * at + 1])
            if x == most[at]:
                break
            most[at] = x
        return own


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins, each the list of its items. Equal sizes go in the items' order."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins = TournamentTree(max(1, len(sizes)), room), []
    for i in order:
        b = tree.take(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each id of each document once."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // room
        full += [[(d, k * room, room)] for k in range(whole)]
        if n % room:
            rest.append((d, whole * room, n % room))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([p[2] for p in rest], room)]
    fill = [sum(p[2] for p in b) for b in bins]
    done = full + [b for b, n in zip(bins, fill, strict=True) if n == room]
    # Bins with room, the fullest first: pieces of the last go into the first, cut where need be.
    open_ = [b for _, b in sorted(((n, b) for n, b in zip(fill, bins, strict=True) if n < room), key=lambda x: (-x[0], x[1]))]
    loose: list[tuple[int, int, int]] = []
    i, j = 0, len(open_) - 1
    while i < j or (i == j and loose):
        need = room - sum(p[2] for p in open_[i])
        while need and (loose or j > i):
            if not loose:
                loose, j = open_[j], j - 1
            d, s, n = loose.pop()
            cut = min(n, need)
            open_[i].append((d, s, cut))
            need -= cut
            if cut < n:
                loose.append((d, s + cut, n - cut))
        if need:
            break
        done.append(open_[i])
        i += 1
    last = [p for b in open_[i : j + 1] for p in b] + loose
    left = sum(p[2] for p in last)
    while last:  # below one sequence in all: lengths are the powers of two in it
        size, own = min(room, 1 << (left.bit_length() - 1)), []
        left -= size
        while size:
            d, s, n = last.pop(0)
            cut = min(n, size)
            own.append((d, s, cut))
            size -= cut
            if cut < n:
                last.insert(0, (d, s + cut, n - cut))
        done.append(own)
    return done


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, room: int = LENGTH, group_bytes: int = GROUP_BYTES, most: int = MOST) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: one piece with the end id. Rows are packed one by one, so a repeated doc_id yields the
    pieces of each of its rows, and a null doc_id stays null. Groups are drawn for each row by a seeded generator, not by
    any value of it, so no key makes a group large; their number follows the bytes of text. sequence_id holds the group
    in its upper and the sequence in its lower 32 bits. most: parts of texts whose ids a worker keeps.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", text_or_empty())
    groups = max(1, -(-input_bytes(own, "text") // group_bytes))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(key, group):
        give_back()  # what the last group, or another stage's task, held
        encoder, doc_ids, ids = library_encoder(vocabulary, "word", most), group.column("doc_id").to_pylist(), []
        for texts in encoder_slices(group.column("text")):
            ids += [x + end for x in encoder.many(texts)]
        base = key[0].as_py() << 32
        rows: list[list[int]] = [[], [], [], [], [], [], []]
        for k, seq in enumerate(pack_group([len(x) // 4 for x in ids], room)):
            offset = 0
            for d, s, n in seq:
                for col, v in zip(rows, (doc_ids[d], s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), len(ids[d]) // 4, base + k, offset), strict=True):
                    col.append(v)
                offset += n
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = own.withColumn("g", F.floor(F.rand(SEED) * groups))
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
