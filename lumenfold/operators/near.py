"""Near duplicates on word shingles: sketched sets, banded MinHash or prefix buckets, stars of a bucket, counted links.

Documents with equal shingle sets are one class. A set is eight bytes a shingle, several times its text's share of a
compressed table; so sets are never written: a pass over the texts keeps a digest and a sketch of each (two bits a shingle at
most), another one sends the buckets' keys, and whole sets are made once more only for classes with a candidate. Every bucket
has a representative, the class of its least document; the classes that share a representative are its star. There all
pairs are compared on sketches in blocks of STAR_BLOCK classes; those that sketches can't tell apart meet again on their
sets. Pairs are counted, not emitted: a pair in several stars counts in the least of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.memory import tidied
from ..functions.text import terms
from ..sources.shared import shared_folder

WORDS, SIMILAR = 5, 0.8
#: Rows of a band; bands are as many as the recall asks for.
BAND_ROWS = 4
MISSED = 1e-6
#: Classes that are compared with as many others at a time.
STAR_BLOCK = 256
#: Cells in which shingles are counted by their hash (a power of two), and the rows that their counts travel in.
CELLS, _CELL_BLOCKS = 1 << 20, 64
#: Columns of the matrix by which sets are compared.
_WIDE = 8192
#: Digests that a task remembers to leave out the copies it meets, and bits of the mark of the classes that are made again.
_SEEN, _MARKS = 1 << 17, 1 << 24
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    """Bands with which a pair of that similarity shares none with a probability of at most missed."""
    return max(1, math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct runs of n words of documents laid end to end, in order; words: 64-bit hashes.

    A document of fewer words is one run, an empty one none.
    """
    lengths = lengths.astype(np.int64)
    runs = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    cut = np.append(0, np.cumsum(runs))
    doc = np.repeat(np.arange(len(lengths)), runs)
    at = np.arange(cut[-1]) + np.repeat(np.cumsum(lengths) - lengths - cut[:-1], runs)
    size = np.minimum(lengths, n)[doc]
    h = np.empty(len(at), np.uint64)
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        x, first = np.full(len(own), m, np.uint64), at[own]
        for i in range(m):
            x = _mixed(x * _P + words[first + i])
        h[own] = x
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[i:j].sort()
    keep = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return doc[keep], h[keep]


def signatures(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets laid end to end."""
    rng = np.random.default_rng(7)
    keys = np.zeros((len(starts), bands), np.uint64)
    for b in range(bands):
        for _ in range(rows):
            a, x = (rng.integers(0, 1 << 63, 2, np.uint64) << np.uint64(1)) | np.uint64(1)
            keys[:, b] = _mixed(keys[:, b] * _P + np.minimum.reduceat(_mixed((hashes ^ x) * a), starts))
    return keys


def _sets(batches, n: int):
    """(ids, digests, hashes of each set in order) of batches of ids and words; without words a digest is empty."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            own = b.column(1).slice(lo, 500)
            lengths = own.value_lengths().to_numpy(zero_copy_only=False)
            doc, h = shingle_hashes(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths, n)
            cut = np.searchsorted(doc, np.arange(len(lengths) + 1)).tolist()
            each = [h[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield b.column(0).slice(lo, 500), [hashlib.blake2b(x, digest_size=16).hexdigest() if len(x) else "" for x in each], each


def _first(keys: list[str], seen: set) -> list[bool]:
    """Which keys aren't empty or among those seen; seen gets them, and forgets all where it would grow over _SEEN."""
    out = []
    for k in keys:
        out.append(bool(k) and k not in seen)
        if out[-1]:
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(k)
    return out


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.transform(terms(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def packed_sets(docs: DataFrame, n: int = WORDS, once: bool = False) -> DataFrame:
    """doc_id, k (digest of the set), n, packed (its hashes in order); without words k is empty.

    once: without empty sets, and mostly without sets that the task has met before.
    """

    def run(batches):
        seen: set[str] = set()
        for ids, keys, each in _sets(batches, n):
            made = pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["doc_id", "k", "n", "packed"])
            yield made.filter(pa.array(_first(keys, seen))) if once else made

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _words(docs).mapInArrow(tidied(run), f"doc_id {kind}, k string, n long, packed binary")


def sketch(h: np.ndarray) -> bytes:
    """Whether the number of a set's hashes is odd in each of as many cells as it has hashes (a power of two, 64 at least).

    Two sets differ in as many hashes at least as their sketches in bits; halves that are added give the smaller sketch.
    """
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketched_sets(docs: DataFrame, n: int = WORDS, counted: bool = True) -> DataFrame:
    """doc_id, k, n, sketch; where counted also rows that have cells alone: what a task counts of sets that it hasn't met."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches):
        total, seen = np.zeros(CELLS, np.int64), set()
        for ids, keys, each in _sets(batches, n):
            if counted:
                _count(total, [x for x, new in zip(each, _first(keys, seen), strict=True) if new])
            columns = [ids, pa.array(keys), pa.array([len(x) for x in each], pa.int64()), pa.array([sketch(x) for x in each], pa.binary()), pa.nulls(len(keys), cells)]
            yield pa.RecordBatch.from_arrays(columns, names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_cell_blocks(total)], cells)], names)

    words = _words(docs)
    kind, cells, names = to_arrow_type(words.schema["doc_id"].dataType), pa.list_(pa.binary()), ["doc_id", "k", "n", "sketch", "cells"]
    return words.mapInArrow(tidied(run), f"doc_id {words.schema['doc_id'].dataType.simpleString()}, k string, n long, sketch binary, cells array<binary>")


def band_buckets(classes: DataFrame, similarity: float, counts: np.ndarray | None = None) -> DataFrame:
    """class_id, bucket: one row a band."""
    bands = bands_for(similarity)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                raw = b.column(1).slice(lo, 500).to_pylist()
                starts = np.cumsum([0, *(len(x) // 8 for x in raw)])[:-1]
                keys = signatures(np.frombuffer(b"".join(raw), np.uint64), starts, bands)
                keys ^= _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _P)[None, :]
                ids = b.column(0).slice(lo, 500).take(pa.array(np.repeat(np.arange(len(raw)), bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel().view(np.int64))], ["class_id", "bucket"])

    kind = classes.schema["class_id"].dataType.simpleString()
    return classes.select("class_id", "packed").mapInArrow(tidied(run), f"class_id {kind}, bucket long")


def _count(total: np.ndarray, each: list[np.ndarray]) -> None:
    if each:
        np.add(total, np.bincount((np.concatenate(each) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), out=total)


def _cell_blocks(total: np.ndarray) -> list[bytes]:
    return [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in total.reshape(_CELL_BLOCKS, -1)]


def _cell_sum(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts (cells): what goes to the driver is of fixed size."""
    size = CELLS // _CELL_BLOCKS * 8

    def summed(table):
        total = sum(np.frombuffer(pa.decompress(x.as_py(), size, "zstd"), np.int64) for x in table["counts"])
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    made = rows.select(F.posexplode("cells").alias("block", "counts")).groupBy("block").applyInArrow(summed, "block int, counts binary")
    found = {r.block: np.frombuffer(r["counts"], np.int64) for r in made.collect()}
    return np.concatenate([found.get(k, np.zeros(CELLS // _CELL_BLOCKS, np.int64)) for k in range(_CELL_BLOCKS)])


def cell_counts(classes: DataFrame) -> np.ndarray:
    """How many shingles of all classes fall into each of CELLS cells by their hash."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                _count(total, [np.frombuffer(x, np.uint64) for x in b.column(0).slice(lo, 4000).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([_cell_blocks(total)], pa.list_(pa.binary()))], ["cells"])

    return _cell_sum(classes.select("packed").mapInArrow(tidied(count), "cells array<binary>"))


def prefix(h: np.ndarray, sizes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, hash) of the rarest n - ceil(similarity * n) + 1 hashes of sets laid end to end, by their cells' counts, then by their upper bits.

    Where hashes are level in both at the end of a prefix, it takes them all.
    """
    keys = (np.minimum(counts[(h & np.uint64(CELLS - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    most = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    keep, at = np.zeros(len(h), bool), 0
    for n, k in zip(sizes.tolist(), most.tolist(), strict=True):
        if n:
            own = keys[at : at + n]
            keep[at : at + n] = own <= np.partition(own, k)[k]
        at += n
    return np.repeat(np.arange(len(sizes)), sizes)[keep], h[keep]


def prefix_buckets(classes: DataFrame, similarity: float, counts: np.ndarray | None = None) -> DataFrame:
    """class_id, bucket: a class's rarest shingles, one of which it shares with every class similar enough.

    Sets with a Jaccard similarity of s share one of their n - ceil(s * n) + 1 first in any order that is the same for all
    sets; so the order may be by counts of cells, and no shingle is sent anywhere to be counted or ranked. No shingle is
    dropped, however frequent: a frequent one is in a prefix only where a set has nothing rarer.
    """
    shared = classes.sparkSession.sparkContext.broadcast(cell_counts(classes) if counts is None else counts)  # CELLS numbers

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                raw = b.column(1).slice(lo, 500).to_pylist()
                owner, h = prefix(np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64), shared.value, similarity)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 500).take(pa.array(owner)), pa.array(h.view(np.int64))], ["class_id", "bucket"])

    kind = classes.schema["class_id"].dataType.simpleString()
    return classes.select("class_id", "packed").mapInArrow(tidied(run), f"class_id {kind}, bucket long")


def star_lists(buckets: DataFrame, sizes: DataFrame, similarity: float, members: DataFrame | None = None) -> DataFrame:
    """class_id, stars: of the stars of the buckets, those where a class meets one that isn't too small or too large to be alike.

    sizes: class_id, n. members: the class of each document in buckets, where these have documents for classes.
    """
    own = Window.partitionBy("bucket")  # one shuffle of the buckets
    ends = buckets.select("class_id", F.min("class_id").over(own).alias("star"), F.max("class_id").over(own).alias("last"))
    stars = ends.where("star < last").select("class_id", "star").distinct()
    if members is not None:
        for c in ("class_id", "star"):
            stars = stars.join(members.select(F.col("doc_id").alias(c), F.col("class_id").alias("of")), c).drop(c).withColumnRenamed("of", c)
        stars = stars.distinct()
    order = Window.partitionBy("star").orderBy("n")
    met = stars.join(sizes, "class_id").withColumns({"less": F.lag("n").over(order), "more": F.lead("n").over(order)})
    met = met.where((F.col("less") >= similarity * F.col("n") - 1e-6) | (F.col("n") >= similarity * F.col("more") - 1e-6))
    return met.groupBy("class_id").agg(F.array_sort(F.collect_set("star")).alias("stars"))


def links_by_stars(
    classes: DataFrame, buckets: DataFrame, similarity: float, folder: str, block: int = STAR_BLOCK, *, sketches: DataFrame | None = None, members: DataFrame | None = None, only: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """class_id, n_links: how many other classes (class_id, packed) that share a bucket are at least so similar.

    sketches: class_id, n, sketch, if they are at hand. only: gives the classes of a table of class_id, and may give more.
    """
    sketches = _sketched(classes) if sketches is None else sketches
    lists = _kept(star_lists(buckets, sketches.select("class_id", "n"), similarity, members), folder, "stars")
    each = lists.select("class_id", "stars", F.explode("stars").alias("star"))
    sizes = each.groupBy("star").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")).where("chunks > 1")
    dealt = each.join(sizes, "star", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    kind = classes.schema["class_id"].dataType.simpleString()
    row = f"star {kind}, lo int, hi int, own int, class_id {kind}, stars array<{kind}>"
    sent = met.join(sketches, "class_id").select("star", "lo", "hi", "own", "class_id", "stars", "n", "sketch")
    near = _kept(sent.groupBy("star", "lo", "hi").applyInArrow(lambda t: _block_maybe(t, similarity), row), folder, "near")
    ids = near.select("class_id").distinct()
    packed = (classes.join(ids, "class_id", "left_semi") if only is None else only(ids)).select("class_id", "packed").dropDuplicates(["class_id"])
    again = near.join(packed, "class_id").select("star", "lo", "hi", "own", "class_id", "stars", "packed")
    counted = again.groupBy("star", "lo", "hi").applyInArrow(lambda t: _block_links(t, similarity), f"class_id {kind}, n_links long")
    return counted.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))


def _sketched(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            each = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([sketch(x) for x in each], pa.binary())], ["class_id", "n", "sketch"])

    kind = classes.schema["class_id"].dataType.simpleString()
    return classes.select("class_id", "packed").mapInArrow(tidied(run), f"class_id {kind}, n long, sketch binary")


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is a class_id of ids, and some more: ids go to all tasks as marks of _MARKS bits, whatever their number."""
    at = F.pmod(F.xxhash64("class_id"), F.lit(_MARKS))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    marks = np.zeros(_MARKS // 64, np.int64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(marks.view(np.uint8), bitorder="little").view(bool))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value[b.column(2).to_numpy()])).select([0, 1])

    asked = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS)).alias("at"))
    return asked.mapInArrow(tidied(run), asked.drop("at").schema)


def _common(owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """How many values each two of the rows have in common; a row has each of its values once."""
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    both = times[column] > 1
    owner, (_, column) = owner[both], np.unique(column[both], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column, common = owner[order], column[order], np.zeros((rows, rows))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDE):
        i, j = np.searchsorted(column, [lo, lo + _WIDE])
        m = np.zeros((rows, min(_WIDE, int(column[-1]) + 1 - lo)), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    return common


def _counting(table: pa.Table) -> np.ndarray:
    """Pairs of a star's block that count there: of different chunks if it has two, and not of a lesser star."""
    star, lo, hi = (table[c][0].as_py() for c in ("star", "lo", "hi"))
    pairs = ~np.eye(table.num_rows, dtype=bool)
    if lo != hi:
        own = table["own"].to_numpy()
        pairs &= own[:, None] != own[None, :]
    stars = table["stars"].combine_chunks()
    owner, s = np.repeat(np.arange(table.num_rows), stars.value_lengths().to_numpy(zero_copy_only=False)), stars.flatten().to_numpy(zero_copy_only=False)
    lesser = s < star
    return pairs & (_common(owner[lesser], s[lesser], table.num_rows) == 0)


def alike(sizes: np.ndarray, sketches: list[bytes], pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the pairs (a symmetric matrix) that by sizes and sketches may be so similar: none that is so is left out."""
    out = np.zeros_like(pairs)
    total = sizes[:, None] + sizes[None, :]
    may = np.triu(pairs & (np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6))
    most = (1 - similarity) / (1 + similarity) * total + 1e-6  # members in which two such sets differ
    width = np.array([len(x) for x in sketches])
    for w in np.unique(width[may.any(axis=0) | may.any(axis=1)]).tolist():
        own, at = width == w, np.flatnonzero(width >= w)  # pairs whose smaller sketch has w bytes, the other one folded to it
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, w // 8), axis=0) for i in at.tolist()])
        for k, i in enumerate(at.tolist()):
            js = np.flatnonzero(may[i, at] & (own[i] | own[at]))
            if len(js):
                out[i, at[js]] = np.bitwise_count(folded[js] ^ folded[k]).sum(axis=1, dtype=np.int64) <= most[i, at[js]]
    return out | out.T


def _block_maybe(table: pa.Table, similarity: float) -> pa.Table:
    """The rows of a star's block that by their sketches may have a link there."""
    found = alike(table["n"].to_numpy(), table["sketch"].to_pylist(), ~np.eye(table.num_rows, dtype=bool), similarity)
    if found.any():
        found &= _counting(table)
    return table.drop_columns(["n", "sketch"]).filter(pa.array(found.any(axis=1)))


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the two chunks of a star's block (of one chunk: among its classes)."""
    raw = table["packed"].to_pylist()
    sizes = np.array([len(x) // 8 for x in raw])
    common = _common(np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(raw), np.uint64), len(raw))
    linked = _counting(table) & (common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
    return pa.table({"class_id": table["class_id"], "n_links": pa.array(linked.sum(axis=1).astype(np.int64))})


def near_duplicates(docs: DataFrame, similarity: float = SIMILAR, buckets=prefix_buckets, n: int = WORDS) -> DataFrame:
    """doc_id, class_id (least doc_id with the same shingle set), n_links (other sets at least so similar).

    buckets: prefix_buckets finds every link; band_buckets (MinHash) misses one of the least similarity with a
    probability of MISSED at most, at a cost that doesn't follow the sets' sizes. Documents without words are classes of
    their own without links.
    """
    folder = shared_folder(docs.sparkSession, "near")
    counted = buckets is prefix_buckets
    rows = _kept(sketched_sets(docs, n, counted), folder, "sets")
    counts = _cell_sum(rows.where("cells is not null")) if counted else None
    sets = rows.where("k is not null").drop("cells")
    keys = sets.groupBy("k").agg(F.min("doc_id").alias("class_id")).select(F.lower("k").alias("k"), "class_id")  # the same digests, dealt anew: Spark's skew join splits a large group of copies
    members = sets.join(keys, "k").select("doc_id", F.when(F.col("k") != "", F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n", "sketch")
    members = _kept(members, folder, "members")
    sketches = members.where("doc_id = class_id and n > 0").select("class_id", "n", "sketch").dropDuplicates(["class_id"])
    named = docs.where("doc_id is not null")
    found = buckets(_classes(packed_sets(named, n, once=True)), similarity, counts)
    links = links_by_stars(_classes(packed_sets(named, n)), found, similarity, folder, sketches=sketches, members=members, only=lambda ids: _classes(packed_sets(marked(named, ids), n)))
    links = _kept(links, folder, "links")  # and read anew, so that the join can split a large group of copies
    return members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("doc_id").alias("class_id"), "packed")


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
