"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik, "Efficient exact set-similarity joins").

Two sets of size s <= t with a Jaccard similarity of 0.8 or more differ in at most (s + t) / 9 elements. Sizes fall into
bands; a pair meets in the band of its larger set, where it differs in at most k = 2/9 of the band's largest size. There
the hashed domain of shingles is cut into N1 groups of N2 = 3 parts. Whatever k differences do, some group has K2 = 1
differing part at most as long as 2 * N1 > k, and the pair agrees on 2 of its parts: so each set emits, for each group, a
signature of its elements in each subset of 2 of the 3 parts, and a similar pair shares one.

Signatures of few elements are shared by many unlike sets (those of none by all). A set emits only signatures of at least
e elements, for the largest e at which they are proof enough: the differences needed to change all of them are more than
a linked set can have (two in a group with three such signatures, one in a group with fewer). Of a linked pair the set
with the larger e proves that they share a signature of that many elements, which both emit; sets without any such proof
emit all, and meet by the first argument. So the join loses no link.

Signatures travel as packed blobs, one for each bucket of hashes and slice of documents, and are matched by sorting a
bucket in numpy. Sets that share a signature form a family around the least of them. A family is compared block by block,
each block streaming the whole family past an inverted index of its shingles, and yields only the links that join its
parts: no list of all pairs is made, sent or kept. Links are decided on the whole shingle sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import give_back, tidied
from .bpe_replay import encoder_slices
from .common import input_bytes, parts, remove, row_and_text, row_texts, shared_dir, text_or_empty, written
from .components import components

WORDS = 5
N2, K2 = 3, 1
#: Bands of set sizes: each is so much wider than the one before.
RATIO = 1.5
#: Groups of a band, times the least number.
SPARE = 1.1
#: Text whose signatures fall into one bucket, about; a task sorts a bucket at once.
BUCKET_BYTES = 24_000_000
#: Shingles of the sets in a block of a family, about.
BLOCK_SHINGLES = 1_000_000
#: Sets in a block of a family, at most about.
BLOCK_SETS = 20_000
#: Rows that a task remembers to leave out their repetitions.
SEEN = 20_000
#: Bits of the filter that keeps texts without a family from being shuffled: its size is fixed.
FILTER_BITS = 1 << 23
#: Elements that signatures have at least, where a set can afford it.
ELEMENTS = (4, 3, 2, 1)

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to their sets of hashed 5-word shingles (sorted, 64 bits each); word hashes are kept in a bounded table."""

    def __init__(self, most: int = 250_000):
        self.most, self.known = most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = len(h)
        if n < WORDS:
            return _mix((h * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
        s = h[: n - WORDS + 1] * _ODD[0]
        for i in range(1, WORDS):
            s = s + h[i : n - WORDS + 1 + i] * _ODD[i]
        return np.unique(_mix(s))


def fingerprint(s: np.ndarray) -> bytes:
    """16 bytes, equal for equal sets."""
    return xxhash.xxh3_128_digest(s.tobytes())


@functools.cache
def bands() -> np.ndarray:
    """Largest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


def differences(largest: int) -> int:
    """The most elements in which two linked sets up to this size differ."""
    return 2 * largest // 9


def groups(largest: int) -> int:
    """Groups of parts for a band: enough for its differences, with some to spare for parts without elements."""
    k = differences(largest)
    return 1 if k == 0 else int((k + 2) // 2 * SPARE) + 1


def bands_of(size: int) -> list[int]:
    """The set's own band, and the next if larger sets there may link with it (4 * t <= 5 * s)."""
    top = bands()
    own = int(np.searchsorted(top, size))
    return [own, own + 1] if 5 * size >= 4 * (int(top[own]) + 1) else [own]


def signatures(s: np.ndarray) -> np.ndarray:
    """A set's signatures (64 bits), band and group mixed in."""
    out = []
    for band in bands_of(len(s)):
        largest = int(bands()[band])
        k, n1 = differences(largest), groups(largest)
        if k == 0:  # only equal sets link, and they are one already
            continue
        seed = _mix(np.array([band + 1], np.uint64))
        part = (_mix(s ^ seed) % np.uint64(N2 * n1)).astype(np.int64)
        held = np.zeros(N2 * n1, np.uint64)
        np.add.at(held, part, _mix(s + seed))
        held = held.reshape(n1, N2)
        n = np.bincount(part, minlength=N2 * n1).reshape(n1, N2)
        n = np.stack([n[:, 0] + n[:, 1], n[:, 0] + n[:, 2], n[:, 1] + n[:, 2]], axis=1)  # elements of each signature
        most = min(k, len(s) // 4)  # linked sets differ in a quarter of either at most
        least = 0
        for e in ELEMENTS:
            strong = (n >= e).sum(axis=1)
            if int((strong > 0).sum() + (strong == 3).sum()) > most:
                least = e
                break
        label = _mix(np.arange(n1, dtype=np.uint64) * _ODD[1] + seed)
        for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):  # subsets of N2 - K2 parts
            own = _mix(held[:, a] * _ODD[2] + held[:, b] * _ODD[3] + label + _ODD[i])
            out.append(own[n[:, i] >= least])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h (64 bits of the set's fingerprint) and fp (all 128) of every row; null and empty: n_shingles 0."""

    def run(batches):
        shingler = Shingler()
        for b in batches:
            n, fp = [], []
            for texts in encoder_slices(b.column(1)):
                for t in texts:
                    s = shingler(t)
                    n.append(len(s))
                    fp.append(fingerprint(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.frombuffer(b"".join(fp), "<i8")[::2]), pa.array(fp, pa.binary())], ["doc_id", "n_shingles", "h", "fp"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(tidied(run), "doc_id long, n_shingles long, h long, fp binary")


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: signatures of a slice of documents that fall into a bucket.

    A blob: number of sets and of signatures (4 bytes each); the sets' h (8 bytes); the signatures' upper 40 bits; the set
    of each (2 bytes).
    """

    def run(batches):
        shingler = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                hs, sigs, owner = [], [], []
                for texts in encoder_slices(b.column(1).slice(at, 4000)):
                    for t in texts:
                        s = shingler(t)
                        if len(s):
                            own = signatures(s)
                            if len(own):
                                owner.append(np.full(len(own), len(hs), np.uint16))
                                hs.append(fingerprint(s)[:8])
                                sigs.append(own)
                if not sigs:
                    continue
                sig, own = np.concatenate(sigs), np.concatenate(owner)
                del sigs, owner
                bucket = (sig % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, sig, own = bucket[order], sig[order], own[order]
                edges = np.flatnonzero(np.diff(bucket)) + 1
                h = np.frombuffer(b"".join(hs), "<u8")
                out = []
                for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(sig)], strict=True):
                    held, ref = np.unique(own[i:j], return_inverse=True)
                    upper = np.ascontiguousarray((sig[i:j] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                    out.append(np.array([len(held), j - i], "<u4").tobytes() + h[held].tobytes() + upper.tobytes() + ref.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[[0, *edges.tolist()]].astype("i4")), pa.array(out, pa.binary())], ["bucket", "blob"])

    return docs.select("doc_id", text_or_empty()).where("doc_id is not null").mapInArrow(tidied(run), "bucket int, blob binary")


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    sets_, n = np.frombuffer(blob, "<u4", 2).tolist()
    h = np.frombuffer(blob, "<u8", sets_, 8)
    sig = np.zeros((n, 8), np.uint8)
    sig[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 8 + 8 * sets_).reshape(n, 5)
    return sig.view("<u8").ravel(), h[np.frombuffer(blob, "<u2", n, 8 + 8 * sets_ + 5 * n)]


def match(sig: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows (least set, other set) of the sets that share a signature, each once."""
    order = np.argsort(sig)
    run = sig[order]
    twin = np.zeros(len(run), bool)
    twin[1:] = run[1:] == run[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    sig, h = sig[order], h[order]
    order = np.lexsort((h, sig))
    sig, h = sig[order], h[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(first)
    least = np.repeat(h[starts], np.diff(np.append(starts, len(sig))))
    pair = least != h
    return np.unique(np.stack([least[pair], h[pair]], axis=1), axis=0)


def _matched(blobs: DataFrame) -> DataFrame:
    """a, b: set b is in the family of set a."""

    def run(group):
        give_back()  # what the last bucket held
        opened = [_opened(v) for v in group.column("blob").to_pylist()]
        pairs = match(*(np.concatenate(x) for x in zip(*opened, strict=True)))
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return blobs.groupBy("bucket").applyInArrow(run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


class Block:
    """Sets of a block under an inverted index; tells which of them a set links with, and joins those."""

    def __init__(self, hs: list[int], sets_: list[np.ndarray]):
        self.hs, self.size = np.array(hs, np.int64), np.array([len(s) for s in sets_])
        element, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), self.size)
        order = np.argsort(element, kind="stable")
        self.owner = owner[order]
        self.element, self.starts = np.unique(element[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(order)))
        self.parent = list(range(len(hs)))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def links(self, h: int, s: np.ndarray) -> np.ndarray:
        """Positions of the other sets of the block that link with a set."""
        at = np.minimum(np.searchsorted(self.element, s), len(self.element) - 1)
        at = at[self.element[at] == s]
        n = self.counts[at]
        if not len(at):
            return at
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(self.owner[places], minlength=len(self.hs))
        return np.flatnonzero((100 * both >= 80 * (self.size + len(s) - both)) & (self.hs != h))

    def add(self, h: int, s: np.ndarray, own: int | None = None) -> int | None:
        """Joins the block's sets that a set links with (and that set, if it is in the block: own); one of them, or None."""
        found = self.links(h, s)
        if not len(found):
            return None
        roots = {self.root(k) for k in found.tolist()} | ({self.root(own)} if own is not None else set())
        low = min(roots)
        for r in roots:
            self.parent[r] = low
        return int(self.hs[found[0]])

    def joined(self) -> list[tuple[int, int]]:
        return [(int(self.hs[k]), int(self.hs[r])) for k in range(len(self.hs)) if (r := self.root(k)) != k]


def _filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that may have one of the ids: a filter of FILTER_BITS bits, whatever the number of ids.

    Of repeated rows a task hands on one (of those that it has in mind), so a row on many rows isn't shuffled as often.
    """
    bits = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 31 as int)))").alias("v"))
    words = np.zeros(FILTER_BITS // 32, np.int64)
    for r in bits.collect():  # FILTER_BITS / 32 rows at most
        words[r["w"]] = r["v"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            at = b.column(2).to_numpy()
            own = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "text"]).filter(pa.array((shared.value[at >> 5] >> (at & 31) & 1).astype(bool)))
            new = []
            for i, (d, t) in enumerate(zip(own.column(0).to_pylist(), own.column(1), strict=True)):
                key = (d, xxhash.xxh3_128_digest(t.as_buffer()))
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            yield own.take(pa.array(new, pa.int64()))

    return docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at")).mapInArrow(tidied(run), "doc_id long, text string")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """h, text: one text for each needed set (h, doc_id), whatever the rows that have it.

    The set's fingerprint is checked here: a row may have a representative's doc_id and another set.
    """

    def run(batches):
        shingler = Shingler()
        for b in batches:
            held = [int.from_bytes(fingerprint(shingler(t.as_py()))[:8], "little", signed=True) == h for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield b.filter(pa.array(held, pa.bool_()))

    found = _filtered(docs, needed).join(needed.select("h", "doc_id"), "doc_id").select("h", "text")
    return found.mapInArrow(tidied(run), "h long, text string").groupBy("h").agg(F.min("text").alias("text"))


def _family_links(family: DataFrame, texts: DataFrame, sizes: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that join the linked sets of each family: rows (a, b), set b being in the family of a; a is in it too.

    A family with many shingles or sets has several blocks; every set of it is in one, and is streamed past all.
    """
    spark = family.sparkSession
    load = family.join(sizes.select(F.col("h").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    blocks = written(load.select("a", F.ceil(F.greatest(F.col("n") / BLOCK_SHINGLES, F.col("m") / BLOCK_SETS)).cast("int").alias("k")), folder, "blocks")
    every = family.join(blocks, "a").select("a", "k", F.col("b").alias("h")).unionByName(blocks.select("a", "k", F.col("a").alias("h")))
    home = F.expr("int(pmod(xxhash64(h), k))")
    inside = every.select("a", "h", home.alias("chunk"), F.lit(0).alias("role"))
    past = every.where("k > 1").select("a", "h", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"), home.alias("home"), F.lit(1).alias("role")).where("chunk <> home").drop("home")
    rows = inside.unionByName(past).join(texts, "h")

    def run(batches):
        shingler, key, held, block = Shingler(), None, ([], []), None
        out: list[tuple[int, int]] = []

        def build():
            made = Block(*held)
            for k, (h, s) in enumerate(zip(*held, strict=True)):
                made.add(h, s, k)
            return made

        def close():
            nonlocal held, block
            if held[0]:
                out.extend((block or build()).joined())
            held, block = ([], []), None

        for b in batches:
            a, chunk, role, h = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if key != (a[i], chunk[i]):
                    close()
                    key = (a[i], chunk[i])
                s = shingler(b.column(4)[i].as_py())
                if role[i] == 0:
                    held[0].append(h[i])
                    held[1].append(s)
                elif held[0]:
                    block = block or build()
                    if (to := block.add(h[i], s)) is not None:
                        out.append((h[i], to))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    dealt = rows.select("a", "chunk", "role", "h", "text").repartition(parts(spark, 0, 1), "a", "chunk").sortWithinPartitions("a", "chunk", "role", "h")
    return written(dealt.mapInArrow(tidied(run), "a long, b long").distinct(), folder, "links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and fp (the set's fingerprint) of every row.

    Equal sets are one node from the start, so copies cost their rows only. A text without words (null, empty) has no set
    and links with nothing; so does a row without a doc_id (its component_id is null). Rows of one doc_id are told apart
    by their texts; repeated rows come out alike. Other columns are not read. Sets are compared by 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    own = docs.select("doc_id", text_or_empty())
    rows = written(sets(own), folder, "sets")
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("cid"), F.max("n_shingles").alias("n"), F.min("h").alias("h")), folder, "classes")
    buckets = parts(spark, input_bytes(own, "text"), BUCKET_BYTES)
    family = written(_matched(_bucketed(own, buckets)).distinct(), folder, "family")
    ends = family.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    needed = written(classes.join(ends, "h").select("h", "n", F.col("cid").alias("doc_id")), folder, "needed")
    texts = written(_texts(own, needed), folder, "texts")
    links = _family_links(family, texts, needed.select("h", "n").groupBy("h").agg(F.max("n").alias("n")), folder)
    roots = written(components(links, folder), folder, "roots")

    nodes = classes.join(roots, F.col("h") == F.col("v"), "left").select("fp", "cid", F.coalesce("root", "h").alias("root"))
    nodes = written(nodes, folder, "nodes")
    least = written(nodes.groupBy("root").agg(F.min("cid").alias("component_id")), folder, "least")
    nodes = written(nodes.join(least, "root").select("fp", "component_id"), folder, "rooted")
    remove(spark, folder, "classes", "family", "needed", "texts", "blocks", "links", "roots", "nodes", "least")
    inside = rows.where("n_shingles > 0 and doc_id is not null").join(nodes, "fp").select("doc_id", "n_shingles", "component_id", "fp")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "fp")
    return inside.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, as it came (all columns): that of the least doc_id.

    Rows that link with nothing stay, those without words or without a doc_id too. Of repeated rows one stays; of rows with
    one doc_id and one set that differ otherwise (in case, white space or other columns), that with the least hash of all
    columns, so the choice is the same in every run.
    """
    kept = join(docs).where("n_shingles > 0 and doc_id = component_id").select("doc_id", "fp").distinct()
    kept = written(kept, shared_dir(docs.sparkSession), "kept")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("fp", T.BinaryType())])

    def run(batches):
        shingler = Shingler()
        for b in batches:
            fp = [fingerprint(s) if len(s := shingler(t.as_py())) else None for t in row_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), "doc_id"), pa.array(fp, pa.binary())], ["row", "id", "fp"])

    rows = docs.select(*row_and_text(docs)).mapInArrow(tidied(run), schema)
    inside = rows.where("id is not null and fp is not null").join(kept.withColumnRenamed("doc_id", "id"), ["id", "fp"])
    maps = any(isinstance(f.dataType, T.MapType) for f in docs.schema.fields)
    inside = inside.groupBy("id", "fp").agg(F.min_by("row", F.to_json("row") if maps else F.xxhash64("row")).alias("row"))
    return inside.select("row").unionByName(rows.where("id is null or fp is null").select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) > 0 then list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) else [] end as s from w),
k as (select doc_id, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as k, s from s),
c as (select doc_id, n, case when n > 0 then min(doc_id) over (partition by k) else doc_id end as c, s from k),
x as (select c, n, unnest(s) as x from c where doc_id = c),
p as (select a.c as a, b.c as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.x = b.x and a.c <> b.c group by 1, 2),
l as (select a, b from p where 100 * shared >= 80 * (na + nb - shared)),
reach as (select c as a, c as b from c union select r.a, l.b from reach r join l on r.b = l.a)
select c.doc_id, c.n::bigint as n_shingles, r.b as component_id from c join (select a, min(b) as b from reach group by a) r on r.a = c.c
"""
