"""Spelling variants: groups words of a corpus that differ by one inserted, deleted or replaced character.

Full neighbourhood generation: each word of the vocabulary emits all distinct strings that one deletion, replacement or
insertion over the observed alphabet makes of it, and these are hash-joined to the vocabulary. A join partner is a near
word; no distance is computed.

A word of 8 characters has about a thousand such strings. Nearly all of them are no words, so they are first looked up,
as 64-bit rolling hashes that numpy derives from those of the word's prefixes and suffixes, in a Bloom filter of the
vocabulary. Its size is fixed (at most FILTER_BITS), only the share of strings that pass in vain follows the vocabulary;
what passes is written out as a string and joined exactly, so the filter decides costs alone.

Words of more than LONG characters don't emit a neighbourhood, whose bytes grow with the square of the length: they are
compared by hashes of the word without its i-th character, one for each i (twice the same one: a replacement; one that is
another word's own hash: a deletion), and the pairs found are verified on the strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, parts, shared_dir, text_or_empty, written

LEAST_CHARS, LEAST_COUNT, DROP = 5, 3, 97
#: Words up to so many characters emit their neighbourhood.
LONG = 64
#: Bits of the filter: so many a word, but no more than these in all (64 MB).
BITS_A_WORD, FILTER_BITS = 64, 1 << 29
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 500_000
#: Words whose neighbourhoods are a task's.
WORDS_A_TASK = 50_000
#: Candidates that are looked up at a time.
AT_A_TIME = 2_000_000

# Words are held in Latin-1, which has all characters of a word: one byte each. Others become a separator.
_WORD = {*range(97, 123), *range(0xC0, 0x100)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))
_OTHER = re.compile("[^\x00-\xff]+")


def runs(text: str) -> list[bytes]:
    """Maximal runs of word characters with A-Z in lower case, in Latin-1."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = _OTHER.sub(" ", text).encode("latin-1")
    return raw.translate(_TABLE).split()


def as_written(doc_id: int | None, run: bytes, prefix: int) -> bytes:
    """The run as it counts: if DROP divides the crc32 of "<doc_id>:<run>", without its character at crc32 % length."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % DROP:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the runs of all texts with enough characters and occurrences.

    Each task counts by itself and hands on a row for each word it met, so a frequent word is a row a task. A null
    doc_id is written as an empty string. Repeated rows count again. Null and empty texts have no words.
    """

    def run(batches):
        total: Counter[bytes] = Counter()

        def handed():
            raw = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([raw, pa.array(list(total.values()), pa.int64())], ["word", "k"])
            total.clear()
            return out

        for b in batches:
            for at in range(0, b.num_rows, 500):
                for d, t in zip(b.column(0).slice(at, 500).to_pylist(), b.column(1).slice(at, 500).to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if d is None else d}:".encode())
                    for w, k in Counter(runs(t)).items():
                        own = as_written(d, w, prefix)
                        if len(own) >= least_chars:
                            total[own] += k
                if len(total) > MOST_WORDS:
                    yield handed()
        if total:
            yield handed()

    each = docs.select("doc_id", text_or_empty()).mapInArrow(run, "word string, k long")
    return each.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= least_count)


# ---- the neighbourhood


def _weights() -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    return np.random.default_rng(20_011).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_T, _BASE = _weights(), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG + 2, _BASE)]), dtype=np.uint64)


def _prefixes(words: np.ndarray) -> np.ndarray:
    """words: n x L bytes; the rolling hash of each one's first 0 .. L bytes: n x (L + 1)."""
    out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
    for i in range(words.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + _T[words[:, i]]
    return out


def rolling(words: list[bytes]) -> np.ndarray:
    """The rolling hash of each word."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = _prefixes(np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8).reshape(len(at), n))[:, -1]
    return out


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of 2 ** bits for each hash."""
    shift = np.uint64(64 - bits)
    return (hashes * np.uint64(0xBF58476D1CE4E5B9)) >> shift, (hashes * np.uint64(0x94D049BB133111EB)) >> shift


def filter_table(words: DataFrame, bits: int) -> DataFrame:
    """slot, mask: the filter of the words in 64-bit parts, those that aren't zero."""

    def run(batches):
        for b in batches:
            at = np.concatenate(_places(rolling([w.encode("latin-1") for w in b.column(0).to_pylist()]), bits))
            slots, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            masks = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(masks, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(masks.view(np.int64))], ["slot", "mask"])

    return words.select("word").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))


def _load_filter(uri: str, bits: int) -> np.ndarray:
    fs, path = filesystem(uri)
    full = np.zeros(1 << (bits - 6), np.uint64)
    for b in pads.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["slot", "mask"]):
        full[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return full.view(np.uint8)


def neighbourhood(words: list[bytes], alphabet: bytes, passes=None) -> list[tuple[int, bytes]]:
    """(number of the word, string) of all distinct strings one edit away from words of one length.

    passes: from hashes to whether each may be a word; strings that don't pass aren't made.
    """
    n, length = len(words), len(words[0])
    table = np.frombuffer(b"".join(words), np.uint8).reshape(n, length)
    pre = _prefixes(table)
    tail = pre[:, -1:] - pre * _POWERS[length - np.arange(length + 1)]  # hashes of the suffixes from i on
    letters = np.frombuffer(alphabet, np.uint8)
    own = np.concatenate([table, np.zeros((n, 1), np.uint8)], axis=1)
    every = passes or (lambda h: np.ones(h.shape, bool))
    out: list[tuple[int, bytes]] = []
    # Of equal strings one is made: a run of one letter loses its last, and gains one at its end.
    k, i = np.nonzero(every(pre[:, :-1] * _POWERS[length - 1 - np.arange(length)] + tail[:, 1:]) & (own[:, :-1] != own[:, 1:]))
    out += [(a, words[a][:p] + words[a][p + 1 :]) for a, p in zip(k.tolist(), i.tolist(), strict=True)]
    for p in range(length + 1):
        for gone in (0, 1) if p < length else (0,):  # letters taken away where one is put in
            rest = length - p - gone
            h = (pre[:, p] * _POWERS[rest + 1] + tail[:, p + gone])[:, None] + (_T[letters] * _POWERS[rest])[None, :]
            k, x = np.nonzero(every(h) & (own[:, p, None] != letters[None, :]))
            out += [(a, words[a][:p] + alphabet[c : c + 1] + words[a][p + gone :]) for a, c in zip(k.tolist(), x.tolist(), strict=True)]
    return out


def candidates(vocabulary: DataFrame, alphabet: str, uri: str, bits: int) -> DataFrame:
    """word, near: the strings of each word's neighbourhood that pass the filter."""
    letters = alphabet.encode("latin-1")

    def run(batches):
        bitmap = None
        for b in batches:
            bitmap = _load_filter(uri, bits) if bitmap is None else bitmap

            def passes(hashes, bitmap=bitmap):
                flat = hashes.ravel()
                at = _places(flat, bits)[0]
                hit = np.flatnonzero(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                at = _places(flat[hit], bits)[1]
                hit = hit[bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
                out = np.zeros(flat.shape, bool)
                out[hit] = True
                return out.reshape(hashes.shape)

            words = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            words.sort(key=len)
            at = 0
            while at < len(words):
                length = len(words[at])
                end = min(at + max(1, AT_A_TIME // (len(letters) + length)), len(words))
                own = words[at:end]
                if len(own[-1]) != length:
                    own = [w for w in own if len(w) == length]
                at += len(own)
                found = neighbourhood(own, letters, passes)
                yield pa.RecordBatch.from_arrays([pa.array([own[k].decode("latin-1") for k, _ in found], pa.string()), pa.array([x.decode("latin-1") for _, x in found], pa.string())], ["word", "near"])

    return vocabulary.select("word").where(F.char_length("word") <= LONG).mapInArrow(run, "word string, near string")


def _long_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near among words of more than LONG characters."""

    def run(batches):
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(w.encode("latin-1"), np.uint8)
                n, power = len(raw), np.ones(len(raw) + 1, np.uint64)
                pre = np.zeros(n + 1, np.uint64)
                x = y = 0
                for k, t in enumerate(_T[raw].tolist()):
                    x = (x * int(_BASE) + t) & 0xFFFFFFFFFFFFFFFF
                    y = (y or 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
                    pre[k + 1], power[k + 1] = x, y
                tail = pre[-1] - pre * power[::-1]
                without = pre[:-1] * power[n - 1 :: -1] + tail[1:]
                for lo in range(0, n, 100_000):
                    part = without[lo : lo + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.string()), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), pa.array(part)], ["id", "at", "h"])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([-1], pa.int32()), pa.array([pre[-1:].view(np.int64)[0]])], ["id", "at", "h"])

    own = vocabulary.where(F.char_length("word") > LONG).select(F.md5("word").alias("id"), "word")
    keys = own.mapInArrow(run, "id string, at int, h long")
    a, b = keys.where("at >= 0").toDF("a", "at", "h"), keys.toDF("b", "at", "h")
    one = a.join(b.where("at >= 0"), ["at", "h"]).where("a <> b").select("a", "b", "at", F.lit(0).alias("less"))
    two = a.join(b.where("at < 0").select("b", "h"), "h").where("a <> b").select("a", "b", "at", F.lit(1).alias("less"))
    both = one.unionByName(two).join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    same = both.where("left(x, at) = left(y, at) and substring(x, at + 2) = substring(y, at + 2 - less) and char_length(x) = char_length(y) + less")
    pairs = same.select("x", "y", "less").distinct()
    return pairs.select(F.col("x").alias("word"), F.col("y").alias("near")).unionByName(pairs.where("less = 1").select(F.col("y").alias("word"), F.col("x").alias("near")))


def near_pairs(vocabulary: DataFrame, folder: str) -> DataFrame:
    """word, near: both ways, all pairs of the vocabulary (word) that differ by exactly one edit.

    Driver: the vocabulary's size and its distinct characters, which the word pattern bounds (90).
    """
    size = vocabulary.count()
    letters = [r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().orderBy("c").collect()]
    bits = int(min(FILTER_BITS, max(1 << 12, BITS_A_WORD * size)) - 1).bit_length()
    spread = vocabulary.repartition(parts(vocabulary.sparkSession, size, WORDS_A_TASK), "word")
    written(filter_table(spread.where(F.char_length("word") <= LONG + 1), bits), folder, "filter")
    made = candidates(spread, "".join(letters), f"{folder}/filter", bits)
    short = made.join(vocabulary.select(F.col("word").alias("near")), "near").select("word", "near")
    short = short.unionByName(short.where(F.char_length("near") > LONG).select(F.col("near").alias("word"), F.col("word").alias("near")))
    return short.unionByName(_long_pairs(vocabulary))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root of forms (word, form or null): the last word that following forms leads to.

    Pointers are doubled: as a form's count is at least twice its word's, a chain has at most 63 links, so there are six
    rounds at most; each is a join by the word pointed at and a table in the shared folder.
    """
    now = written(forms.where("form is not null").select("word", F.col("form").alias("root")), folder, "roots-0")
    for k in range(1, 8):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots-{k}")
        more, now = now.where("moved").limit(1).count(), now.select("word", "root")
        if not more:
            break
    return now


def variants(docs: DataFrame, folder: str | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (doc_id, text).

    form: the near word of the largest n (ties: the smallest in code-point order) where that n is at least twice the
    word's; else null, as is form_n. root: the word itself without a form. An empty table, or one without words that are
    frequent enough, has no rows. Other columns aren't read.
    """
    folder = folder or shared_dir(docs.sparkSession)
    vocabulary = written(word_counts(docs, least_chars, least_count), folder, "vocabulary")
    pairs = near_pairs(vocabulary, folder).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    joined = vocabulary.join(best, "word", "left")
    takes = F.coalesce(-F.col("b.m") >= 2 * F.col("n"), F.lit(False))
    forms = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("b.near")).alias("form"), F.when(takes, -F.col("b.m")).alias("form_n")), folder, "forms")
    return forms.join(roots(forms, folder), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
