"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts scans each document once.

Normalised: A-Z in lower case, every other ASCII character than letters and digits a separator, words joined by single
spaces. All of this is done on UTF-8 bytes, one byte for one byte, so the place of a word in the document is kept until
hits are told by their code points in the original. A pattern is a window of WINDOW consecutive words of an item (an item
of fewer words is one window) with a space at either end; equal windows of several items are one pattern.

The windows are a table in the shared folder, in blocks of whole items of about BLOCK_BYTES of text: each worker builds a
block's automaton once and keeps two at most, so its memory is bounded whatever the size of the benchmark. Up to that
size, one block (one automaton) is all there is; beyond, a batch of documents is held while the blocks pass over it.
Documents are not shuffled.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, input_bytes, shared_dir, text_or_empty

WINDOW = 10
#: Bytes of benchmark text to an automaton. A trie has up to WINDOW nodes of about 50 bytes for each byte of it.
BLOCK_BYTES = 400_000
#: Documents that the blocks pass over at a time.
ROWS = 1_000

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_WORD = {*b"0123456789", *_LETTERS, *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """The text's UTF-8 bytes with capitals A-Z as small letters and separators as spaces; as long as the original."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE)


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """All runs of so many words; a shorter list is one run, an empty one none."""
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def write_windows(benchmark: DataFrame, folder: str, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> int:
    """Writes the windows as tables folder/block=k (pattern, n, item_id) and returns how many blocks there are.

    Rows of the same item_id with different texts are all taken. A null item_id has windows, but no name.
    """

    def run(batches):
        for b in batches:
            rows = [(i, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in windows(normalised(t).split(), size)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([b" " + b" ".join(x) + b" " for _, x in rows], pa.binary()), pa.array([len(x) for _, x in rows], pa.int32())], ["item_id", "pattern", "n"])

    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty())
    blocks = max(1, -(-input_bytes(own, "text") // block_bytes))
    made = own.repartition(max(1, min(blocks, 4096)), F.xxhash64("item_id", "text")).mapInArrow(run, "item_id string, pattern binary, n int")
    # Equal windows meet in one block and are one pattern there, with a row for each of their items.
    made.distinct().withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))).repartition(max(1, min(blocks, 4096)), "block").write.mode("overwrite").partitionBy("block").parquet(folder)
    return blocks


class Scanner:
    """Finds a block's windows in normalised texts."""

    def __init__(self, table: pa.Table):
        import ahocorasick

        found: dict[bytes, tuple[int, list[str]]] = {}
        for p, n, i in zip(table["pattern"].to_pylist(), table["n"].to_pylist(), table["item_id"].to_pylist(), strict=True):
            own = found.setdefault(p, (n, []))[1]
            if i is not None:
                own.append(i)
        self.automaton = ahocorasick.Automaton() if found else None
        for p, value in found.items():
            self.automaton.add_word(p.decode("latin-1"), value)  # a character for each byte
        if found:
            self.automaton.make_automaton()

    def hits(self, joined: bytes):
        """(last byte, words of the window, its items) of every occurrence in words joined, led and followed by spaces."""
        return self.automaton.iter(joined.decode("latin-1")) if self.automaton else ()


@functools.lru_cache(maxsize=2)
def _scanner(folder: str, block: int) -> Scanner:
    fs, path = filesystem(f"{folder}/block={block}")
    if fs.get_file_info(path).type.name == "NotFound":  # no window fell into it
        return Scanner(pa.table({"pattern": [], "n": [], "item_id": []}))
    return Scanner(pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["pattern", "n", "item_id"]))


class Marks:
    """What is known of one document: which words are hit, by which items."""

    __slots__ = ("raw", "joined", "n_words", "hit", "items", "ends")

    def __init__(self, text: str):
        self.raw = normalised(text)
        words = self.raw.split()
        self.n_words, self.joined = len(words), b" " + b" ".join(words) + b" "
        self.hit: np.ndarray | None = None
        self.items: set[str] = set()

    def scan(self, scanner: Scanner) -> None:
        for end, (n, items) in scanner.hits(self.joined):
            if self.hit is None:
                self.hit = np.zeros(self.n_words + 1, np.int32)
                self.ends = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)  # the k-th space follows k words
            k = int(np.searchsorted(self.ends, end))
            self.hit[k - n] += 1
            self.hit[k] -= 1
            self.items.update(items)

    def mask(self) -> np.ndarray:
        """Whether each word is hit."""
        return np.zeros(self.n_words, bool) if self.hit is None else np.cumsum(self.hit[:-1]) > 0

    def spans(self) -> list[tuple[int, int]]:
        """Code points [start, end) of each run of hit words in the original text."""
        if self.hit is None:
            return []
        raw = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[False], raw != 32, [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1])[: self.n_words], np.flatnonzero(~inside[1:] & inside[:-1])
        edge = np.diff(np.concatenate([[0], self.mask().astype(np.int8), [0]]))
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        return list(zip(at[starts[np.flatnonzero(edge == 1)]].tolist(), at[ends[np.flatnonzero(edge == -1) - 1]].tolist(), strict=True))


#: n_words, n_hit: words of a document and those inside a window's occurrence; items: sorted; spans: code points of hit runs.
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def scanned(docs: DataFrame, benchmark: DataFrame, folder: str | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and FOUND for every row of docs (doc_id, text), benchmark being (item_id, text).

    Null, empty and wordless texts have 0 words and no hit; an empty benchmark hits nothing. Repeated rows, and rows with
    the same or a null doc_id, have a row each. Other columns aren't read. A null item_id hits words but isn't listed.
    Texts of any length are scanned whole.
    """
    folder = (folder or shared_dir(docs.sparkSession)) + "/windows"
    blocks = write_windows(benchmark, folder, size, block_bytes)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = [Marks(t) for t in b.column(1).slice(at, ROWS).to_pylist()]
                for k in range(blocks):
                    scanner = _scanner(folder, k)
                    for m in own:
                        m.scan(scanner)
                spans = [[{"start": i, "end": j} for i, j in m.spans()] for m in own]
                cells = [[m.n_words for m in own], [int(m.mask().sum()) if m.hit is not None else 0 for m in own], [sorted(m.items) for m in own], spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), *itertools.starmap(pa.array, zip(cells, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "items", "spans"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(FOUND).fields])
    return docs.select("doc_id", text_or_empty()).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scanned(); spans come along."""
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return digest(found).drop("spans")


def plain(text: str | None, items: list[tuple[object, str | None]], size: int = WINDOW) -> tuple[int, int, list[str]]:
    """n_words, n_hit and the sorted item ids of one text by comparing word lists, for tests."""
    words, hit, names = normalised(text).split(), set(), set()
    for i, t in items:
        for w in windows(normalised(t).split(), size):
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    names |= {str(i)} - {"None"}
    return len(words), len(hit), sorted(names)


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = f"""with dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), iw as (select item_id, {_WORDS} as w from benchmark),
 it as (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0),
 win as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as x from it),
 dt as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from win) where len(w) >= n),
 dg as (select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as x from dt),
 h as (select r, i, n, item_id from dg join win using (n, x)),
 p as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from h) group by r),
 m as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from h) group by r)
 select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from dw left join p using (r) left join m using (r)"""
