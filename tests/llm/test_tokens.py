"""op1, op6 and op10 against the tokenizer libraries over whole tables and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lumenfold.llm import bpe_replay, packing, token_files

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "x\n\n  y ", "it's  we'll 'S", "\x1c a\x1db", "é ́x", " a  b", "123 4567", "<|endoftext|> a<|endoftext|>", "日本語 テキスト", "👩‍👩‍👧 ok", "İstanbul ΣΑΣ ς", "a" * 3000, "!?" * 700, "\t\ttab", "\r\n", "ab\u0000c", "One.\nTwo, three.\n\nFour .\n Five,\n. six.,\n9.\nX", "A.\x1fB.\n", "\n.", ",", "a*** b!!, é##' 's' it's.' ü.) x\u0301, 7%% \u4e00. \u2460! \u00b2? (w) [z]", "ABC, Abc. aBC.. É. é, ΑΣ.", None]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def random_texts(n=300):
    r = random.Random(5)
    alphabet = "ab  cA.,B!*\n\tdéß'.,!12  　Ωя漢字🙂\x1f"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = bpe_replay.read_ranks(public_tokenizers.path(bpe_replay.RANK_FILE))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_digest(tik, t):
    ids = tik.encode_ordinary(t or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tik.decode_bytes(ids)).hexdigest())


def test_replay_equals_library(spark, tik):
    texts = ODD + random_texts()
    got = {r[0]: tuple(r[1:]) for r in bpe_replay.digest(rows(spark, texts), public_tokenizers.path(bpe_replay.RANK_FILE)).collect()}
    assert got == {i: expected_digest(tik, t) for i, t in enumerate(texts)}


def test_replay_over_a_table(spark, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in bpe_replay.query(spark, SF).collect()}
    assert got == {i: expected_digest(tik, t) for i, t in docs.items()}


def test_replay_with_ranks_out_of_order():
    """Ranks that no training gives: a merge may make a pair of lower rank, which goes first in its word."""
    r = random.Random(2)
    for _ in range(60):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 4))) for _ in range(12)}
        order = r.sample(sorted(pieces), len(pieces))
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(40)]

        def plain(word, ranks=ranks):
            if word in ranks:
                return [ranks[word]]
            parts = [bytes([b]) for b in word]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    return [ranks[p] for p in parts]
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        assert bpe_replay.MergeReplay(ranks).encode(words) == [plain(w) for w in words]


def test_bits_round_trip():
    for bits in (1, 3, 8, 13, 16, 17, 20, 32):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype("<u4")
        data = token_files.pack(ids, bits)
        assert len(data) == -(-len(ids) * bits // 8)
        assert (token_files.unpack(data, len(ids), bits) == ids).all()
    docs = [np.arange(n, dtype="<u4") % 1000 for n in (0, 5, 9000, 1)]
    f = token_files.TokenFile(b"".join(token_files.file_bytes([None, 4, 4, 9], docs, 10, block=64)))
    assert f.doc_ids == [None, 4, 4, 9]
    assert all((f.document(k) == docs[k]).all() for k in range(4))
    assert (f.ids(60, 200) == np.concatenate(docs)[60:200]).all()


def library_ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_equal_library(spark, tmp_path):
    texts = ODD + random_texts(60)
    docs = rows(spark, texts)
    files = token_files.write(docs, f"file://{tmp_path}/t", public_tokenizers.path(token_files.VOCABULARY), file_ids=500)
    got = {r.doc_id: r for r in token_files.read(files).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library_ids(token_files.VOCABULARY, t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids)), repr(t)
        start += len(ids)
    assert files.count() > 3


def test_token_files_of_odd_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (7, "b"), (7, "a"), (7, "a"), (-1, None)], "doc_id long, text string")
    path = public_tokenizers.path(token_files.VOCABULARY)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read(token_files.write(docs, f"file://{tmp_path}/o", path)).collect())
    assert got == [(0, None, 2), (2, -1, 1), (3, 7, 2), (5, 7, 2), (7, 7, 2)]
    assert token_files.read(token_files.write(docs.limit(0), f"file://{tmp_path}/e", path)).count() == 0


def check_packing(spark, docs, texts):
    got = packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids, at = [*library_ids(packing.VOCABULARY, t), 1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padding == 0
    return got


def test_packing_equals_library(spark):
    texts = dict(enumerate(ODD + random_texts(60)))
    check_packing(spark, rows(spark, texts.values()), texts)


def test_packing_over_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(spark, docs, {r.doc_id: r.text for r in docs.collect()})


def test_packing_of_nothing(spark):
    assert packing.pack(rows(spark, ["a"]).limit(0), public_tokenizers.path(packing.VOCABULARY)).count() == 0
    got = packing.pack(spark.createDataFrame([(None, None), (3, "a"), (3, "a")], "doc_id long, text string"), public_tokenizers.path(packing.VOCABULARY)).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in got if r.start == 0) == [(False, 2), (False, 2), (True, 1)]


def test_first_fit_decreasing_equals_plain():
    r = random.Random(3)
    for _ in range(50):
        sizes, room = [r.randint(1, 100) for _ in range(r.randint(0, 60))], 100
        bins, plain = packing.first_fit_decreasing(sizes, room), []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b in plain if sum(sizes[k] for k in b) + sizes[i] <= room), None)
            if b is None:
                plain.append([i])
            else:
                b.append(i)
        assert bins == plain
