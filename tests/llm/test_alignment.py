"""Cross-tokenizer alignment against a plain version on the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from lumenfold.llm import alignment as A
from lumenfold.llm.tokens import library

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id long, text string, chunk string, pairs int"  # extra columns with clashing names


def brute(docs):
    a, b = library(P.path(A.A_FILE)), sentencepiece.SentencePieceProcessor(model_file=P.path(A.B_FILE))
    table_a = {i: A.byte_level_bytes(t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    done, pairs = [], Counter()
    for d, t, *_ in docs:
        own, text = Counter(), b"" if not t else b" " + t.encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs, ys = [table_a[i] for i in x], [A.piece_bytes(b.id_to_piece(i)) for i in y]
        if b"".join(xs) != text or b"".join(ys) != text:
            x = y = xs = ys = []
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(xs), ends(ys)
        cuts = sorted(set(ea) & set(eb))
        groups, at = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(x, ea, strict=True) if at < e <= c) + "|" + ",".join(str(i) for i, e in zip(y, eb, strict=True) if at < e <= c))
            at = c
        j0 = 0
        for i, e in zip(x, ea, strict=True):
            s = e - len(table_a[i])
            while j0 and eb[j0 - 1] > s:
                j0 -= 1
            while j0 < len(eb) and eb[j0] <= s:
                j0 += 1
            j = j0
            while j < len(eb) and eb[j] - len(ys[j]) < e:
                own[i, y[j]] += 1
                j += 1
        pairs.update(own.keys())
        done.append((d, len(x), len(y), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (i, _), n in pairs.items():
        best[i] = max(best[i], n)
    return sorted([(d, na, nb, ng, sum(own.values()), sum(k for (i, j), k in own.items() if pairs[i, j] == best[i]), sum(k * pairs[p] for p, k in own.items()), sha) for d, na, nb, ng, own, sha in done], key=str)


def made(spark, docs, **k):
    rows = A.aligned(spark.createDataFrame(docs, SCHEMA).repartition(3), P.path(A.A_FILE), P.path(A.B_FILE), **k)
    assert rows.columns == COLUMNS
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [A.CHUNK_BYTES, 300])
def test_equals_plain_on_odd_texts(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(A, "SLICE_CHARS", 200)
    rng = random.Random(5)
    bits = ["the", "naïve", "  ", "\n", "\n ", " \n", "\t", "中文字", "😀", "ﬁ", "x" * 30, "<|endoftext|>", "<s>", "</s>", "<0x41>", "1234.5", "don't", "é́", " ", "Straße", "\r\n", "\0", "   ", "a\nb"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts += ["a▁b", "▁", " ", "\n", "  lead", "trail  ", "word", None, "", "the " * 3000]
    docs = [(i // 2, t, "c", 1) for i, t in enumerate(texts)] + [(None, "the", "c", 1)] * 2
    found = made(spark, docs, chunk_bytes=chunk_bytes)
    assert found == brute(docs)
    assert sum(r[0] is None for r in found) == 2


def test_texts_without_tokens(spark):
    docs = [(1, None, "c", 1), (2, "", "c", 1), (3, "a▁b", "c", 1)]
    assert made(spark, docs) == [(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2, 3)]
    assert made(spark, []) == []


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.query(spark, folder).collect()), key=str) == brute(docs)


def test_align_links_what_overlaps():
    ga, gb, left, right = A.align(np.array([2, 3, 7, 9]), np.array([3, 4, 5, 9]))
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 1, 1, 1]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 3)]


def test_models_whose_parts_may_merge_get_whole_texts():
    own = A.PieceParts(P.path(A.B_FILE))
    assert own.safe
    texts = ["a  b\n\n c", "", "\n", "x"]
    cut = own.many(texts)
    own.safe = False
    assert own.many(texts) == cut
